"""Personal data: exact base patterns, and a linear-chain conditional random field for what they miss."""

from __future__ import annotations

import csv
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import words as W
from .common import blocks, documents, merged, table

KINDS = ("email", "ip", "card", "phone")

# ---- base patterns -------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: From the start of a run of digits, which is where the leftmost match begins, and without going back: linear in any text.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping within a kind, matches that fail their test left out."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:  # an address is found from its @: the local part is all that may belong to it, back to the last match
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# ---- the field -----------------------------------------------------------------------------------------------------

#: What the field looks for: the kinds of the base patterns, and secrets such as keys and passwords, which are told apart.
FIELD_KINDS = (*KINDS, "secret")
#: Labels: outside, then beginning and inside of each kind.
LABELS = ("O", *(f"{x}-{k}" for k in FIELD_KINDS for x in "BI"))


def labelled_table(split: str) -> list[str]:
    """Texts of the labelled table, split train or test, with [kind:...] around personal data, mostly such as the base patterns miss."""
    with (files(__package__) / "data" / "personal_data.csv").open(newline="") as f:
        return [r["text"] for r in csv.DictReader(f) if r["split"] == split]


_TOKEN = re.compile(r"\S+")
_MARK = re.compile(r"\[(email|ip|card|phone|secret):((?:[^\[\]]|\[at\])+)\]")
_RUN = re.compile(r"[0-9]+|[A-Za-z]+")
#: A word that is given a value in the same token.
_KEYED = re.compile(r"[^A-Za-z]*([A-Za-z_]+)[=:]+[\"']*[0-9A-Za-z]{8}")
_SYMBOLS = re.compile(r"[^0-9A-Za-z\u0080-\U0010ffff]")


def shape(token: str) -> str:
    """A token's word shape: runs of digits as their length, letters as x or X, other characters as they are."""
    token = re.sub(r"[0-9]+", lambda m: f"<{min(len(m[0]), 9)}>", token.replace("<", "(").replace(">", ")"))
    out = re.sub(r"(?<![<0-9])[^\W\d_](?:[^\W\d_])*", lambda m: "X" if m[0][0].isupper() else "x", token)
    return out[:24]


def features(tokens: list[str], i: int) -> list[str]:
    """A token's features, from its own shape and its neighbours'."""
    own = tokens[i]
    get = lambda k: tokens[k] if 0 <= k < len(tokens) else ""
    before, after = get(i - 1), get(i + 1)
    name = lambda x: "#" if any(c.isdigit() for c in x) else x.lower().strip(".,:;\"'")
    digits = sum(c.isdigit() for c in own)
    out = [
        "bias",
        "shape=" + shape(own),
        "before=" + shape(before),
        "after=" + shape(after),
        "both=" + shape(before) + " " + shape(own),
        "next=" + shape(own) + " " + shape(after),
        "word=" + name(own),
        "word before=" + name(before),
        "two words before=" + name(get(i - 2)) + " " + name(before),
        f"digits={min(digits, 17)}",
        "parts=" + str(min(9, len(_RUN.findall(own)))),
        "symbols=" + "".join(sorted(set(_SYMBOLS.findall(own))))[:8],
    ]
    if "(at)" in own or "[at]" in own:
        out.append("spelled at")
    if own.count(":") > 3:
        out.append("many colons")
        out.append("long part" if max(map(len, own.split(":"))) > 2 else "short parts")
    if len(own) >= 10 and digits and len(_RUN.findall(own)) > 4 and own.count(":") < 4:
        out.append("mixed" + " with dashes" * ("-" in own))
        out.append("mixed after " + name(before))
    if m := _KEYED.match(own):
        out.append("keyed " + m[1].lower())
    return out


#: Tokens that can stand between parts of personal data.
BETWEEN = frozenset(("-", "\u2013", "\u2014", "/", ".", "\u00b7", "ext", "ext.", "x"))
#: Spelled-out signs of an address; those in brackets need no dot after them.
BRACKETED = frozenset(("(at)", "[at]"))
AT, DOT = BRACKETED | {"at"}, frozenset(("dot", "(dot)", "[dot]"))


def open_token(token: str) -> bool:
    """Whether a token by itself can be part of personal data."""
    low = token.lower()
    return any("0" <= c <= "9" for c in token) or "@" in token or "(at)" in low or "[at]" in low or low in BETWEEN


def _spelled(row: np.ndarray, at: np.ndarray, bracketed: np.ndarray, dot: np.ndarray) -> np.ndarray:
    """Which tokens are in an address in words: ``a (at) b``, or ``a at b dot c`` with any more dots; rows tell texts apart."""
    n = len(row)
    out = np.zeros(n, bool)
    for i in np.flatnonzero(bracketed).tolist():
        for k in (i - 1, i, i + 1):
            out[k % n] |= 0 <= k < n and row[k] == row[i]
    chained = set()
    for j in np.flatnonzero(dot).tolist():
        if j + 1 < n and j > 2 and row[j - 3] == row[j + 1] and (at[j - 2] or j - 2 in chained):
            out[j - 3 : j + 2] = True
            chained.add(j)
    return out


def open_tokens(tokens: list[str]) -> list[bool]:
    """Which of a text's tokens can be part of personal data; any other is outside by the model's definition."""
    low = [x.lower() for x in tokens]
    at, bracketed, dot = (np.array([x in words for x in low], bool) for words in (AT, BRACKETED, DOT))
    return [a or bool(b) for a, b in zip(map(open_token, tokens), _spelled(np.zeros(len(low)), at, bracketed, dot), strict=True)]


@dataclass
class ChainField:
    """A linear-chain conditional random field: emission weights by feature, transition weights."""

    names: dict[str, int]
    emission: np.ndarray
    transition: np.ndarray
    first: np.ndarray

    def emissions(self, tokens: list[str], places: range) -> np.ndarray:
        rows = []
        for i in places:
            known = [self.names[f] for f in features(tokens, i) if f in self.names]
            rows.append(self.emission[known].sum(0) if known else np.zeros(len(LABELS)))
        return np.array(rows)


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Log masks: inside may only follow the beginning or inside of its kind."""
    step = np.zeros((len(LABELS), len(LABELS)))
    first = np.zeros(len(LABELS))
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            first[j] = -1e4
            for i, before in enumerate(LABELS):
                if before[1:] != label[1:]:
                    step[i, j] = -1e4
    return step, first


def _parsed(example: str) -> tuple[list[str], list[int]]:
    """Tokens and label numbers of a marked text."""
    text, spans, at = "", [], 0
    for m in _MARK.finditer(example):
        text += example[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), FIELD_KINDS.index(m[1])))
        text += m[2]
        at = m.end()
    text += example[at:]
    tokens, labels = [], []
    for m in _TOKEN.finditer(text):
        label = 0
        for a, b, kind in spans:
            if m.start() < b and m.end() > a:
                label = 1 + 2 * kind + (m.start() > a)
        tokens.append(m[0])
        labels.append(label)
    return tokens, labels


def _luhn_filled(digits: list[str], rng: random.Random) -> list[str]:
    """Random digits in the same number that pass Luhn's test."""
    out = [str(rng.randrange(10)) for _ in digits[:-1]]
    return [*out, next(str(d) for d in range(10) if luhn("".join([*out, str(d)])))]


def varied(examples: list[str], copies: int, seed: int) -> list[str]:
    """The examples, and copies of each with other digits and other hexadecimal letters; cards keep passing Luhn's test."""
    rng = random.Random(seed)
    out = list(examples)

    def other(m: re.Match) -> str:
        if m[1] == "card":
            digits = iter(_luhn_filled(_DIGITS.findall(m[2]), rng))
            return f"[card:{_DIGITS.sub(lambda _: next(digits), m[2])}]"
        return m[0]

    for text in examples:
        for _ in range(copies):
            cards = _MARK.sub(other, text)
            kept = [m.span() for m in _MARK.finditer(cards) if m[1] == "card"]
            chars = []
            for i, c in enumerate(cards):
                if any(a <= i < b for a, b in kept) or not ("0" <= c <= "9" or c in "abcdef" and cards[max(0, i - 1) : i + 2].strip("abcdef") and any(x.isdigit() for x in cards[max(0, i - 1) : i + 2])):
                    chars.append(c)
                else:
                    chars.append(rng.choice("123456789") if c.isdigit() else rng.choice("abcdef"))
            out.append("".join(chars))
    return out


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(examples: list[str] | None = None, copies: int = 2, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> ChainField:
    """Maximum likelihood with a quadratic penalty by Adam; forward and backward sums in log space, all chains at once."""
    examples = labelled_table("train") if examples is None else list(examples)
    parsed = sorted((_parsed(x) for x in varied(examples, copies, 17)), key=lambda p: -len(p[0]))
    lists = [[features(t, i) for i in range(len(t))] for t, _ in parsed]
    names = {f: k for k, f in enumerate(sorted({f for rows in lists for row in rows for f in row}))}
    step_mask, first_mask = _allowed()
    n, size = len(LABELS), np.array([len(t) for t, _ in parsed])
    count, longest = len(parsed), int(size[0])
    # features of each token, padded with one of weight 0
    ids = np.full((count, longest, max(len(row) for rows in lists for row in rows)), len(names))
    y = np.zeros((count, longest), int)
    mask = np.zeros((count, longest, n))
    for i, (rows, (tokens, labels)) in enumerate(zip(lists, parsed, strict=True)):
        y[i, : len(labels)] = labels
        # only tokens that are open may be anything but outside
        mask[i, [k for k, x in enumerate(open_tokens(tokens)) if not x], 1:] = -1e4
        for k, row in enumerate(rows):
            ids[i, k, : len(row)] = [names[f] for f in row]
    live = np.arange(longest) < size[:, None]
    at = [int((size > t).sum()) for t in range(longest)]  # chains that have a token t, which come first
    truth = np.eye(n)[y] * live[:, :, None]
    pairs = np.zeros((n, n))
    for t in range(1, longest):
        np.add.at(pairs, (y[: at[t], t - 1], y[: at[t], t]), 1)
    weights = [np.zeros((len(names) + 1, n)), np.zeros((n, n))]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    for step in range(1, steps + 1):
        trans = weights[1] + step_mask
        e = weights[0][ids].sum(2) + mask
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + first_mask
        z = _total(alpha[:, 0], 1)
        for t in range(1, longest):
            k = at[t]
            alpha[:k, t] = e[:k, t] + _total(alpha[:k, t - 1, :, None] + trans, 1)
            z[:k] = _total(alpha[:k, t], 1)
        moved = -pairs
        for t in range(longest - 1, 0, -1):
            k = at[t]
            ahead = e[:k, t] + beta[:k, t]
            beta[:k, t - 1] = _total(trans + ahead[:, None, :], 2)
            moved = moved + np.exp(alpha[:k, t - 1, :, None] + trans + ahead[:, None, :] - z[:k, None, None]).sum(0)
        wrong = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None] - truth
        spread = np.broadcast_to(wrong[:, :, None, :], (*ids.shape, n)).reshape(-1, n)
        emission = np.stack([np.bincount(ids.ravel(), spread[:, j], len(names) + 1) for j in range(n)], axis=1)
        emission[-1] = 0
        for w, g, m in zip(weights, (emission, moved), moments, strict=True):
            g = g / count + decay * w
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            w -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return ChainField(names, weights[0][:-1], weights[1] + step_mask, first_mask)


def plausible(kind: int, span: str) -> bool:
    """Whether a span that the field finds can be of its kind: enough digits and parts, and what a number's own check says."""
    digits = _DIGITS.findall(span)
    if FIELD_KINDS[kind] == "phone":
        return 7 <= len(digits) <= 20 and max(map(len, re.findall(r"[0-9]+", span))) < 12
    if FIELD_KINDS[kind] == "card":
        return 13 <= len(digits) <= 19 and luhn("".join(digits))
    if FIELD_KINDS[kind] == "ip":
        return bool(re.fullmatch(r"(?=.*:.*:)[0-9A-Fa-f:.]{7,}|[0-9]{1,3}(\.[0-9]{1,3}){3}", span))
    if FIELD_KINDS[kind] == "email":
        return bool(re.search(r"(?i)@|\bat\b", span)) and bool(re.search(r"(?i)\.|\bdot\b|[\[(]at[\])]", span))
    return max((len(x) for x in re.findall(r"[0-9A-Za-z+/_-]+", span)), default=0) >= 8


#: Tokens of a batch of chains, padding included.
BATCH_TOKENS = 1 << 16


def viterbi(chains: list[np.ndarray], field: ChainField) -> list[np.ndarray]:
    """The best labels of many chains of emissions at once; chains of a batch are taken in step, longest first."""
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    out: list[np.ndarray] = [np.empty(0, int)] * len(chains)
    low = 0
    while low < len(order):
        # fewer chains at a time where they are long, so that the padded batch stays small
        chosen = order[low : low + max(1, min(512, BATCH_TOKENS // max(1, len(chains[order[low]]))))]
        low += len(chosen)
        batch = [chains[i] for i in chosen]
        sizes = np.array([len(c) for c in batch])
        longest = sizes[0]
        e = np.zeros((len(batch), longest, len(LABELS)))
        for k, c in enumerate(batch):
            e[k, : len(c)] = c
        best = e[:, 0] + field.first
        back = np.zeros((longest, len(batch), len(LABELS)), np.int8)
        ends = best.copy()
        for t in range(1, longest):
            live = int((sizes > t).sum())
            scores = best[:live, :, None] + field.transition[None]
            back[t, :live] = scores.argmax(1)
            best[:live] = scores.max(1) + e[:live, t]
            ends[:live] = best[:live]
        label = ends.argmax(1)
        path = np.zeros((len(batch), longest), int)
        for t in range(longest - 1, -1, -1):
            path[sizes > t, t] = label[sizes > t]
            if t:
                label = np.where(sizes > t, back[t, np.arange(len(batch)), label], label)
        for k, i in enumerate(chosen):
            out[i] = path[k, : sizes[k]]
    return out


def _trimmed(text: str, start: int, end: int, kind: int = 0) -> tuple[int, int]:
    """A span without the punctuation around it, a secret also without the name that it is given to."""
    if FIELD_KINDS[kind] == "secret" and (m := re.match(r"[^=:]*[=:]+(?=[\"']*[0-9A-Za-z])", text[start:end])):
        start += m.end()
    while end > start and not (text[end - 1].isalnum()):
        end -= 1
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    return start, end


def field_spans(texts: list[str], stretches: list[list[tuple[int, int]]], field: ChainField) -> list[list[tuple[int, int, int]]]:
    """Spans (kind, start, end) that the field finds in texts.

    A token that is not open is outside whatever its neighbours are, so the best labels of a whole text fall apart
    into those of its stretches of open tokens; only these, given by their first and last character, are decoded.
    """
    chains, where = [], []
    for row, (text, parts) in enumerate(zip(texts, stretches, strict=True)):
        for start, end in parts:
            # the neighbours on both sides are outside themselves, but features look at them
            left = text[max(0, start - 200) : start].split()[-2:]
            right = text[end : end + 200].split()[:1]
            tokens = [(m.start() + start, m.end() + start) for m in _TOKEN.finditer(text[start:end])]
            words = left + [text[a:b] for a, b in tokens] + right
            e = field.emissions(words, range(len(left), len(left) + len(tokens)))
            e = e + _edges(len(tokens), field, bool(left), bool(right))
            chains.append(e)
            where.append((row, tokens))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (row, tokens), path in zip(where, viterbi(chains, field), strict=True):
        open_: tuple[int, int, int] | None = None
        for (a, b), label in zip([*tokens, (0, 0)], [*path.tolist(), 0], strict=True):
            if open_ and (label == 0 or label % 2 == 1):
                start, end = _trimmed(texts[row], open_[1], open_[2], open_[0])
                if start < end and plausible(open_[0], texts[row][start:end]):
                    out[row].append((open_[0], start, end))
                open_ = None
            if label % 2 == 1:
                open_ = ((label - 1) // 2, a, b)
            elif label and open_:
                open_ = (open_[0], open_[1], b)
    return out


def _edges(n: int, field: ChainField, left: bool, right: bool) -> np.ndarray:
    """What a stretch's first and last token gain from the outside tokens next to it, if there are any."""
    out = np.zeros((n, len(LABELS)))
    if left:
        out[0] += np.where([x[0] == "I" for x in LABELS], 0, field.transition[0])
    if right:
        out[-1] += field.transition[:, 0]
    return out


#: Bytes that make a token open.
_OPEN = W.byte_class(lambda b: 48 <= b <= 57 or b == 64)


def _hashes(words: frozenset[str]) -> np.ndarray:
    """The words' hashes as ``find`` gives them."""
    raw = [x.encode() for x in sorted(words)]
    return W.find(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), W.SOLID).hash


_BETWEEN, _AT, _BRACKETED, _DOT = (_hashes(x) for x in (BETWEEN, AT, BRACKETED, DOT))


def _stretches(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """By row, byte bounds within the text of its stretches of open tokens."""
    found = W.find(data, offsets, W.SOLID)
    if not len(found.hash):
        return {}
    total = np.concatenate([[0], np.cumsum(_OPEN[data], dtype=np.int64)])
    bracket = np.concatenate([[0], np.cumsum((data == 40) | (data == 91), dtype=np.int64)])
    flag = total[found.end] > total[found.start]
    for i in np.flatnonzero(~flag & (bracket[found.end] > bracket[found.start])).tolist():
        low = data[found.start[i] : found.end[i]].tobytes().lower()
        flag[i] = b"(at)" in low or b"[at]" in low
    flag |= np.isin(found.hash, _BETWEEN)
    flag |= _spelled(found.row, *(np.isin(found.hash, x) for x in (_AT, _BRACKETED, _DOT)))
    joined = np.zeros(len(flag), bool)
    joined[1:] = flag[1:] & flag[:-1] & (found.row[1:] == found.row[:-1])
    head = np.flatnonzero(flag & ~joined)
    tail = np.flatnonzero(flag & ~np.append(joined[1:], False))
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(head.tolist(), tail.tolist(), strict=True):
        row = int(found.row[a])
        out.setdefault(row, []).append((int(found.start[a] - offsets[row]), int(found.end[b] - offsets[row])))
    return out


def _found(data: np.ndarray, offsets: np.ndarray, field: ChainField) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Base spans and all spans of each text of a block, in order."""
    n = len(offsets) - 1
    base: list[list[tuple]] = [[] for _ in range(n)]
    more: list[list[tuple]] = [[] for _ in range(n)]
    parts = _stretches(data, offsets)
    rows = sorted(parts)
    texts, stretches = [], []
    for row in rows:
        raw = data[offsets[row] : offsets[row + 1]]
        text = raw.tobytes().decode()
        at = parts[row]
        if len(text) < len(raw):  # places in characters
            begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            at = [(int(begins[a]), int(begins[b])) for a, b in at]
        texts.append(text)
        stretches.append(at)
        base[row] = sorted(base_spans(text))
    for row, added in zip(rows, field_spans(texts, stretches, field) if rows else (), strict=True):
        more[row] = sorted(base[row] + _apart(added, base[row]))
    return base, more


def _apart(added: list[tuple], base: list[tuple]) -> list[tuple]:
    """The added spans that overlap none of the base spans."""
    starts, ends = merged(np.array([a for _, a, _ in base], np.int64), np.array([b for _, _, b in base], np.int64))
    # of the disjoint runs that base spans cover, only the last that begins before a span's end can reach it
    return [s for s in added if not (k := int(np.searchsorted(starts, s[2]))) or ends[k - 1] <= s[1]]


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{FIELD_KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id {id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, secrets string, n_secret long, n_found long"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, secrets, n_secret, n_found; one scan, no shuffle.

    The counts and the digest are of the base patterns' spans. ``spans`` has these and, where they overlap none, the
    spans that the conditional random field finds; ``n_added`` counts the latter. ``secrets`` are the field's spans of
    keys, passwords and tokens, ``n_found`` counts spans and secrets. The field is fitted to ``examples``, texts with
    marked personal data (by default the package's labelled table), by maximum likelihood over word-shape features, and
    decoded by Viterbi in numpy batches. Spans are kind:start:end in characters, end exclusive, by kind, then start.

    A null or empty text has no spans. Null ids, repeated rows and ids are kept as they are, a row each; other columns
    are ignored, whatever their names; an empty table gives an empty result. Texts are read whole, however long.
    """
    source = documents(docs, id_col, text_col)
    field = fit(examples)  # some thousand weights, once; every task gets the same

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch):
                base, found = _found(data, offsets, field)
                counts = [pa.array([sum(s[0] == k for s in row) for row in base], pa.int64()) for k in range(len(KINDS))]
                digests = [hashlib.sha256(_joined(row).encode()).hexdigest() for row in base]
                spans = [[s for s in row if s[0] < len(KINDS)] for row in found]
                secrets = [[s for s in row if s[0] >= len(KINDS)] for row in found]
                added = [len(b) - len(a) for a, b in zip(base, spans, strict=True)]
                strings = [pa.array(digests, pa.string()), pa.array([_joined(row) for row in spans], pa.string()), pa.array([_joined(row) for row in secrets], pa.string())]
                numbers = [pa.array(x, pa.int64()) for x in (added, [len(x) for x in secrets], [len(x) for x in found])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, *strings[:2], numbers[0], strings[2], *numbers[1:]],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "secrets", "n_secret", "n_found"],
                )

    return source.mapInArrow(scan, SCHEMA.format(id=source.schema["doc_id"].dataType.simpleString()))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``personal_data`` of all documents."""
    return personal_data(table(spark, sf_dir, "documents"))
