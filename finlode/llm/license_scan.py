"""Licence scan by a generalised suffix automaton over licence words."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass, field
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, table
from .words import ALNUM, find, word_hash

#: Phrases whose every place counts, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


def licence_table() -> tuple[tuple[str, str], ...]:
    """Public licence texts, by label of their own: notices, terms and disclaimers, from the package's table."""
    with (files(__package__) / "data" / "licences.csv").open(newline="", encoding="utf-8") as f:
        return tuple((r["label"], r["text"]) for r in csv.DictReader(f))


TEMPLATES = licence_table()


def split_words(text: str) -> list[str]:
    """Words of a template: runs of letters, digits and characters that are not ASCII, A-Z lower-cased."""
    raw = text.encode()
    found = find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
    return [raw[a:b].lower().decode() for a, b in zip(found.start, found.end, strict=True)]


@dataclass
class SuffixAutomaton:
    """A generalised suffix automaton: its states are the classes of substrings of all texts that end at the same places."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Places (text, index of the last token) of each state's substrings.
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _cloned(self, p: int, token: int, q: int) -> int:
        """Splits q, reached from p by token, so that its longest substring is one longer than p's."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, token: int) -> int:
        if (q := self.next[last].get(token)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._cloned(last, token, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._cloned(p, token, q)
        return new

    @classmethod
    def of(cls, texts: list[list[int]]) -> SuffixAutomaton:
        out = cls()
        for tokens in texts:
            last = 0
            for token in tokens:
                last = out._extend(last, token)
        # each prefix's place belongs to its state and to all that it links to
        for k, tokens in enumerate(texts):
            state = 0
            for i, token in enumerate(tokens):
                state = out.next[state][token]
                s = state
                while s > 0:
                    out.ends[s].append((k, i))
                    s = out.link[s]
        return out

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        """From the longest suffix that occurs (its state and length) to that of the stream with one more token."""
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if token in self.next[state]:
            return self.next[state][token], length + 1
        return 0, 0


class Scanner:
    """Matches documents' words against phrases and templates.

    A match of two words or more lies in a run of template words, so only such runs are streamed through the
    automaton: nothing longer can be lost.
    """

    def __init__(self, phrases, templates, min_match: int, max_gap: int, min_share: float):
        self.phrases = [(split_words(p), label) for p, label in phrases]
        self.templates = [(split_words(t), label) for label, t in templates]
        self.min_match, self.max_gap, self.min_share = min_match, max_gap, min_share
        texts = [w for w, _ in self.phrases + self.templates]
        self.labels = [x for _, x in self.phrases + self.templates]
        self.sizes = [len(w) for w in texts]
        vocabulary = sorted({x for w in texts for x in w}, key=word_hash)
        self.hashes = np.array([word_hash(x) for x in vocabulary], np.uint64)
        number = {x: i for i, x in enumerate(vocabulary)}
        tokens = [[number[x] for x in w] for w in texts]
        self.automaton = SuffixAutomaton.of(tokens)
        # a state's substrings from the phrase's length on end with the phrase
        self.ending: dict[int, list[tuple[int, int]]] = {}
        for k, w in enumerate(tokens[: len(self.phrases)]):
            for state in range(1, len(self.automaton.next)):
                text, end = self.automaton.ends[state][0]
                longest = tokens[text][end + 1 - self.automaton.length[state] : end + 1]
                if longest[-len(w) :] == w:
                    self.ending.setdefault(state, []).append((len(w), k))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Words' numbers in the vocabulary, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def stream(self, tokens: list[int], first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Of a run that begins at word ``first``: phrases (place, phrase) and maximal matches (place, length, state)."""
        places, matches = [], []
        state = length = 0
        for i, token in enumerate(tokens):
            before, size = state, length
            state, length = self.automaton.step(state, length, token)
            if size >= self.min_match and length <= size:
                matches.append((first + i - size, size, before))
            for n, k in self.ending.get(state, ()):
                if length >= n:
                    places.append((first + i + 1 - n, k))
        if length >= self.min_match:
            matches.append((first + len(tokens) - length, length, state))
        return places, matches

    def chained(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains long matches: (template, first word, end, template words covered), best chain of each start.

        A match joins a chain of its template if it lies after it in both texts with at most max_gap words between.
        """
        open_, done = {}, []
        for place, size, state in matches:
            for text, end in self.automaton.ends[state]:
                begin = end + 1 - size
                best = None
                for chain in open_.get(text, []):
                    if 0 <= place - chain[1] <= self.max_gap and 0 <= begin - chain[2] <= self.max_gap and (best is None or chain[3] > best[3]):
                        best = chain
                if best is not None:
                    open_[text].append((best[0], place + size, end + 1, best[3] + size))
                else:
                    open_.setdefault(text, []).append((place, place + size, end + 1, size))
            for text, chains in open_.items():
                done += [(text, c[0], c[1], c[3]) for c in chains if place - c[1] > self.max_gap]
                open_[text] = [c for c in chains if place - c[1] <= self.max_gap]
        done += [(text, c[0], c[1], c[3]) for text in open_ for c in open_[text]]
        return done


_SCANNERS: dict[tuple, Scanner] = {}

SCHEMA = (
    "doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label string, first_word long, end_word long, covered double>>"
)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases=PHRASES,
    templates=TEMPLATES,
    min_match: int = 4,
    max_gap: int = 8,
    min_share: float = 0.6,
) -> DataFrame:
    """One row per document: words, places of phrases, labels, spans of templates and a score; one pass, no shuffle.

    Words are runs of letters, digits and characters that are not ASCII; A-Z are lower-cased. Each document's
    words are streamed through a suffix automaton of all phrases and templates, which gives at every word the
    longest match that ends there. Places of phrases follow from it. Matches of ``min_match`` words or more
    that are in order, with at most ``max_gap`` words between, are chained into a span of a template; a span
    that covers ``min_share`` of its template's words gives the template's label. ``score`` is the largest
    share of a phrase or template that the document covers.

    A null or empty text has no words, no labels and score 0. Null ids, repeated rows and ids are kept as they
    are, one row each. Other columns are ignored, whatever their names; an empty table gives an empty result.
    Texts are read whole, however long.
    """
    source = documents(docs, id_col, text_col)
    options = (tuple(phrases), tuple(templates), min_match, max_gap, min_share)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if options not in _SCANNERS:
            _SCANNERS[options] = Scanner(*options)
        use = _SCANNERS[options]
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                yield _scanned(use, rows, data, offsets)

    return source.mapInArrow(scan, SCHEMA.format(id=source.schema["doc_id"].dataType.simpleString()))


def _scanned(use: Scanner, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    words = find(data, offsets, ALNUM)
    numbers = use.numbers(words.hash)
    inside = numbers >= 0
    # runs of template words within a row
    joined = np.zeros(len(inside), bool)
    joined[1:] = inside[1:] & inside[:-1] & (words.row[1:] == words.row[:-1])
    begin = np.flatnonzero(inside & ~joined)
    follows = np.append(joined[1:], False) if len(joined) else joined
    end = np.flatnonzero(inside & ~follows) + 1
    shortest = min(use.sizes, default=1)
    keep = end - begin >= min(shortest, use.min_match)
    n = len(offsets) - 1
    places: dict[int, list[tuple[int, int]]] = {}
    matches: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(begin[keep].tolist(), end[keep].tolist(), strict=True):
        found, long = use.stream(numbers[a:b].tolist(), a - int(words.first[words.row[a]]))
        if found:
            places.setdefault(int(words.row[a]), []).extend(found)
        if long:
            matches.setdefault(int(words.row[a]), []).extend(long)
    out = {k: [None] * n for k in ("n_base", "first", "last", "base", "labels", "score", "spans")}
    for i in range(n):
        base = places.get(i, [])
        labels = {use.labels[k] for _, k in base}
        out["n_base"][i] = len(base)
        out["first"][i] = min((p for p, _ in base), default=None)
        out["last"][i] = max((p for p, _ in base), default=None)
        out["base"][i] = ",".join(sorted(labels))
        score, spans = float(bool(base)), []
        for text, a, b, covered in use.chained(matches[i]) if i in matches else ():
            share = min(1.0, covered / use.sizes[text])
            score = max(score, share)
            if share >= use.min_share and text >= len(use.phrases):
                spans.append((use.labels[text], a, b, share))
        best = {}
        for s in spans:  # one span of a label at each place
            if (s[0], s[1]) not in best or best[s[0], s[1]][3] < s[3]:
                best[s[0], s[1]] = s
        out["spans"][i] = [dict(zip(("label", "first_word", "end_word", "covered"), s, strict=True)) for s in sorted(best.values())]
        out["labels"][i] = ",".join(sorted(labels | {s[0] for s in best.values()}))
        out["score"][i] = score
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())]))
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0),
            pa.array(np.diff(words.first), pa.int64()),
            pa.array(out["n_base"], pa.int64()),
            pa.array(out["first"], pa.int64()),
            pa.array(out["last"], pa.int64()),
            pa.array(out["base"], pa.string()),
            pa.array(out["labels"], pa.string()),
            pa.array(out["score"], pa.float64()),
            pa.array(out["spans"], span),
        ],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``license_scan`` of all documents; spans as text, label:first:end:share joined by commas."""
    found = license_scan(table(spark, sf_dir, "documents"))
    span = lambda s: F.concat_ws(":", s["label"], s["first_word"], s["end_word"], F.round(s["covered"], 4))
    return found.withColumn("spans", F.array_join(F.transform("spans", span), ","))
