"""Words, signatures, suffix arrays, automata and fields against plain versions."""

import random
import re
import zlib

import numpy as np
import pytest

from finlode.llm import personal_data
from finlode.llm import words as W
from finlode.llm.license_scan import PHRASES, SuffixAutomaton, split_words
from finlode.llm.near_dedup import super_minhash
from finlode.llm.personal_data import FIELD_KINDS, LABELS, base_spans, field_spans, fit, labelled_table, luhn, open_tokens, plausible, varied, viterbi
from finlode.llm.personal_data import _MARK, _TOKEN, _parsed, _stretches, _trimmed
from finlode.llm.pretokens import Encoder, vocabulary
from finlode.llm.suffix_order import suffix_array
from finlode.llm.token_files import crc_joined, from_planes, to_planes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


@pytest.mark.parametrize(("inside", "pattern"), [(W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (W.SOLID, r"[^\x20\x09-\x0D]+")])
def test_words_and_shingles(inside, pattern):
    rng = random.Random(2)
    texts = ["".join(rng.choices("aB9é.\t 界-", k=rng.randint(0, 30))) for _ in range(300)] + ["", "x", " "]
    data, offsets = block(texts)
    found = W.find(data, offsets, inside)
    names = {}
    for i, text in enumerate(texts):
        want = re.findall(pattern, text.translate(LOWER))
        a, b = found.first[i], found.first[i + 1]
        assert [data[s:e].tobytes().decode().translate(LOWER) for s, e in zip(found.start[a:b], found.end[a:b])] == want
        for w, h in zip(want, found.hash[a:b]):
            assert names.setdefault(w, h) == h == W.word_hash(w)
    assert len(set(names.values())) == len(names)
    for k in (1, 2, 5):
        hashes, heads = W.shingles(found, k)
        rows = found.row[heads] if len(heads) else heads
        seen = {}
        for i, text in enumerate(texts):
            w = tuple(re.findall(pattern, text.translate(LOWER)))
            want = [w[j : j + k] for j in range(len(w) - k + 1)] or ([w] if w else [])
            own = hashes[rows == i].tolist()
            assert len(own) == len(want)
            for x, h in zip(want, own):
                assert seen.setdefault(x, h) == h


def test_words_without_structure_and_long_words():
    """Words that a polynomial modulo 2**64 confuses have different hashes; words over several pieces have the right one."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    assert W.word_hash(word) != W.word_hash(word.translate(str.maketrans("ab", "ba")))
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab", k=n)) for n in (W.PIECE - 3, 2 * W.PIECE + 7, 5)] + ["x y" * W.PIECE]
    data, offsets = block(texts)
    found = W.find(data, offsets, W.SOLID)
    assert [int(h) for h in found.hash[:3]] == [W.word_hash(t) for t in texts[:3]]
    assert found.first.tolist() == [0, 1, 2, 3, 3 + W.PIECE + 1] and len(set(found.hash[4:-1].tolist())) == 1 and int(found.hash[4]) == W.word_hash("yx")


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        t = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (3, 40, 900):
        both, a, b = (rng.integers(1, 2**63, size, dtype=np.uint64) for size in (n, n // 2, n // 2))
        x, y = super_minhash(np.concatenate([both, a]), 400), super_minhash(np.concatenate([b, both]), 400)
        share = n / (n + len(a) + len(b))
        assert abs((x == y).mean() - share) < 0.13
        assert np.array_equal(x, super_minhash(np.concatenate([a, both]), 400))


def test_similar_sets_of_a_full_block_in_bounded_memory():
    import tracemalloc

    from finlode.llm.near_dedup import BLOCK_NODES, similar

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(12) < 0.08, rng.integers(0, 2**63, 12, dtype=np.uint64), base)) for _ in range(2 * BLOCK_NODES)]
    ones, others = np.arange(BLOCK_NODES), np.arange(BLOCK_NODES, 2 * BLOCK_NODES)
    tracemalloc.start()
    found = sum(len(x) for x, _ in similar(sets, ones, others, 80))
    assert tracemalloc.get_traced_memory()[1] < 300e6 and found > 0
    tracemalloc.stop()
    few = {(int(i), int(j)) for x, y in similar(sets[:60], np.arange(20), np.arange(10, 60), 80) for i, j in zip(x, y)}
    held = lambda a, b: 100 * len({*a.tolist()} & {*b.tolist()}) >= 80 * len({*a.tolist()} | {*b.tolist()})
    assert {(i, j) for i, j in few if i != j} == {(i, j) for i in range(20) for j in range(10, 60) if i != j and held(sets[i], sets[j])}


def test_suffix_automaton_gives_matching_statistics():
    rng = random.Random(4)
    texts = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(5)]
    use = SuffixAutomaton.of(texts)
    parts = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    stream = [rng.randint(0, 4) for _ in range(300)]
    state = length = 0
    for i, token in enumerate(stream):
        state, length = use.step(state, length, token)
        want = max((n for n in range(1, 13) if tuple(stream[max(0, i + 1 - n) : i + 1]) in parts and n <= i + 1), default=0)
        assert length == want
        for text, end in use.ends[state] if length else ():
            assert texts[text][end + 1 - length : end + 1] == stream[i + 1 - length : i + 1]
    assert split_words(PHRASES[0][0].upper()) == ["gnu", "general", "public", "license"]


def test_planes_and_checksums():
    rng = np.random.default_rng(0)
    for n in (1, 7, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        for planes in ("bit", "byte"):
            assert np.array_equal(from_planes(to_planes(ids, planes), n), ids)
    a, b = rng.bytes(100), rng.bytes(70001)
    assert crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_encoder_gives_what_the_library_gives():
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ll", "ve", " ", "  ", "\n", "\t", "a", "B", "1", "²", "é", "!", "ß", "　", "漢", "’", "😀", "'S", "d", "\r\n", "٣", "\x00", "\x1c", "\x85", "​", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(5000)]
    use = Encoder(vocabulary())
    ids, bounds = use.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == use.plain(texts)


def test_encoder_finds_added_tokens_in_texts():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "", "plain", "漢<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext", "|> <|endoftext |>"]
    ids, bounds = Encoder(vocabulary()).encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    fresh = Tokenizer.from_file(vocabulary())
    assert got == [fresh.encode(x, add_special_tokens=False).ids for x in texts]
    assert got[0] == [64, 220, 50256, 275]


def test_encoder_takes_long_texts_in_parts():
    import resource

    rng = random.Random(2)
    words = ["".join(rng.choices("abé'19!", k=rng.randint(1, 9))) for _ in range(3000)]
    text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t ", "\u3000", " <|endoftext|> " if rng.random() < 0.01 else " "]) for _ in range(40_000))
    use = Encoder(vocabulary())
    parts = list(use.parts(text, 1 << 12))
    assert "".join(parts) == text and len(parts) > 40
    assert np.concatenate([use.encode([p])[0] for p in parts]).tolist() == use.plain([text])[0]
    assert list(use.parts("z" * 9000, 1 << 12)) == ["z" * 9000]
    long = text * 60  # more than 12 million characters
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(len(use.encode([p])[0]) for p in use.parts(long, 1 << 18)) > len(long) // 5
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 250


def test_base_patterns():
    rng = random.Random(5)
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    parts = ["a", "b.", "@", "@x.y", "1", "-", "+", " ", "é", "c-d.com"]
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert [s[1:] for s in base_spans(text) if s[0] == 0] == [m.span() for m in plain.finditer(text)]
    text = "ip 1.2.3.256 and 10.0.0.1; card 4111 1111-1111 1111, 4111111111111112; +1 (375) 555-4393 +12"
    assert [(k, text[a:b]) for k, a, b in base_spans(text)] == [(1, "10.0.0.1"), (2, "4111 1111-1111 1111"), (3, "+1 (375) 555-4393")]


@pytest.fixture(scope="module")
def field():
    return fit()


def spans_of(field, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return sorted(field_spans([text], [_stretches(raw, np.array([0, len(raw)])).get(0, [])], field)[0])


def marked(example):
    """An example's text and the spans marked in it."""
    text, spans, at = "", [], 0
    for m in _MARK.finditer(example):
        text += example[at : m.start()]
        kind = FIELD_KINDS.index(m[1])
        spans.append((kind, len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    text += example[at:]
    return text, {(k, *_trimmed(text, a, b, k)) for k, a, b in spans}


def test_base_patterns_of_all_kinds_against_the_contract():
    """Every kind by its pattern as it is written down, on long runs of digits, signs at every place and letters that are not ASCII."""
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def holds(kind, span):
        digits = re.sub(r"[^0-9]", "", span)
        if kind == 1:
            return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))
        if kind == 2:
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == 0 or 9 <= len(digits) <= 15

    def brute(text):
        return sorted((k, *m.span()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if holds(k, m[0]))

    rng = random.Random(15)
    parts = ["4111 1111 1111 1111", "4111", "1111", "-", " ", ".", "+", "+1", "(", ")", "0", "7", "55", "123", "255", "256", "@", "a", "b.c", "é", "漢", "٣", "\u00a0", "\n", "5105105105105100", "1.2.3.4", "000"]
    seen = [0] * 4
    for _ in range(30000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        got = sorted(base_spans(text))
        assert got == brute(text)
        for kind, *_ in got:
            seen[kind] += 1
    assert min(seen) > 300
    for text in ("0" * 5000 + ".1.1.1", "0" * 5000 + "." + "9" * 5000 + ".1.1", "1.1.1." + "0" * 4400 + "9", "9" * 100_000, "+" + "1 " * 50_000):
        assert sorted(base_spans(text)) == brute(text)


def test_field_on_rows_it_never_saw(field):
    """Precision and recall of each kind on the test rows of the labelled table, as they are and with other digits."""
    good, got, want = ([0] * len(FIELD_KINDS) for _ in range(3))
    for example in varied(labelled_table("test"), 4, 99):
        text, truth = marked(example)
        found = set(spans_of(field, text))
        for spans, counts in ((found & truth, good), (found, got), (truth, want)):
            for kind, *_ in spans:
                counts[kind] += 1
    assert not set(labelled_table("train")) & set(labelled_table("test"))
    for kind, name in enumerate(FIELD_KINDS):
        assert good[kind] >= 0.9 * got[kind] and good[kind] >= 0.9 * want[kind] and want[kind] >= 15, name


def test_field_learns_its_table_and_stretches_are_exact(field):
    for example in labelled_table("train"):
        text, truth = marked(example)
        assert set(spans_of(field, text)) == truth
    for text in ("see 2 of 12 items", "price 12.50 and 1999", "words without any of it", "of 9807915762804490 4845168114407329 in", "x 4863730426282943 9807915762804490 4845168114407329 y"):
        assert spans_of(field, text) == []
    rng = random.Random(0)
    words = [w for x in labelled_table("train") for w in _parsed(x)[0]]
    for _ in range(60):
        chosen = rng.choices(words, k=rng.randint(1, 25))
        text = " ".join(chosen)
        e = field.emissions(chosen, range(len(chosen))) + np.array([[0.0] + [0.0 if x else -1e4] * (len(LABELS) - 1) for x in open_tokens(chosen)])
        spans, open_ = [], None
        for (a, b), label in zip([*(m.span() for m in _TOKEN.finditer(text)), (0, 0)], [*viterbi([e], field)[0].tolist(), 0]):
            if open_ and (label == 0 or label % 2):
                cut = _trimmed(text, open_[1], open_[2], open_[0])
                spans += [(open_[0], *cut)] if cut[0] < cut[1] and plausible(open_[0], text[cut[0] : cut[1]]) else []
                open_ = None
            open_ = ((label - 1) // 2, a, b) if label % 2 else (open_[0], open_[1], b) if label and open_ else None
        assert spans_of(field, text) == sorted(spans)


def test_varied_examples_keep_their_marks():
    rows = labelled_table("train")
    more = varied(rows, 3, 5)
    assert more[: len(rows)] == rows and len(more) == 4 * len(rows)
    for example in more:
        text, truth = marked(example)
        for kind, a, b in truth:
            assert FIELD_KINDS[kind] != "card" or luhn(re.sub(r"[^0-9]", "", text[a:b]))


def test_field_takes_separate_separators_and_spelled_addresses(field):
    for text, want in (
        ("call (917) 555 - 0123 today", [(3, "(917) 555 - 0123")]),
        ("card 4242 - 4242 - 4242 - 4242 was used", [(2, "4242 - 4242 - 4242 - 4242")]),
        ("email me: john at company dot net thanks", [(0, "john at company dot net")]),
        ("reach info at news dot site dot org now", [(0, "info at news dot site dot org")]),
        ("contact joe (at) site.net first", [(0, "joe (at) site.net")]),
        ("call (917) 555-0123 ext 77 now", [(3, "(917) 555-0123 ext 77")]),
        ("from 1985 - 1999 and 3 / 4 - or more", []),
        ("seen at the dot - and at home", []),
    ):
        assert [(k, text[a:b]) for k, a, b in spans_of(field, text)] == want


def test_base_spans_in_time_on_long_runs():
    """Long runs of digits, dots, signs and local parts are scanned once, not from each of their places."""
    assert base_spans("1" * 400_000) == [] and base_spans("a" * 400_000 + "@") == [] and base_spans("+" * 400_000) == []
    assert base_spans("1." * 3 + "1" + "." * 100_000) == [(1, 0, 7)]


def test_addresses_at_the_start_of_digits():
    rng = random.Random(7)
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(rng.choices("12.. a", k=rng.randint(0, 30)))
        expected = [m.span() for m in plain.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [s[1:] for s in base_spans(text) if s[0] == 1] == expected


def test_viterbi_in_small_batches(monkeypatch):
    use = fit(labelled_table("train")[:12], steps=20)
    rng = np.random.default_rng(4)
    chains = [rng.normal(size=(n, len(use.first))) for n in rng.integers(1, 40, 60)]
    whole = viterbi(chains, use)
    monkeypatch.setattr(personal_data, "BATCH_TOKENS", 50)
    assert all((a == b).all() for a, b in zip(whole, viterbi(chains, use), strict=True))
    monkeypatch.undo()
    assert all((a == viterbi([c], use)[0]).all() for a, c in zip(whole, chains, strict=True))


def test_added_spans_apart_from_base():
    rng = random.Random(9)
    spans = lambda: [(rng.randrange(4), a, a + rng.randint(1, 8)) for a in rng.choices(range(40), k=rng.randint(0, 5))]
    for _ in range(3000):
        base, added = spans(), spans()
        assert personal_data._apart(added, base) == [s for s in added if all(s[2] <= a or s[1] >= b for _, a, b in base)]
