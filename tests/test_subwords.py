"""Subword sizes and chunks against another library with the same vocabulary."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken

from finlode.operators import subwords

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    words = ["revenue", "growth", "Überschuß", "naïve", "🙂🙂", "x1,234.50", "end.", "Why?", "\n\n", "  ", "<|endoftext|>", "日本語", "don't"]
    out = [" ".join(rng.choices(words, k=rng.choice([1, 5, 40, 300]))) for _ in range(40)]
    return [*out, "", "   \n", None, "one", "é" * 700, "🙂" * 200, "a" * 900, "No blanks" + "-" * 400]


def test_sizes(spark, other):
    rows = list(enumerate(texts()))
    got = {r["id"]: r["tokens"] for r in subwords.sized(spark.createDataFrame(rows, "id int, text string"), PATH).collect()}
    assert got == {i: len(other.encode_ordinary(t or "")) for i, t in rows}


@pytest.mark.parametrize("tail", [True, False])
def test_windows(spark, other, tail):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id int, text string")
    size, overlap = 32, 8
    got = {}
    for r in subwords.chunked(df, "id", "text", PATH, size, overlap, tail, trim=False).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r)
    for i, text in rows:
        if not (text or "").strip():
            assert i not in got
            continue
        tokens = other.encode_ordinary(text)
        n = len(tokens)
        last = n - 1 if tail else max(n - overlap - 1, 0)
        firsts = list(range(0, last + 1, size - overlap)) if n > size else [0]
        own = {r["first_token"]: r for r in got[i]}
        assert set(own) <= set(firsts)
        covered = 0
        for first in firsts:
            if first not in own:
                continue
            r = own[first]
            assert r["n_tokens"] == min(size, n - first) and r["begin"] <= max(covered, r["begin"])
            exact = other.decode_bytes(tokens[first : first + size]).decode(errors="ignore").strip()
            assert exact in text[r["begin"] : r["end"]] and (r["chunk_text"] == text if n <= size else r["chunk_text"] == text[r["begin"] : r["end"]].strip())
            assert r["begin"] <= covered or not text[covered : r["begin"]].strip()
            covered = max(covered, r["end"])
        assert not text[covered:].strip()


def test_trimming_and_long_texts(spark, other, monkeypatch):
    text = "One sentence here. " * 60
    rows = subwords.chunked(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", PATH, 50, 10).orderBy("chunk_index").collect()
    assert all(r["chunk_text"].endswith(".") and r["chunk_text"] in text for r in rows) and len(rows) > 5
    long = " ".join(t or "" for t in texts()) * 3
    whole = subwords.token_ends(long, PATH).tolist()
    monkeypatch.setattr(subwords, "PART", 50)
    cut = [(b, p) for b, p in subwords.parts(long, 50)]
    assert "".join(p for _, p in cut) == long and len(cut) > 50
    pieces = [x for b, p in cut for x in (subwords.token_ends(p, PATH) + b).tolist()]
    assert pieces == whole and len(whole) == len(other.encode_ordinary(long))
    assert subwords.chunked(spark.createDataFrame([], "id int, text string"), "id", "text", PATH).count() == 0


def test_pieces_met_before_are_not_encoded_again(other, monkeypatch):
    """Ends and sizes of many texts at once, in blocks and parts; a second pass asks the tokenizer for nothing."""
    known = [t or "" for t in texts() if not any(ord(c) >= 0x3000 for c in t or "")]
    monkeypatch.setattr(subwords, "PART", 300)
    for _ in range(2):
        ends = list(subwords.all_token_ends(known, PATH))
        for text, own in zip(known, ends, strict=True):
            tokens = other.encode_ordinary(text)
            starts = [len(other.decode_bytes(tokens[: i + 1]).decode(errors="ignore")) for i in range(len(tokens))]
            assert len(own) == len(tokens) and all(a <= b <= a + 1 for a, b in zip(starts, own.tolist(), strict=True))
        assert subwords.token_counts([*known, None], PATH) == [*map(len, ends), 0]
        monkeypatch.setattr(subwords._encoder(PATH)[0], "pieces", None)


def test_contexts_size_each_text_once(spark):
    """The sizes are read twice, for the sums of ranges and for the rows, but texts are encoded once, into a table."""
    from finlode.plans import subworded

    plan = subworded.context_subwords(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
