"""Source audit, prefix trie and n-gram join against their SQL and brute force, and on nulls, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from finlode.functions import arrow as runs
from finlode.llm import decontaminate, ngram_join, prefix_trie, source_audit
from finlode.llm import words as W

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        con.register(name, pd.DataFrame(rows, columns=columns))
    return con.sql(sql)


def same(df, relation):
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert sorted(relation.columns) == columns
    assert got == sorted(repr(tuple(r)) for r in relation.project(", ".join(columns)).fetchall())
    return len(got)


# ---- 6

def test_index_decides(spark, monkeypatch):
    """Hits equal brute force, and without the index only items beyond the largest radius are found."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.sample(words, 40))) for i in range(30)]
    rows = []
    for i in range(90):
        w = items[i % 30][1].split()
        if i % 3:
            w[rng.randrange(len(w))] = "other"
        rows.append((i, " ".join([*rng.sample(words, 20), *w, *rng.sample(words, 20)])))
    raw = [t.encode() for _, t in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    use = decontaminate.Benchmark(items, 5, 80, decontaminate.RADIUS)
    found = {(row, item) for row, hits in use.hits(data, offsets).items() for item, *_ in hits}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(36)} for _, t in items]
    want = set()
    for i, text in rows:
        w = text.split()
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        for item, own in enumerate(sets):
            best = max(len(own & set(grams[j : j + 36])) for j in range(len(grams) - 35))
            if 100 * best >= 80 * (72 - best):
                want.add((i, item))
    assert found == want and len(want) > 30 and use.wide.sum() < 3
    monkeypatch.setattr(decontaminate.HammingIndex, "search", lambda self, prints: (np.empty(0, np.int64), np.empty(0, np.int64)))
    assert {item for hits in use.hits(data, offsets).values() for item, *_ in hits} <= set(np.flatnonzero(use.wide).tolist())


def test_radii_and_repeats():
    rng = np.random.default_rng(3)
    for m in (9, 25, 80):
        r = 20 * m // 180
        for _ in range(40):
            own = rng.integers(0, 2**63, m, dtype=np.uint64)
            sums = decontaminate._sums(own)
            radius = decontaminate.radii(sums[None], m, np.array([1]), 80)[0]
            for _ in range(20):
                other = own.copy()
                other[rng.choice(m, r, replace=False)] = rng.integers(0, 2**63, r, dtype=np.uint64)
                assert ((decontaminate._sums(other) > 0) != (sums > 0)).sum() <= radius
    assert decontaminate.radii(sums[None], 5, np.array([1]), 80)[0] == 0
    for _ in range(100):
        text = rng.integers(0, 12, 30).astype(np.uint64)
        most = np.where(text < 3, 2, 1)
        size = int(rng.integers(1, 31))
        want = [any(n > (2 if x < 3 else 1) for x, n in Counter(text[i : i + size].tolist()).items()) for i in range(30 - size + 1)]
        assert decontaminate.repeats(text, most, size, 30 - size + 1).tolist() == want


def test_large_groups_use_the_blocks():
    rng = np.random.default_rng(6)
    prints, radius = rng.integers(0, 2**64, 4000, dtype=np.uint64), rng.integers(-1, 10, 4000)
    queries = prints[:50] ^ np.uint64(0x0100010001000100)
    index = decontaminate.HammingIndex(prints, radius)
    assert not index.few
    window, item = index.search(queries)
    near = np.bitwise_count(prints ^ queries[:, None]) <= radius
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


# ---- 11

AUDIT = ["doc_id", "text", "lang", "source"]


def audit_rows(n, seed=1):
    rng = random.Random(seed)
    words = ["Aa", "b", "Çé", "d'e", "f1g", "hh"] + [f"w{chr(97 + i)}" for i in range(20)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 25))), rng.choice(["en", "de", ""]), rng.choice(["s1", "s2", "é", "z", ""])) for i in range(n)]


def test_source_audit(spark):
    rows = audit_rows(400) + [(900, None, "en", "s1"), (901, "aa b", None, None), (902, "rare", "fr", "one"), (903, "", "fr", "two"), (904, "x", "xx", "only"), (7, "Aa", "en", "s1")]
    got = source_audit.source_audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5))
    relation = sql_rows(source_audit.OP11_SQL, documents=(rows, AUDIT))
    assert same(got, relation) > 200
    kept = {(r["lang"], r["source"], r["item"], r["value"]) for r in got.collect() if r["lang"] == "fr"}
    assert kept == {("fr", "one", "two", 0), ("fr", "two", "one", 0)}


def test_source_audit_in_small_pieces(spark, monkeypatch):
    """Blocks of a few texts, chunks of a few terms, and distances that are not held back."""
    rows = audit_rows(300, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = sorted(map(tuple, source_audit.source_audit(df, least=5).collect()))
    blocks, partials = source_audit.blocks, source_audit._Language.terms
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, source_audit.source_audit(df, least=5).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert blocks is source_audit.blocks and partials is source_audit._Language.terms
    groups = source_audit.pa.table({"source": ["a", "b", "c"], "n": [5, 0, 2], "new": [2, 2, 2]})
    terms = source_audit.pa.table({"term": ["t", "t", "u"], "source": ["a", "c", "a"], "n": [2, 2, 3]})
    out = []
    for held in (1 << 22, 1):
        monkeypatch.setattr(source_audit, "HELD", held)
        monkeypatch.setattr(source_audit, "CELLS", 3)
        language = source_audit._Language("en", groups, 5, 1_000_000_000)
        sums = Counter()
        for batch in [*language.terms(terms, np.array([0, 2])), *language.rest()]:
            for row in batch.to_pylist():
                sums[row["part"], row["source"], row["item"]] += row["value"]
        out.append(sums)
    assert out[0] == out[1] and len(out[0]) >= 4


def test_shares_are_exact():
    rng = random.Random(4)
    for top in (100, 10**9, 10**13, 10**17):
        total = [rng.randrange(top // 2 + 10, top + 20) for _ in range(50)]
        count = [rng.randrange(0, t) for t in total]
        got = source_audit.share(np.array(count), np.array(total), 5, 10**9)
        assert got.tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(count, total, strict=True)]


def test_runs_across_batches():
    rng = random.Random(5)
    keys = sorted(rng.choice("abcde") for _ in range(200))
    batches = [runs.pa.RecordBatch.from_pydict({"k": keys[i : i + n]}) for i, n in zip(range(0, 200, 8), [8] * 25, strict=True)]
    seen = []
    for rows, starts in runs.whole_runs(iter(batches), "k"):
        column = rows.column("k").to_pylist()
        for a, b in zip(starts, [*starts[1:], len(column)], strict=True):
            assert len(set(column[a:b])) == 1
            seen.append((column[a], int(b - a)))
    assert seen == sorted(Counter(keys).items()) and not list(runs.whole_runs(iter([]), "k"))


def test_source_audit_messy(spark):
    clash = "doc_id long, text string, lang string, source string, term string, n long, new long, slot int, mark int, value long, rank int"
    rows = [(1, "a b", "en", "s", "t", 1, 1, 1, 1, 1, 1), (1, "a b", "en", "s", *[None] * 7), (2, "word " * 5000 + "É" * 3000, "en", "r", *[None] * 7), (None, None, None, None, *[None] * 7)]
    df = spark.createDataFrame(rows, clash)
    got = source_audit.source_audit(df, least=1)
    assert {(r["source"], r["item"]) for r in got.collect() if r["part"] == "pair"} == {("s", "r"), ("r", "s")}
    assert source_audit.source_audit(df.limit(0)).count() == 0


# ---- 12

def brute_trie(rows, family=5):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0, key), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in turns.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % family, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = lambda n: sum(1 for m in members if len(m) == len(n) + 1 and m[: len(n)] == n)
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children(node), sum(1 for n in below if not children(n)),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversation_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = [("user", "hi"), ("assistant", rng.choice("xy")), *((rng.choice(["user", None]), rng.choice(["é", "bb", None, ""])) for _ in range(rng.randint(0, 9)))]
        turns = turns[rng.choice([0, 0, 0, 1]) :] if c % 7 else turns[:1]
        if c % 11:
            rows += [(c, rng.choice([i, i, None]) if i == 0 else i, *t) for i, t in enumerate(turns)]
    return rows


def test_prefix_trie(spark):
    for seed, n in ((1, 60), (2, 25)):
        rows = conversation_rows(n, seed) + [(3, 2, "user", "tie"), (3, 2, "user", "tie"), (None, 1, "user", "hi"), (2**40 + 3, 0, "user", "hi")]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
        got = sorted((tuple(r) for r in prefix_trie.prefix_trie(df, family=5).collect()), key=repr)
        assert got == brute_trie(rows)
        alone = sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr)
        assert alone == brute_trie(rows, 1)


def test_prefix_trie_against_its_sql(spark):
    rows = [r for r in conversation_rows(80, 3) if r[0] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    relation = sql_rows(prefix_trie.OP12_SQL, conversations=([(c, float("nan") if t is None else t, r, x) for c, t, r, x in rows if t is not None], ["conv_id", "turn", "role", "text"]))
    same(prefix_trie.prefix_trie(df.where("turn IS NOT NULL"), family=5), relation)


def test_prefix_trie_of_a_long_conversation(spark):
    """One conversation of 4000 turns, and another that leaves it late: rows stay as many as there are prefixes."""
    rows = [(c, i, "user", str(i if i < cut else -c)) for c, cut in ((5, 4000), (10, 3990), (15, 4000)) for i in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.prefix_trie(df).collect()}
    assert len(got) == 4001 + 10
    assert got[5, 0]["n_leaves"] == 2 and got[5, 3990]["n_children"] == 2 and got[10, 3991]["parent_conv_id"] == 5
    assert got[5, 4000]["ends_sha256"] == hashlib.sha256(b"5,15").hexdigest()


def test_prefix_trie_ranges_and_messy(spark, monkeypatch):
    ids = [0, 1, 65535, 65536, 131072, 7 * 65536]
    clash = "conv_id long, turn long, role string, text string, depth int, digest string, parent string, size int, family int, own int"
    rows = [(c, 0, "user", "same", *[1, "x", "y", 2, 3, 4]) for c in ids]
    df = spark.createDataFrame(rows, clash)
    got = {r["depth"]: r for r in prefix_trie.prefix_trie(df).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[1]["saved_tokens"] == 20
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


# ---- 13

def ngram_rows(n, seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(60)]
    base = [rng.choices(words, k=rng.choice([1, 3, 6, 30, 80, 120])) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w if rng.random() < 0.8 else [*w, *rng.choices(words, k=4)])))
    return rows


def brute_components(rows, k=5, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").translate(LOWER).split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("k", [5, 2])
def test_ngram_links(spark, k):
    rows = ngram_rows(220, 7) + [(500, None), (501, ""), (502, " \t "), (503, "A b"), (504, "a B")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, ngram_join.ngram_links(df, k=k).collect())) == brute_components(rows, k)


def test_ngram_links_in_small_blocks(spark, monkeypatch):
    """Blocks of a few documents, slabs of three, and slices of a few columns."""
    from finlode.llm import near_dedup

    rows = ngram_rows(150, 9)
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_links(df).collect())) == brute_components(rows)


@pytest.mark.parametrize("slab,dense,sparse", [(512, 1 << 22, 1 << 21), (3, 64, 5)])
def test_overlaps(monkeypatch, slab, dense, sparse):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(ngram_join, "SLAB", slab)
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    monkeypatch.setattr(ngram_join, "SPARSE", sparse)
    for spread in (300, 5000):
        sets = []
        for i in range(60):
            own = rng.integers(0, spread, rng.integers(1, 60)).astype(np.uint64)
            if i % 3 and sets:
                own = np.concatenate([sets[i - i % 3][rng.random(len(sets[i - i % 3])) < 0.95], own[:2]])
            sets.append(np.unique(own))
        ones, others = np.arange(0, 60, 2), np.arange(60)
        got = {(int(a), int(b)) for x, y in ngram_join.overlaps(sets, ones, others, 80) for a, b in zip(x, y, strict=True)}
        want = set()
        for a in ones.tolist():
            for b in others.tolist():
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    want.add((a, b))
        assert {p for p in got if p[0] != p[1]} == {p for p in want if p[0] != p[1]} and len(want) > 30


def test_ngram_links_messy(spark):
    clash = "doc_id long, text string, node string, key int, keys int, size int, n int, leader int, component string"
    text = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(1, text), (2, text.upper()), (2, "a b c"), (None, "A b c"), (None, None), (3, "")]
    df = spark.createDataFrame([(*r, *[None] * 7) for r in rows], clash)
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_links(df).collect())
    assert got == [(0, 0, None), (0, 1, 2), (1, 700, 1), (2, 1, 2), (2, 700, 1), (3, 0, 3)]
    assert ngram_join.ngram_links(df.limit(0)).count() == 0


def test_least_is_a_lower_bound():
    assert W.SOLID[ord("a")]
    for n in range(1, 300):
        need = int(ngram_join.least(np.array([n]), 80)[0])
        assert need == -(-80 * n // 100) and 10 * need >= 8 * n
