"""Indexes against scans: the keyword index, its segments and plans, and tables of questions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from finlode.operators import postings, search, stems, vectors

WORDS = ["revenue", "growth", "debt", "the", "of", "Ümlaut", "ratio", "note", "cash", "flow"] + [f"w{i}" for i in range(80)]


def texts(n, seed=1):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(i, " ".join(rng.choices(WORDS, weights, k=rng.choice([0, 3, 10, 40, 200])))) for i in range(n)] + [(n, None), (n + 1, "")]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = texts(300)
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    postings.built(corpus[1].where("id < 200"), root, "a", block=16)
    postings.built(corpus[1].where("id >= 200"), root, "b", block=16)
    return root


def brute(rows, terms, k, every):
    """BM25 of all rows, as whole billionths."""
    found = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in rows}
    mean = sum(map(len, found.values())) / len(found)
    counts = {i: Counter(w) for i, w in found.items()}
    out = []
    for i, c in counts.items():
        have = [t for t in terms if c[t]]
        if have and (not every or len(have) == len(terms)):
            units = 0
            for t in have:
                df = sum(1 for o in counts.values() if o[t])
                idf = math.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
                units += round(idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(found[i]) / mean)) * 1e9)
            out.append((-units, i))
    return [(i, -u / 1e9) for u, i in sorted(out)[:k]]


@pytest.mark.parametrize("every", [True, False])
def test_single_questions(spark, corpus, index, every):
    opened = postings.opened(spark, index)
    for terms in (("revenue",), ("revenue", "growth"), ("the", "of", "w70"), ("ümlaut", "w3", "w4", "w5"), ("missing",), ("the", "missing"), ()):
        got = [(r["id"], r["score"]) for r in postings.top_k(opened, terms, 7, every).collect()]
        want = brute(corpus[0], terms, 7, every)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(got, want, strict=True))
        scan = [r["id"] for r in search.keyword_top_k(corpus[1], terms, 7, every).collect()]
        assert scan == [i for i, _ in got]


@pytest.mark.parametrize("every", [True, False])
def test_tables_of_questions(spark, corpus, index, every):
    rng = random.Random(2)
    asked = [(i, rng.sample([w.lower() for w in WORDS] + ["missing"], rng.choice([1, 2, 3, 6, 20]))) for i in range(60)]
    asked += [(100, asked[0][1][::-1]), (101, []), (102, ["missing"])]
    questions = spark.createDataFrame(asked, "query_id long, terms array<string>")
    got = {}
    for r in postings.answered(postings.opened(spark, index), questions, 4, every).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 7)))
    want = {q: [(i, round(s, 7)) for i, s in brute(corpus[0], terms, 4, every)] for q, terms in asked}
    assert got == {q: rows for q, rows in want.items() if rows}


def test_plan_reads_only_the_terms(spark, index):
    plan = postings.opened(spark, index).of(["revenue", "debt"]).postings._jdf.queryExecution().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line][0]
    assert "PartitionFilters" in scan and "bucket" in scan.split("PartitionFilters")[1] and re.search(r"PushedFilters: \[[^\]]*term", scan)
    files = postings.opened(spark, index).of(["revenue"]).postings.select(F.input_file_name()).distinct().collect()
    assert len({re.search(r"bucket=(\d+)", r[0])[1] for r in files}) == 1


def test_appending_leaves_segments_alone(spark, corpus, tmp_path):
    import os

    def files():
        return {f: os.path.getmtime(f) for d, _, names in os.walk(tmp_path) for f in (os.path.join(d, n) for n in names)}

    root = str(tmp_path)
    postings.built(corpus[1].where("id < 250"), root, "a", block=16)
    first = files()
    postings.built(corpus[1].where("id >= 250"), root, "b", block=16)
    assert {f: t for f, t in files().items() if f in first} == first
    postings.built(corpus[1].where("id >= 250"), root, "b", block=16)  # a batch that is tried again
    opened = postings.opened(spark, root)
    assert opened.collection().first()["all_docs"] == len(corpus[0])
    assert [r["id"] for r in postings.top_k(opened, ("the", "of"), 9).collect()] == [i for i, _ in brute(corpus[0], ("the", "of"), 9, True)]


def test_merging_segments(spark, corpus, index, tmp_path):
    root = str(tmp_path)
    postings.merged(postings.opened(spark, index), root, "all")
    one = postings.opened(spark, root)
    assert one.postings.select("segment").distinct().count() == 1
    for every in (True, False):
        a, b = (postings.top_k(x, ("revenue", "w9"), 9, every).collect() for x in (one, postings.opened(spark, index)))
        assert a == b and a


def test_empty_index(spark, corpus, tmp_path):
    postings.built(corpus[1].limit(0), str(tmp_path), "a")
    postings.built(corpus[1].limit(0), str(tmp_path), "b")
    opened = postings.opened(spark, str(tmp_path))
    assert postings.top_k(opened, ("a",), 5).count() == 0
    assert opened.collection().first()["all_docs"] == 0


# ---- vectors

def vector_rows(spark, matrix, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(matrix)], "id long, embedding array<float>")


def exact_answers(matrix, queries, k):
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)
    rows = np.flatnonzero(np.linalg.norm(matrix, axis=1) > 0)
    out = {}
    for q, vector in queries:
        scores = np.round(unit[rows] @ (vector / np.linalg.norm(vector)), 12)
        out[q] = [(int(rows[i])) for i in np.lexsort((rows, -scores))[:k]]
    return out


def ids_by_question(df):
    out = {}
    for r in df.orderBy("query_id", F.desc("score"), "id").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_recall_with_few_vectors(spark, tmp_path):
    """At 2000 vectors without any clusters: recall at 10 of 0.9 or more from a sixteenth of the bytes and a twentieth of the vectors."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "id")
    model = vectors.fitted(rows)
    vectors.stored(spark, model, str(tmp_path))
    vectors.built(rows, str(tmp_path), "a", model)
    index = vectors.opened(spark, str(tmp_path))
    assert np.allclose(index.model.centres, model.centres) and np.allclose(index.model.step, model.step)
    asked = rows.where("id % 40 = 1").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    want = ids_by_question(search.dense_batch(rows.select("id", "embedding"), asked, 10))
    got = ids_by_question(vectors.nearest(index, asked, 10))
    shared = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert shared >= 0.9 * sum(map(len, want.values())) and 10 * 10 <= 0.1 * 2000
    assert index.codes.agg(F.max(F.length("code"))).first()[0] * 16 <= 64 * 4 + 16


def test_cells_are_enough_where_vectors_cluster(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    matrix = centres[rng.integers(0, 40, 1500)] + 0.2 * rng.normal(size=(1500, 32))
    rows = vector_rows(spark, matrix)
    model = vectors.fitted(rows, cells=40, bits=4)
    vectors.stored(spark, model, str(tmp_path))
    vectors.built(rows, str(tmp_path), "a", model)
    index = vectors.opened(spark, str(tmp_path))
    asked = rows.where("id < 40").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    want = exact_answers(matrix.astype(np.float32).astype(float), [(i, matrix[i].astype(np.float32).astype(float)) for i in range(40)], 10)
    got = ids_by_question(vectors.nearest(index, asked, 10, probes=3, refine=4))
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 400
    sizes = {r["cell"]: r["count"] for r in index.codes.groupBy("cell").count().collect()}
    assert 3 * max(sizes.values()) < 0.4 * 1500


def test_exact_answers_with_copies_and_zeros(spark, tmp_path, monkeypatch):
    """Equal vectors beyond the k smallest ids, zeros and missing vectors; tiles of a few rows and questions."""
    monkeypatch.setattr(vectors, "ROWS", 30)
    monkeypatch.setattr(vectors, "ASKED", 2)
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(200, 8)).astype(np.float32)
    matrix[50:150] = matrix[3]
    matrix[160:165] = 0
    rows = vector_rows(spark, matrix).unionByName(spark.createDataFrame([(900, None)], "id long, embedding array<float>"))
    model = vectors.fitted(rows, cells=5, bits=8)
    vectors.stored(spark, model, str(tmp_path))
    vectors.built(rows.where("id < 120"), str(tmp_path), "a", model)
    vectors.built(rows.where("id >= 120"), str(tmp_path), "b", model)
    vectors.built(rows.where("id >= 120"), str(tmp_path), "b", model)
    index = vectors.opened(spark, str(tmp_path))
    queries = [(1000 + i, matrix[i].astype(float)) for i in (3, 7, 20, 180)]
    asked = spark.createDataFrame([*((q, v.tolist()) for q, v in queries), (5, None), (6, [0.0] * 8)], "query_id long, vector array<double>")
    for k in (1, 4, 20):
        assert ids_by_question(vectors.nearest(index, asked, k, exact=True)) == exact_answers(matrix.astype(float), queries, k)


def test_empty_vector_index(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, embedding array<float>")
    model = vectors.fitted(rows)
    vectors.stored(spark, model, str(tmp_path))
    vectors.built(rows, str(tmp_path), "a", model)
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert vectors.nearest(vectors.opened(spark, str(tmp_path)), asked, 3).count() == 0


def test_fused_batch(spark):
    a = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.1)], "query_id long, id long, score double")
    b = spark.createDataFrame([(1, 11, 5.0), (1, 12, 4.0)], "query_id long, id long, score double")
    got = [(r["query_id"], r["id"], round(r["score"], 9)) for r in search.fused_batch(a, b, k=2).orderBy("query_id", F.desc("score"), "id").collect()]
    assert got == [(1, 11, round(1 / 62 + 1 / 61, 9)), (1, 10, round(1 / 61, 9)), (2, 10, round(1 / 61, 9))]


# ---- stems and gaps

#: Words with their stems, from the stemmer's public description.
STEMS = """
consign consign|consigned consign|consigning consign|consignment consign|consist consist|consisted consist|consistency consist|consistent consist
consistently consist|consisting consist|consists consist|consolation consol|consolations consol|consolatory consolatori|console consol|consoled consol
consoles consol|consolidate consolid|consolidated consolid|consolidating consolid|consoling consol|consolingly consol|consols consol|consonant conson
consort consort|consorted consort|consorting consort|conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci|conspirator conspir
conspirators conspir|conspire conspir|conspired conspir|conspiring conspir|constable constabl|constables constabl|constance constanc|constancy constanc
constant constant|knack knack|knackeries knackeri|knacks knack|knag knag|knave knave|knaves knave|knavish knavish|kneaded knead|kneading knead
knee knee|kneel kneel|kneeled kneel|kneeling kneel|kneels kneel|knees knee|knell knell|knelt knelt|knew knew|knick knick|knif knif|knife knife
knight knight|knightly knight|knights knight|knit knit|knits knit|knitted knit|knitting knit|knives knive|knob knob|knobs knob|knock knock
knocked knock|knocker knocker|knockers knocker|knocking knock|knocks knock|knopp knopp|knot knot|knots knot|generate generat|generates generat
generally general|general general|communication communic|community communiti|arsenal arsenal|caresses caress|ties tie|cries cri|gas gas|this this
gaps gap|kiwis kiwi|luxuriated luxuri|hopping hop|hoping hope|cry cri|by by|say say|skies sky|dying die|news news|inning inning|innings inning
proceed proceed|exceeding exceed|succeeds succeed|happy happi|relational relat|conditional condit|rational ration|valenci valenc|digitizer digit
vietnamization vietnam|predication predic|operator oper|feudalism feudal|hopefulness hope|callousness callous|formaliti formal|sensitiviti sensit
sensibiliti sensibl|triplicate triplic|formative format|formalize formal|electrical electr|goodness good|revival reviv|allowance allow|inference infer
airliner airlin|adjustable adjust|defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt
communism communism|activate activ|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll|revenue revenu
growth growth|reports report|significant signific|company compani|companies compani|hardware hardwar|sales sale|agreed agre|feed feed|yes yes
youth youth|boyish boyish|enjoy enjoy|fly fli|flying fli|sky sky|dog's dog|dogs' dog|boys' boy|argument argument|analogies analog|apology apolog
fully fulli|hopefully hope|carelessly careless|bed bed|shed shed|embed emb|bead bead|bee bee|owed owe|staying stay
"""


def test_stems_word_by_word(spark):
    rows = [tuple(x.split()) for x in STEMS.strip().replace("\n", "|").split("|")]
    rows += [("", ""), ("a", "a"), ("été", "été"), ("2024", "2024"), ("élections", "élection"), (None, None)]
    got = stems.stemmed(spark.createDataFrame(rows, "term string, want string")).collect()
    assert not [r for r in got if r["stem"] != r["want"]] and len(got) == len(rows)


def test_gap_ranks(spark, tmp_path):
    """Scores of pairs of places, of single terms and of terms too far apart, against the plain formula."""
    rows = [
        (1, "revenue growth"), (2, "growth of the revenues, and revenue growing"), (3, "revenue " + "x " * 150 + "growth"), (4, "growth growth growth"),
        (5, "the company reports significant revenue growth in Q4 due to AI hardware sales"), (6, "revenue x x growth x x revenue"), (7, None), (8, "revenue growth"),
    ]
    root = str(tmp_path)
    postings.built(spark.createDataFrame(rows, "id long, text string"), root, "a", analyse=postings.placed_terms, stems=True)
    index = postings.opened(spark, root)
    asked = spark.createDataFrame([(1, ["revenues", "growing"]), (2, ["growth"]), (3, ["the"]), (4, ["hardware", "sale", "ai"]), (5, ["revenue", "growth"]), (6, ["growth", "missing"])], "query_id long, terms array<string>")
    got = {}
    for r in postings.gap_ranked(index, postings.stemmed_questions(asked), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))

    def close(gaps):
        out = 1.0
        for d in gaps:
            out *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
        return 1 - out

    assert set(got) == {1, 2, 4, 5}
    want = {1: close([1]), 2: close([3, 5]), 3: 0.0, 5: close([1]), 6: close([3, 3]), 8: close([1])}
    assert [i for i, _ in got[5]] == [i for i, _ in sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))]
    assert all(abs(score - want[i]) < 1e-8 for i, score in got[5])
    assert [i for i, _ in got[1]] == [2] and abs(got[1][0][1] - close([3, 1])) < 1e-8
    assert dict(got[2])[4] == round((1 + 1 / 4 + 1 / 9) * 0.1 / 1.64493406685, 9)
    assert [i for i, _ in got[4]] == [5]


def test_lists_are_whole_and_blocks_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Each term has one list in a block, made of all its documents; long texts make more blocks; terms of one stem become one list."""
    monkeypatch.setattr(postings, "BLOCK_BYTES", 400)
    rows = [(i, "growth growing debt " * 4 + f"w{i % 3} the growths") for i in range(20)] + [(20, None), (21, "")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    for root, stems_too in ((str(tmp_path / "a"), False), (str(tmp_path / "b"), True)):
        postings.built(docs, root, "a", analyse=postings.placed_terms if stems_too else search.tokens, stems=stems_too)
        lists = postings.opened(spark, root).postings.collect()
        assert len({(r["term"], r["block"]) for r in lists}) == len(lists) and len({r["block"] for r in lists}) > 2
        got = {(r["term"], e["id"]): (e["length"], e["places"]) for r in lists for e in r["entries"]}
        want = {}
        for i, text in rows:
            words = re.findall(r"[^\W_]+", text or "")
            for place, w in enumerate(words):
                if not (stems_too and w == "the"):
                    want.setdefault(("growth" if stems_too and w == "growths" else "grow" if stems_too and w == "growing" else w, i), (len(words), []))[1].append(place)
        assert got == want
        for r in lists:
            sizes = [len(e["places"]) for e in r["entries"]]
            assert (r["docs"], r["n"], r["most"], r["shortest"]) == (len(sizes), sum(sizes), max(sizes), min(e["length"] for e in r["entries"]))
            assert [e["id"] for e in r["entries"]] == sorted(e["id"] for e in r["entries"])


def test_coarse_answers_are_completed(spark):
    """On sf0.1 codes of two bits miss an answer; the query has what its SQL has."""
    import duckdb

    from finlode.plans import indexed

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    want = con.execute(f"SELECT query_id, id, score FROM ({indexed.ORACLE_SQL['dense_index_topk']})").fetchall()
    got = indexed.dense_index_topk(spark, "/root/testdata/sf0.1").select("query_id", "id", "score").collect()
    assert sorted((q, i, round(s, 5)) for q, i, s in got) == sorted((q, i, round(s, 5)) for q, i, s in want)


# ---- tables of questions move answers, not pairs

def shuffled_rows(spark, run):
    """Rows that are written to shuffles while something runs, and its result."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    out = run()
    return total() - before, out


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Documents that all have the words of all questions."""
    root = str(tmp_path_factory.mktemp("alike"))
    rows = [(i, "revenue growth debt cash " * (1 + i % 3) + f"w{i % 7}") for i in range(600)]
    postings.built(spark.createDataFrame(rows, "id long, text string"), root, "a", block=64)
    questions = [(q, ["revenue", "growth", "debt", "cash", f"w{q % 7}", f"missing{q}"]) for q in range(300)]
    return rows, root, questions


def test_any_words_of_a_table_of_questions(spark, alike):
    """300 questions and 600 documents that all match make no 180,000 rows (F6)."""
    rows, root, questions = alike
    asked = spark.createDataFrame(questions, "query_id long, terms array<string>")
    n, got = shuffled_rows(spark, lambda: postings.answered(postings.opened(spark, root), asked, 3, every=False).collect())
    assert n < 20_000
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 7)))
    assert found == {q: [(i, round(s, 7)) for i, s in brute(rows, terms, 3, False)] for q, terms in questions}


def test_shelves_of_few_documents_and_cells(spark, alike, monkeypatch):
    """The same answers however documents are put on shelves and questions into passes."""
    from finlode.operators import shelves

    rows, root, questions = alike
    index = postings.opened(spark, root)
    asked = spark.createDataFrame(questions, "query_id long, terms array<string>")
    want = sorted(map(tuple, postings.answered(index, asked, 3, every=False).collect()))
    monkeypatch.setattr(postings, "ASKED", 70)
    assert sorted(map(tuple, postings.answered(index, asked, 3, every=False).collect())) == want
    blocks = [r.asDict() for r in index.blocks.collect()]
    terms = sorted({t for _, ts in questions for t in ts if not t.startswith("missing")})
    import pyarrow as pa

    for many, cells, pairs in ((1, 600, 7), (4, 1 << 21, 1 << 20), (99, 5000, 100)):
        monkeypatch.setattr(shelves, "CELLS", cells)
        monkeypatch.setattr(shelves, "PAIRS", pairs)
        df = {t: sum(t in text.split() for _, text in rows) for t in terms}
        idf = np.array([math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) for t in terms])
        own = [sorted((terms.index(t) for t in ts if t in df), key=lambda c: (idf[c], c)) for _, ts in questions]
        asked = shelves.Questions(pa.array([q for q, _ in questions]), pa.array(terms), idf, np.array(sum(own, [])), np.append(0, np.cumsum([len(x) for x in own])))
        best = shelves.Best(len(own), 3)
        for low in range(0, len(blocks), many):
            shelf = shelves.Shelf(blocks[low : low + many], asked)
            shelf.scored(asked, sum(b["n"] for b in blocks) / len(rows), 1.2, 0.75, postings.UNIT)
            shelves.any_terms(shelf, asked, best)
        assert {(q, int(i), s / 1e9) for (q, _), ids, scores in zip(questions, best.ids, best.score, strict=True) for i, s in zip(ids, scores, strict=True)} == {(q, i, s) for q, i, s, _ in want}


def test_all_words_of_a_table_of_questions(spark, alike):
    """The same with all words asked for, and with limits to facets (F1)."""
    rows, root, questions = alike
    index = postings.opened(spark, root)
    asked = [(q, terms[:-1], [None, ["a"], ["b", "c"], []][q % 4]) for q, terms in questions]
    table = spark.createDataFrame(asked, "query_id long, terms array<string>, kind array<string>")
    n, got = shuffled_rows(spark, lambda: postings.answered(index, table, 3).collect())
    assert n < 20_000
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 7)))
    assert found == {q: [(i, round(s, 7)) for i, s in brute(rows, terms, 3, True)] for q, terms, _ in asked}
    kinds = {i: "abcd"[i % 4] for i, _ in rows if i != 5}
    facts = spark.createDataFrame(list(kinds.items()), "id long, kind string")
    found = {}
    for r in postings.answered(index, table, 3, facts=facts).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    want = {q: [i for i, _ in brute(rows, terms, 999, True) if i in kinds and (kind is None or kinds[i] in kind)][:3] for q, terms, kind in asked}
    assert found == {q: ids for q, ids in want.items() if ids}


def test_near_words_of_a_table_of_questions(spark, tmp_path):
    """Places of all documents and questions are never rows (F2); scores by the plain formula."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["revenue", "growth", "debt", "x", "the"], k=rng.choice([5, 30, 300])))) for i in range(400)]
    postings.built(spark.createDataFrame(rows, "id long, text string"), str(tmp_path), "a", analyse=postings.placed_terms, block=50, stems=True, lists=False)
    index = postings.opened(spark, str(tmp_path), lists=False)
    asked = [(q, [["revenu", "growth"], ["debt"], ["revenu", "growth", "debt"]][q % 3] + ["x"] * (q % 2)) for q in range(200)]
    n, got = shuffled_rows(spark, lambda: postings.gap_ranked(index, spark.createDataFrame(asked, "query_id long, terms array<string>"), 4).collect())
    assert n < 8_000
    places = {i: {} for i, _ in rows}
    for i, text in rows:
        for at, w in enumerate(text.split()):
            places[i].setdefault("revenu" if w == "revenue" else w, []).append(at)

    def score(own, terms):
        if len(terms) == 1:
            return round(sum(1 / (i * i) for i in range(1, len(own[terms[0]]) + 1)) * 0.1 / 1.64493406685, 9)
        units = sum(int(postings.GAPS[abs(a - b)]) for i, x in enumerate(terms) for y in terms[:i] for a in own[x] for b in own[y] if abs(a - b) <= 100)
        return round(1 - math.exp(-units / 1e9), 9)

    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    best = {}
    for terms in {tuple(t) for _, t in asked}:
        best[terms] = [(i, -s) for s, i in sorted((-score(own, terms), i) for i, own in places.items() if all(t in own for t in terms))[:4]]
    assert found == {q: best[tuple(t)] for q, t in asked}


def test_a_word_has_the_stem_of_its_column(spark):
    """Blocks take stems of words one by one; they are those of the column (F8)."""
    rng = random.Random(5)
    ends = [*stems.SECOND, *stems.THIRD, *stems.FOURTH, "ed", "ing", "eed", "edly", "ingly", "s", "sses", "ies", "us", "y", "ly", "e", "ll", "'s", "'", ""]
    words = {"".join(rng.choices("aeiouybtlsnrgé'", k=rng.randint(0, 5))) + "".join(rng.choices(ends, k=rng.choice([0, 1, 2]))) for _ in range(20_000)}
    words |= {*stems.WHOLE, *stems.KEPT, "generously", "communism", "arsenals", "ölung", "2024"}
    got = stems.stemmed(spark.createDataFrame([(w,) for w in words], "term string")).collect()
    assert [r for r in got if r["stem"] != stems.stem_of(r["term"])] == []


def test_vectors_of_many_questions(spark, tmp_path, monkeypatch):
    """Questions are not copied for each cell, and those with one vector are answered once (F4)."""
    monkeypatch.setattr(vectors, "ROWS", 300)
    rng = np.random.default_rng(6)
    matrix = rng.normal(size=(900, 8)).astype(np.float32)
    rows = vector_rows(spark, matrix)
    model = vectors.fitted(rows, cells=30, bits=8)
    vectors.stored(spark, model, str(tmp_path))
    vectors.built(rows, str(tmp_path), "a", model)
    index = vectors.opened(spark, str(tmp_path))
    queries = [(q, matrix[q % 25].astype(float)) for q in range(500)]
    asked = spark.createDataFrame([(q, v.tolist()) for q, v in queries], "query_id long, vector array<double>")
    n, got = shuffled_rows(spark, lambda: vectors.nearest(index, asked, 4, exact=True).collect())
    assert n < 8_000
    found = {}
    for r in sorted(got, key=lambda r: (-r["score"], r["id"])):
        found.setdefault(r["query_id"], []).append(r["id"])
    assert found == exact_answers(matrix.astype(float), queries, 4)


def test_requests_meet_the_first_nodes_of_their_sections(spark):
    """400 requests that all fit 500 nodes make no 200,000 rows (F5); a document without its ingestion done has no nodes."""
    from finlode.operators import requests

    docs = [(i, "ab"[i % 2], 2019 + i % 2, "failed" if i % 5 == 0 else "completed") for i in range(500)]
    nodes = [(1000 - i, i, ["mda", "notes"][i // 2 % 2]) for i in range(500)]
    library = requests.Library(spark.createDataFrame(docs, "doc_id long, company_id string, fiscal_year int, ingestion_status string"), spark.createDataFrame(nodes, "id long, doc_id long, section_type string"), None, None, None)
    rows = [(q, ["a", "b"][: 1 + q % 2], ["2019", "2020"], [["mda"], ["mda", "notes", "mda"]][q // 2 % 2]) for q in range(400)]
    n, got = shuffled_rows(spark, lambda: requests.by_tree(library, spark.createDataFrame(rows, "query_id long, company_id array<string>, fiscal_year array<string>, section_type array<string>"), 3).collect())
    assert n < 25_000
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["id"])
    fits = lambda c, k: sorted(i for i, d, kind in nodes if docs[d][1] in c and kind in k and docs[d][3] == "completed")[:3]
    assert found == {q: fits(c, k) for q, c, _, k in rows}


def test_contexts_are_of_the_requests_answers(spark):
    """Contexts of requests by the tree, which no longer meet all nodes, against their texts (F3)."""
    from finlode.operators import requests

    docs = spark.createDataFrame([(i, "a", 2019, "completed") for i in range(40)], "doc_id long, company_id string, fiscal_year int, ingestion_status string")
    texts = [(100 + i, i, "mda", "w " * (1 + i % 4)) for i in range(40)]
    nodes = spark.createDataFrame(texts, "id long, doc_id long, section_type string, text string")
    rows = spark.createDataFrame([(q, ["a"], ["2019"], ["mda"]) for q in range(300)], "query_id long, company_id array<string>, fiscal_year array<string>, section_type array<string>")

    def kept():
        found = requests.by_tree(requests.Library(docs, nodes, None, None, None), rows, 5)
        return requests.contexts(found, nodes, F.size(search.tokens(F.col("text"))).cast("long"), 9).collect()

    n, got = shuffled_rows(spark, kept)
    assert n < 12_000
    assert sorted((r["query_id"], r["id"], r["total"]) for r in got) == sorted((q, 100 + i, t) for q in range(300) for i, t in enumerate([1, 3, 6]))
