"""Operators on small inputs with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from finlode.functions import filters, providers, scalars, vocab
from finlode.operators import chunking, feeds, normalize, references, report, resolve, routing, search, sections
from finlode.sources import readers, tables
from finlode.streaming import ingest


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("v")).first()[0]


def test_vocabulary_parts_are_whole():
    assert len(vocab.SECTION_TYPES) == 16 and len(vocab.STRUCTURED_TYPES) == 7 and len(vocab.NARRATIVE_TYPES) == 9
    assert sum(len(s) for s in vocab.AGENTS.values()) == 12


@pytest.mark.parametrize(("text", "want"), [("42.5", None), ("42", 42), (" -7 ", -7), ("", None), ("x", None)])
def test_to_int(spark, text, want):
    assert one(spark, scalars.to_int(F.col("c")), c=text) == want


def test_dates_and_headlines(spark):
    assert one(spark, scalars.parse_date(F.col("c")), c="05-Jan-2024 10:30:00") == dt.datetime(2024, 1, 5, 10, 30)
    assert one(spark, scalars.parse_date(F.col("c")), c="soon") is None
    assert one(spark, scalars.feed_date(F.col("c")), c="Tue, 02 Jan 2024 10:00:00 GMT") == dt.datetime(2024, 1, 2, 10)
    head, source = scalars.headline(F.col("c"))
    assert (one(spark, head, c="a - b - c"), one(spark, source, c="a - b - c")) == ("a - b", "c")


def test_answers_and_trimming(spark):
    fenced = '```json\n{"tier": "T1"}\n```'
    assert one(spark, F.try_variant_get(scalars.answer_json(F.col("c")), "$.tier", "string"), c=fenced) == "T1"
    assert one(spark, F.try_variant_get(scalars.answer_json(F.col("c")), "$.a", "int"), c='so {"a": 3} it is') == 3
    assert one(spark, scalars.sentence_trim(F.col("c")), c="One two three. Four five. Six") == "One two three. Four five."
    assert one(spark, scalars.sentence_trim(F.col("c")), c="no end here") == "no end here"
    assert one(spark, scalars.summary(F.col("c"), 5), c="abcdefgh") == "abcde..."


def test_filters(spark):
    rows = spark.createDataFrame([("ACME_LTD", 2020), ("acme ltd", 2021), ("Other", 2021)], "company_id string, fiscal_year int")
    assert rows.where(filters.MetadataFilter(company_id="acme ltd").column()).count() == 2
    both = filters.MetadataFilter(fiscal_year=2020, fiscal_years=(2021,))
    assert rows.where(both.column()).count() == 0 and rows.where(both.column(year_first=True)).count() == 1
    assert rows.where(filters.MetadataFilter().column()).count() == 3


def test_look_back_floors_days(spark):
    now = dt.datetime(2024, 1, 31, 12)
    rows = spark.createDataFrame([(1, now - dt.timedelta(days=5, hours=23)), (2, now - dt.timedelta(days=6)), (3, None)], "i int, at timestamp")
    assert sorted(r[0] for r in rows.where(filters.within_days(F.col("at"), F.lit(now), 5)).collect()) == [1, 3]
    assert sorted(r[0] for r in rows.where(filters.not_before(F.col("at"), F.lit(now), 5)).collect()) == [3]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, " ".join(["A sentence of five words."] * 50)), (2, " short "), (3, " "), (4, None)], "doc_id int, text string")
    got = chunking.chunked(docs, "doc_id", "text", 100, 20).orderBy("id", "chunk_index").collect()
    first = [r for r in got if r["id"] == 1]
    assert len(first) == 3 and [r["chunk_index"] for r in first] == [0, 1, 2] and first[0]["chunk_text"].endswith("words.")
    assert [r["chunk_text"] for r in got if r["id"] == 2] == [" short "] and {r["id"] for r in got} == {1, 2}
    tail = chunking.chunked(spark.createDataFrame([(1, " ".join(map(str, range(940))))], "doc_id int, text string"), "doc_id", "text", tail=True, trim=False)
    assert [r["n_tokens"] for r in tail.orderBy("chunk_index").collect()] == [512, 492, 44]


def test_page_ranges(spark):
    pages = spark.createDataFrame([("a", 10), ("b", 11)], "id string, total_pages int")
    got = {(r[0], r[1], r[2]) for r in chunking.page_ranges(pages).collect()}
    assert got == {("a", 1, 10), ("b", 1, 10), ("b", 11, 11)}
    with pytest.raises(Exception, match="no pages"):
        chunking.page_ranges(spark.createDataFrame([("c", 0)], "id string, total_pages int")).collect()


def test_json_tables(spark):
    page = '{"content":{"elements":[{"type":"table","table_data":{"headers":[["A","B","C"]],"rows":[[{"text":"1"},2,"x (1)"],["y","See Note 2",null]]}}]}}'
    row = normalize.json_blocks(spark.createDataFrame([(1, page)], "page_number int, json string")).first()
    assert (row["block_type"], row["headers"], row["rows"][0]) == ("table", [["A", "B", "C"]], ["1", "2", "x (1)"])
    assert row["table_text"].split("\n")[1] == "-" * 40
    marks = spark.createDataFrame([(["x (1)", "See Note 2", "**"],)], "c array<string>").select(normalize.footnotes(F.col("c"))).first()[0]
    assert marks == ["**", "1", "2"]


def test_sections_merge(spark):
    blocks = [(1, 1, i, k, lv, f"t{i}") for i, (k, lv) in enumerate([("heading", 1), ("text", None), ("text", None), ("heading", 2), ("text", None), ("heading", 1), ("text", None), ("text", None)])]
    df = spark.createDataFrame(blocks, "doc_id int, page_number int, pos int, block_type string, heading_level int, content_text string")
    got = [r["section"] for r in sections.grouped(df).orderBy("pos").collect()]
    assert got == [0, 0, 0, 0, 0, 1, 1, 1]
    row = sections.section_rows(sections.grouped(df)).orderBy("section").first()
    assert row["headings"] == ["t0", "t3"] and row["content_markdown"].startswith("# t0\n\nt1")


def test_references_in_whole_words(spark):
    refs = spark.createDataFrame([("d", "Note 5")], "doc_id string, ref_code string")
    target = spark.createDataFrame([("d", 0, "note_to_accounts", ["Note 50"], [], "x"), ("d", 1, "note_to_accounts", ["Note 5"], [], "y")], "doc_id string, section int, section_type string, section_path array<string>, headings array<string>, content_markdown string")
    assert resolve.resolved(refs, target).first()["section"] == 0
    assert resolve.resolved(refs, target, whole_words=True).first()["section"] == 1


def test_fusion_and_rerank(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id int, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "id int, score double")
    got = search.fused(a, b).collect()
    assert [r["id"] for r in got] == [2, 1, 3] and abs(got[0]["score"] - (1 / 62 + 1 / 61)) < 1e-12
    assert search.reranked(a, -F.col("score"), 1).first()["id"] == 2
    assert search.keyword_top_k(a.withColumn("text", F.lit("x")), ()).count() == 0


def test_zero_and_missing_vectors_are_left_out(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "id int, embedding array<float>")
    got = search.dense_top_k(rows, [0.9, 0.0]).collect()
    assert [r["id"] for r in got] == [1, 2] and abs(got[0]["score"] - 1) < 1e-9


def test_routes(spark):
    q = spark.createDataFrame([(1, "Net profit of X"), (2, "see Note 5"), (3, "2019 to 2021"), (4, "hello"), (5, None)], "i int, q string")
    got = {r["id"]: r["tier"] for r in routing.routed(q, "i", "q").collect()}
    assert got == {1: "T1", 2: "T3", 3: "T4", 4: "T2", 5: "T2"}


def test_series(spark):
    s = spark.createDataFrame([("k", "1", 6.0), ("k", "2", 7.5), ("k", "3", 7.45), ("k", "4", None), ("k", "5", 5.0)], "k string, p string, v double")
    got = [r["trend"] for r in feeds.trend(s, "k", "p", "v").orderBy("p").collect()]
    assert got == [None, "Increasing", "Stable", "Decreasing"]
    log = spark.createDataFrame([("s", i, f) for i, f in enumerate([True, True, False, True, True, True, False])], "s string, i int, f boolean")
    runs = feeds.failure_runs(log, "s", ["i"], F.col("f"))
    assert [r["run"] for r in runs.orderBy("i").collect()] == [1, 2, 0, 1, 2, 3, 0] and feeds.breaker_open(runs, "s").first()["opened"]


def test_statement_page(spark):
    html = '<section id="profit-loss"><table><tr><th></th><th>2023</th></tr><tr><td><button>Sales +</button></td><td>26,385</td></tr><tr><td>Raw PDF</td><td>x</td></tr></table></section>'
    assert one(spark, feeds.statement_rows(F.col("c"), "profit-loss"), c=html) == [["", "2023"], ["Sales +", "26,385"]]
    assert one(spark, feeds.policy_rate(F.col("c"), "repo rate"), c="<tr><td>Policy Repo Rate</td><td>: 6.50%</td></tr>") == 6.5
    assert one(spark, feeds.blocked(F.col("c")), c="Just a moment...")


def test_sources(spark, tmp_path):
    assert one(spark, readers.page_number(F.col("c")), c="out_page_12_3.json") == 12
    pages = spark.createDataFrame([("a", '{"pages":[{"x":1},{"x":2}]}'), ("b", '{"3":{"x":1}}'), ("c", '{"x":1}'), ("d", "bad")], "id string, json string")
    assert sorted((r[0], r[1]) for r in readers.flat_pages(pages).collect()) == [("a", 1), ("a", 2), ("b", 3), ("c", 1)]
    (tmp_path / "job").mkdir()
    (tmp_path / "job" / "page_1.json").write_text('{"a":1}')
    (tmp_path / "job" / "page_1.md").write_text("# A\nb")
    (tmp_path / "job" / "page_2.html").write_text("<p>x</p>")
    got = readers.page_extracts(spark, f"file://{tmp_path}/job").orderBy("page_number").collect()
    assert [(r["page_number"], r["json"], r["html"], r["markdown"]) for r in got] == [(1, '{"a":1}', None, "# A\nb"), (2, None, "<p>x</p>", None)]
    series = readers.macro_series(spark.createDataFrame([("gdp", '[{"page":1},[{"date":"2023","value":7.5},{"date":"2022","value":null}]]')], "indicator string, json string"))
    assert sorted(map(tuple, series.collect())) == [("gdp", "2022", None), ("gdp", "2023", 7.5)]
    news = readers.announcements(spark.createDataFrame([("a", '{"data":[{"desc":"x","an_dt":"05-Jan-2024"}]}')], "id string, json string")).first()
    assert news["text"] == "x" and news["at"] == dt.datetime(2024, 1, 5)
    (tmp_path / "r.pdf").write_bytes(b"abc")
    assert readers.report_files(spark, f"file://{tmp_path}").first()["file_hash"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_tables(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    tables.initialised(spark, root)
    tables.initialised(spark, root)
    one_ = spark.createDataFrame([("s", "A", dt.datetime(2024, 1, 1)), ("s", "B", dt.datetime(2024, 1, 2))], "id string, last_query string, updated_at timestamp")
    tables.appended(one_, root, "sessions")
    assert tables.latest(tables.opened(spark, root, "sessions")).first()["last_query"] == "B"
    known = spark.createDataFrame([("h1", "completed"), ("h2", "failed")], "file_hash string, ingestion_status string")
    files = spark.createDataFrame([("h1",), ("h2",), ("h3",), ("h3",)], "file_hash string")
    assert sorted(r[0] for r in tables.new_files(files, known).collect()) == ["h2", "h3"]


def test_embeddings_retry_and_blanks(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in providers.embedded(texts, dim=8).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[2] == [0.0] * 8 and got[3] == [0.0] * 8


def test_patch_adds_paths_and_keeps_the_last(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, value string")
    changes = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (1, "c.d", "n")], "seq int, path string, value string")
    got = {r["path"]: (r["value"], r["changed"]) for r in report.patched(state, changes).collect()}
    assert got == {"a": (None, True), "b": ("2", False), "c.d": ("n", True)}


def test_stream_takes_what_landed(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string").write.parquet(f"{root}/in")
    stream = ingest.landed(spark, f"{root}/in", "id int, v string")
    ingest.ingested(stream, f"{root}/out", f"{root}/check", lambda b: b.withColumn("n", F.length("v")))
    assert spark.read.parquet(f"{root}/out").count() == 2


def test_stream_breaker(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([("a", i, i != 2) for i in range(6)], "source string, seq int, failed boolean").coalesce(1).write.parquet(f"{root}/calls")
    stream = ingest.breaker(ingest.landed(spark, f"{root}/calls", "source string, seq int, failed boolean"))
    query = stream.writeStream.format("memory").queryName("breaker_test").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT * FROM breaker_test").collect()] == [("a", 3, True)]


@pytest.fixture(scope="module")
def store(spark):
    from finlode.operators.retrieve import Store

    meta = "company_id string, report_type string, fiscal_year int, fiscal_quarter string"
    docs = [("d1", "ACME", "annual", 2023, None, "completed"), ("d2", "ACME", "annual", 2022, None, "completed"), ("d3", "ACME", "annual", 2023, None, "failed")]
    documents = spark.createDataFrame(docs, f"doc_id string, {meta}, ingestion_status string")
    kinds = [("n1", "d1", 0, "balance_sheet", "assets 10"), ("n2", "d1", 1, "mda", "words"), ("n3", "d2", 0, "balance_sheet", "assets 9"), ("n4", "d3", 0, "balance_sheet", "none")]
    nodes = spark.createDataFrame([(*k, "ACME", "annual", 2023, None) for k in kinds], f"id string, doc_id string, section int, section_type string, text string, {meta}")
    texts = [("c1", "d1", 1, "mda", "growth in margin"), ("c2", "d1", 2, "risk_factors", "credit risk grows"), ("c3", "d2", 1, "mda", "other things")]
    embed = providers.hash_embedder()
    chunks = spark.createDataFrame([(*t, "ACME", "annual", 2023, None, embed([t[4]])[0]) for t in texts], f"id string, doc_id string, section int, section_type string, text string, {meta}, embedding array<float>")
    tables_ = spark.createDataFrame([("t1", "d1", 0)], "table_id string, doc_id string, section int")
    links = spark.createDataFrame([("t1", "Note 5", "see this"), ("t1", "Note 5", "see this")], "table_id string, ref_code string, resolved_text string")
    return Store(documents, nodes, chunks, tables_, links)


def test_tree_needs_company_year_and_types(store):
    from finlode.operators import retrieve

    wanted = filters.MetadataFilter(company_id="acme", fiscal_year=2023, section_types=("balance_sheet",))
    rows = retrieve.retrieved(store, "total assets", wanted)
    assert [(r["id"], r["score_source"]) for r in rows.collect()] == [("n1", "tree")]
    kept, refs, used = retrieve.assembled(store, rows)
    assert (kept.count(), [r["ref_code"] for r in refs.collect()], used) == (1, ["Note 5"], 6)
    assert retrieve.retrieved(store, "total assets", filters.MetadataFilter(company_id="acme")).first()["score_source"] == "hybrid"


def test_tools_render(store):
    from finlode.operators import retrieve

    acme = filters.MetadataFilter(company_id="acme", fiscal_year=2023)
    assert retrieve.tool(store, "risk", "credit risk", acme) == "--- Section: risk_factors ---\ncredit risk grows"
    assert retrieve.tool(store, "financial_statements", "assets", acme).endswith("assets 10")
    assert retrieve.tool(store, "narrative", "x", filters.MetadataFilter(company_id="none")) == "no passages found"
    assert {r[0] for r in retrieve.sections_found(store, acme).collect()} == {"balance_sheet", "mda", "risk_factors"}


def test_governance(spark):
    from finlode.operators import governance

    now = dt.datetime(2024, 1, 31)
    trades = spark.createDataFrame([("T", now, "Buy"), ("T", now - dt.timedelta(days=100), "Buy"), ("T", now, "Sell")], "ticker string, at timestamp, transaction_type string")
    assert governance.insider_trades(trades, F.lit(now), 90, "buy").count() == 1 and governance.insider_trades(trades, F.lit(now)).count() == 2
    held = spark.createDataFrame([("T", "FII", f"2023Q{q}", float(q * q)) for q in (1, 2, 3)], "ticker string, category string, quarter string, pct double")
    assert [r["shift"] for r in governance.holdings(held, 2, "FII").orderBy("quarter").collect()] == [3.0, 5.0]
    saved_ = spark.createDataFrame([("s", True, '{"a":1}'), ("u", True, "bad"), ("v", False, "{}")], "id string, has_dashboard boolean, shared_state_json string")
    assert [governance.loaded(saved_, i).count() for i in "suv"] == [1, 0, 0]


def test_questions_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(30)], "id int, embedding array<float>")
    queries = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    whole, parts = (sorted(map(tuple, search.dense_batch(rows, queries, 3, block).collect())) for block in (1000, 7))
    assert whole == parts and len(whole) == 90


def test_questions_with_ties_over_many_batches(spark):
    """Equal vectors tie by id, whatever the batches and tasks they are in; vectors of zeros are nobody's neighbours."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(i, [float(i % 3), 1.0] if i % 10 else [0.0, 0.0]) for i in range(200)], "id int, embedding array<float>").repartition(3)
        queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 2.0])], "query_id int, vector array<float>")
        got = {q: [r["id"] for r in search.dense_batch(rows, queries, 4).where(F.col("query_id") == q).orderBy(F.desc("score"), "id").collect()] for q in (1, 2)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1: [1, 4, 7, 13], 2: [3, 6, 9, 12]}


def test_budget_by_ranges(spark):
    rows = spark.createDataFrame([(i % 2 and "a" or None, i, i % 5) for i in range(300)], "source string, doc_id long, n_chars int")
    got = {(r["source"], r["doc_id"], r["total"]) for r in search.within_budget(rows, "source", "doc_id", "n_chars", 60, 16).collect()}
    want = set()
    for source in ("a", None):
        total = 0
        for s, i, n in sorted(rows.collect(), key=lambda r: r[1]):
            if s == source and (total := total + n) <= 60:
                want.add((s, i, total))
    assert got == want


def test_matched_names_against_all_pairs(spark):
    from difflib import SequenceMatcher

    from finlode.operators.retrieve import matched_names

    known = ["Reliance Industries", "TCS", "Infosys", "HDFC Bank", "HDFC Life", "ab", "X"]
    asked = ["TCS", "tcs", "tcs.ns", "relianc industres", "hdfc", "infosis", "zzzz", "x", "", None, "HDFC Bnak"]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, given string")
    names = spark.createDataFrame([(k,) for k in [*known, None, "TCS"]], "name string")

    def pairs(x):
        return {f" {x} "[i : i + 2] for i in range(len(x) + 1)}

    def want(a):
        if a is None or a in known:
            return a
        if a.upper() in known:
            return a.upper()
        slug = a.lower().replace(".ns", "").strip()
        best = max(((SequenceMatcher(None, k.lower(), slug).ratio(), k.lower(), k) for k in known if pairs(k.lower()) & pairs(slug)), default=(0, "", ""))
        return best[2] if best[0] >= 0.3 else a

    assert {r["i"]: r["company"] for r in matched_names(rows, "given", names, "name").collect()} == {i: want(a) for i, a in enumerate(asked)}


def test_pages_in_every_table_shape(spark):
    """Tables as cells with places, lists of rows, objects, Markdown and HTML; nested merges, boxes, and pages that cannot be read."""
    table = lambda body: '{"blocks":[{"type":"table",%s}]}' % body
    pages = [
        (1, table('"cells":[{"row":0,"col":0,"value":"A"},{"row":0,"col":1,"text":"B"},{"row":2,"col":1,"value":3},{"row":2,"col":1,"value":4}]')),
        (2, table('"table_data":[["a","b"],[1,null]]')),
        (3, table('"text":"| A | B |\\n|---|---|\\n| 1 | 2 |"')),
        (4, table('"text":"<table><tr><th>A</th></tr><tr><td>1</td></tr></table>"')),
        (5, table('"rows":[{"b":"2","a":"1"}],"merges":[{"r1":0,"r2":1,"value":"m"}],"bbox":[1,2],"confidence":0.5,"table_html":"<t>"')),
        (6, table('"text":"nothing"')),
        (7, "not json"),
        (8, None),
    ]
    rows = spark.createDataFrame([(n, j, "<p>p</p>" if n == 7 else None, None) for n, j in pages], "page_number int, json string, html string, markdown string")
    got = {r["page_number"]: r for r in normalize.page_blocks(rows).collect()}
    shapes = {n: (r["headers"], r["rows"]) for n, r in got.items() if r["block_type"] == "table"}
    assert shapes == {1: ([["A", "B"]], [["", ""], ["", "4"]]), 2: ([], [["a", "b"], ["1", ""]]), 3: ([["A", "B"]], [["1", "2"]]), 4: ([["A"]], [["1"]]), 5: ([], [["1", "2"]])}
    five = got[5]
    assert (five["bounding_box"], five["confidence"], five["table_html"], five["merged"][0]["value"], five["num_columns"], five["num_rows"]) == ("[1,2]", 0.5, "<t>", "m", 2, 1)
    kept = {r["page_number"]: (r["source"], r["bad_json"]) for r in normalize.normalized(rows).collect()}
    assert kept[6] == ("empty", False) and kept[7] == ("html", True) and kept[8] == ("empty", False) and len(kept) == 8


def test_ingestion_in_one_call(spark):
    from finlode.operators.ingest import ingested

    texts = ["# Risk factors\n\nRisks are many. " + "word " * 700, "# Note 5\n\nThe text of a note\n\nmore\n\nand more", "| A | B |\n|---|---|\n| See Note 5 | 2 |"]
    pages = spark.createDataFrame([(d, n, "", "", t) for d in (1, 2) for n, t in enumerate(texts)], "doc_id int, page_number int, json string, html string, markdown string")
    about = spark.createDataFrame([(1, "acme", "annual", 2024, ""), (2, "beta", "quarterly", 2023, "Q2")], "doc_id int, company string, report_type string, fiscal_year int, fiscal_quarter string")
    made = ingested(pages, about)
    sections_ = made["sections"].orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["section_type"], r["page_start"], r["page_end"]) for r in sections_] == [(d, k, a, b) for d in (1, 2) for k, a, b in (("risk_factors", 0, 0), ("note_to_accounts", 1, 2))]
    assert [r["table_id"] for r in made["tables"].orderBy("doc_id").collect()] == ["1/0", "2/0"]
    chunks = made["chunks"].orderBy("doc_id", "chunk_index").collect()
    assert chunks and all(r["full_text"].startswith(r["metadata_prefix"] + "\n\n") for r in chunks) and chunks[0]["metadata_prefix"].startswith("[acme | Annual Report 2024 | ")
    assert {(r["doc_id"], r["ref_code"]) for r in made["refs"].collect()} == {(1, "Note 5"), (2, "Note 5")}
    assert made["nodes"].where("depth = 0").count() == 2


def test_texts_of_patches_and_covers(spark):
    changes = spark.createDataFrame([("b.c",), ("a",)], "path string")
    assert report.patch_text(changes, "Done.").first()["text"] == "## Update Applied\nDone.\n\n**Changed fields:**\n- `a`\n- `b.c`\n"
    assert spark.range(1).select(report.clarification(F.array(F.lit("x"), F.lit("y")))).first()[0].endswith("- x\n- y")
    row = spark.range(1).select(routing.cover_page(F.lit("Report q3 of 2021")).alias("c"), search.index_terms(F.lit("The café of Ünal and the 2 dogs")).alias("t")).first()
    assert tuple(row["c"]) == (2021, "Q3", "quarterly") and row["t"] == ["café", "ünal", "2", "dogs"]


def test_feed_texts_are_read_once_by_all_tasks(spark):
    from finlode.plans import ingestion

    plan = ingestion.xml_items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("item/title") == 1 and "RepartitionByExpression" in plan


def test_pages_are_read_one_by_one(spark):
    """Blocks of a page need no other page: nothing is shuffled or sorted, and pages with the same number stay apart."""
    page = '{"blocks":[{"type":"table","cells":[{"row":1,"col":1,"value":"x"}]}],"tables":[{"rows":[[1]]}]}'
    rows = spark.createDataFrame([(1, page, "", ""), (1, page, "", ""), (2, "", "", "# A\n# B\nc\n\nd")], "page_number int, json string, html string, markdown string")
    found = normalize.normalized(rows)
    assert sorted(map(tuple, found.collect())) == [(1, "json", 1, False), (1, "json", 1, False), (2, "markdown", 4, False)]
    for df in (found, normalize.page_blocks(rows), normalize.markdown_blocks(rows.select("page_number", "markdown"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Sort", "Window", "Aggregate"))


def test_references_are_dealt_by_rows(spark, monkeypatch):
    """Parts hold a number of rows, not of bytes, so what a task sorts does not grow with the tables."""
    from finlode.operators import references
    from finlode.plans import records

    chunks = spark.createDataFrame([(r, r % 3, r) for r in range(40)], "rank int, doc_id int, section int")
    tables = spark.createDataFrame([(s % 3, s, s * 10 + t) for s in range(40) for t in range(2)], "doc_id int, section int, table_id int")
    links = spark.createDataFrame([(i, f"Note {i % 4}", str(i)) for i in range(0, 400, 3)], "table_id int, ref_code string, resolved_text string")
    plain, dealt = (references.looked_up(chunks, tables, links, n) for n in (None, 7))
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect())) != []
    assert dealt.rdd.getNumPartitions() == 7
    monkeypatch.setattr(references, "ROWS", 500)
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    plan = records.reference_lookup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {-(-n // 500)}\n") >= 5
