"""Ingestion queries with their SQL: normalisation, sections, references, trees, deduplication."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_cell, first_filled, headline, parse_date, row_label, ticker_slug, to_double, to_int
from ..operators import feeds, ingest, normalize, references, report, resolve, sections
from ..sources import readers
from ..sources.scratch import scratch
from .retrieval import table

def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the source of texts in shapes that no table has: (k, key, status, priority)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders dealt out to all tasks before pages are made of them."""
    return _orders(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")


def _text(pattern: str) -> Column:
    """A text with {column} filled in from columns."""
    parts = [F.col(x[1:-1]).cast("string") if re.fullmatch(r"\{\w+\}", x) else F.lit(x) for x in re.split(r"(\{\w+\})", pattern) if x]
    return F.concat(*parts)


def dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by content hash: the first of each, and how many there are."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return rows.groupBy("file_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def hash_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose text is not a document yet."""
    known = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("h"))
    return items.join(known, "h", "left_anti").select("item_id", "h")


def html_text_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", normalize.html_text(F.col("html")).alias("text"))
    return rows.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", normalize.html_headings(F.col("html")).alias("h"), F.size(F.regexp_extract_all("html", F.lit("(?i)<p[ >]"), 0)).cast("long").alias("n_paragraphs"))
    return rows.select("page_id", F.size("h").cast("long").alias("n_headings"), F.try_element_at("h", F.lit(1))["text"].alias("first_heading"), "n_paragraphs")


def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables of pages, two in three of which have one."""
    with_table = _text("<h1>T</h1><table><tr><th>Key</th><th>{status}</th></tr><tr><td>{key}</td><td><b>{priority}</b></td></tr></table><p>tail</p>")
    pages = _orders(spark, sf_dir).select(F.col("k").alias("page_number"), F.when(F.col("k") % 3 != 0, with_table).otherwise("<p>no table</p>").alias("html"))
    lines = pages.select("page_number", F.explode(normalize.html_tables(F.col("html"))).alias("t")).select("page_number", F.posexplode("t").alias("row", "r"))
    return lines.select("page_number", F.col("row").cast("long").alias("row"), F.col("r.is_header").alias("is_header"), F.array_join("r.cells", "|").alias("cells"))


def md_table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = _text("# {status} part\n\nkey {key}\nmore\n\n| A | B |\n|---|---|\n| {key} | {priority} |\n## End\nend")
    blocks = normalize.markdown_blocks(_dealt(spark, sf_dir).select(F.col("k").alias("page_number"), page.alias("markdown")))
    cells = F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), ";")
    return blocks.select("page_number", F.col("block").cast("long").alias("block"), "block_type", F.coalesce("content_text", cells).alias("content"))


def cells_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as cells: a line's number is the row, its part's number modulo 4 the column; of one place the greatest value counts."""
    line, value = F.col("l_linenumber").cast("int"), F.concat("l_returnflag", "l_linestatus")
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), (line - 1).alias("row"), (F.col("l_partkey") % 4).cast("int").alias("col"), value.alias("value"), value.alias("pos")
    )
    return normalize.grid(cells, ["id"]).select("id", F.col("row").cast("long").alias("row"), F.array_join("line", "|").alias("line"))


#: Page JSON in the shapes that occur, by the order's key modulo 8.
JSON_SHAPES = (
    '{"blocks":[{"type":"heading","level":"h{level}","text":" {priority} "},{"type":"text","text":"{key}"},"bare"]}',
    '{"content":{"elements":[{"layout_tag":"Table","table_data":{"headers":[["A","B"]],"rows":[[{"text":"{key}"},2],{"cells":["{priority}",null]}]}}]}}',
    '{"blocks":[{"type":"table","cells":[{"row":0,"col":0,"value":"A"},{"row":0,"col":1,"text":"B"},{"row_index":2,"col_index":1,"value":{key}},{"r":1,"c":0,"value":"{priority}"}]}]}',
    '{"page":{"blocks":[{"block_type":"table","table_data":[["{key}","{priority}"],["x"]]}]}}',
    '{"blocks":[{"type":"table","text":"| A | B |\\n|---|---|\\n| {key} | {priority} |"}]}',
    '{"elements":[{"type":"table","text":"<table><tr><th>A</th></tr><tr><td>{key}</td></tr></table>"},{"type":"table","text":"nothing"}]}',
    '{"text":"{priority}"}',
    '{"blocks":[],"tables":[{"headers":["x"],"rows":[["{key}"]]}]}',
)


def _json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_number, json): a page of JSON for each order, some of which cannot be read."""
    rows = _dealt(spark, sf_dir).withColumn("level", F.col("k") % 9)
    page = F.lit("not json")
    for i, shape in enumerate(JSON_SHAPES):
        page = F.when(F.col("k") % 8 == i, _text(shape)).otherwise(page)
    return rows.select(F.col("k").alias("page_number"), F.when(F.col("k") % 11 != 0, page).otherwise("not json").alias("json"))


def json_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content blocks of page JSON in several shapes."""
    blocks = normalize.json_blocks(_json_pages(spark, sf_dir))
    return blocks.select("page_number", F.col("pos").cast("long").alias("pos"), "block_type", F.col("heading_level").cast("long").alias("heading_level"), F.coalesce("content_text", "table_text").alias("content"))


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page's blocks come from: JSON, else HTML, else Markdown; pages without any are kept."""
    html = F.when(F.col("page_number") % 2 == 0, "<p>text</p>").otherwise("")
    pages = _json_pages(spark, sf_dir).select("*", html.alias("html"), F.when(F.col("page_number") % 3 == 0, "# T").otherwise("").alias("markdown"))
    found = normalize.normalized(pages)
    return found.select("page_number", "source", F.col("n_blocks").cast("long").alias("n_blocks"), "bad_json")


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What whole documents of 40 pages give: pages, sections, tables, chunks and references of each."""
    number = F.col("page_number") % 40
    page = (
        F.when(number == 0, "# Risk factors\n\nOne text\n\n- two\n\nthree")
        .when(number == 1, "# Note 5\n\nOf the notes\n\nmore")
        .when(number % 5 == 2, "| A | B |\n|---|---|\n| See Note 5 | 2 |")
        .otherwise("plain text")
    )
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 1).alias("n"))
    pages = orders.select(F.floor(F.col("n") / 40).alias("doc_id"), (F.col("n") % 40).alias("page_number"))
    pages = pages.select("*", F.lit("").alias("json"), F.lit("").alias("html"), page.alias("markdown"))
    about = pages.select("doc_id").distinct().select("doc_id", F.lit("acme").alias("company"), F.lit("annual").alias("report_type"), F.lit(2024).alias("fiscal_year"), F.lit("").alias("fiscal_quarter"))

    def saved(df: DataFrame) -> DataFrame:
        path = scratch(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    made = ingest.ingested(pages, about, saved=saved)
    counts = report.ingestion_counts(pages, made["sections"], made["tables"], made["chunks"], made["refs"])
    return counts.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("pages", "sections", "tables", "chunks", "refs")))


def refs_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of one order's table with given codes."""
    found = references.extracted(_cells(spark, sf_dir)).select(F.col("table_id").alias("doc_id"), "ref_code", F.col("cell_pos").cast("long").alias("cell_pos"))
    return references.of_codes(found, "1", ("Note 1", "Schedule V", "#9"))


def manifest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as components with the values of a state, which has those of every third."""
    parts = table(spark, sf_dir, "part")
    path = F.concat(F.lit("parts."), F.col("p_partkey").cast("string"))
    state = parts.where("p_partkey % 3 = 0").select(path.alias("path"), F.col("p_name").alias("value"))
    return report.with_values(parts.select(F.col("p_partkey").alias("id"), path.alias("data_path")), state).select("id", "value")


def top_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and value pairs of the ratio lists of pages made of orders."""
    page = _text('<div><ul id="top-ratios"><li class="flex"><span class="name"> Key </span><span class="nowrap value"><span class="number">{key}</span> Cr.</span></li><li><span class="name">Status</span> <span class="value">{status}</span></li></ul><ul><li><span class="name">no</span></li></ul></div>')
    rows = _orders(spark, sf_dir).select("k", F.explode(normalize.top_ratios(page)).alias("name", "value"))
    return rows.select("k", "name", "value")


def json_prop_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy(value.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as blocks: a user's turn of an even number is a heading; sections of each conversation."""
    turn = F.col("turn")
    blocks = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_number"), turn.alias("pos"),
        F.when((turn % 3 == 0) | (turn % 5 == 1), "heading").otherwise("text").alias("block_type"), F.when(turn % 3 == 0, 1).when(turn % 5 == 1, 2).alias("heading_level"),
    )
    return sections.grouped(blocks).select("doc_id", F.col("pos").alias("turn"), F.col("section").cast("long").alias("section"))


def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents whose lines are blocks: every tenth line is a heading."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content_text"))
    head = F.col("pos") % 10 == 0
    blocks = lines.select("doc_id", F.lit(1).alias("page_number"), "pos", F.when(head, "heading").otherwise("text").alias("block_type"), F.when(head, 2).alias("heading_level"), "content_text")
    found = sections.section_rows(sections.grouped(blocks))
    return found.select("doc_id", F.col("section").cast("long").alias("section"), "n_blocks", F.size("headings").cast("long").alias("n_headings"), F.md5("content_markdown").alias("markdown_md5"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, cell_pos, cell): cells of a table for each order."""
    rows = _orders(spark, sf_dir).select("key", (F.col("k") % 7).alias("a"), (F.col("k") % 5).alias("b"), (F.col("k") % 3 + 1).alias("m"))
    cells = F.array(_text("Note {a}"), _text("({m})"), F.lit("Refer Schedule V"), _text("See Note {b}"), F.lit("as per note 3 #2"))
    return rows.select(F.col("key").alias("table_id"), F.posexplode(cells).alias("cell_pos", "cell"))


def ref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.extracted(_cells(spark, sf_dir)).select("table_id", "ref_code", F.col("cell_pos").cast("long").alias("cell_pos"))


def ref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each order's table, resolved in four sections of the same document."""
    found = references.extracted(_cells(spark, sf_dir)).select(F.col("table_id").alias("doc_id"), "ref_code")
    rows = _orders(spark, sf_dir).select("key", (F.col("k") % 7).alias("a"), (F.col("k") % 5).alias("b"))
    none = F.array().cast("array<string>")

    def section(n: int, kind: str, path: Column, headings: Column, text: str) -> Column:
        return F.struct(F.lit(n).alias("section"), F.lit(kind).alias("section_type"), path.alias("section_path"), headings.alias("headings"), F.lit(text).alias("content_markdown"))

    parts = F.array(
        section(0, "note_to_accounts", F.array(F.lit("Notes"), _text("Note {a}")), none, "text of a note"),
        section(1, "note_to_accounts", F.array(F.lit("Notes")), F.array(_text("About Note {b}")), "more"),
        section(2, "schedule", F.array(F.lit("Schedules")), none, "see schedule v here"),
        section(3, "note_to_accounts", F.array(F.lit("Notes")), none, "this is note 3 of many"),
    )
    target = rows.select(F.col("key").alias("doc_id"), F.inline(parts))
    return resolve.resolved(found, target).select("doc_id", "ref_code", F.col("section").cast("long").alias("section"), F.col("strategy").cast("long").alias("strategy"), "resolved_text")


def _region_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    leaf = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_name").alias("title"))
    return top.unionByName(leaf)


def tree_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.tree_paths(_region_tree(spark, sf_dir)).select("id", F.col("depth").cast("long").alias("depth"), "path")


def nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as nodes of two regions' documents."""
    documents = table(spark, sf_dir, "region").where("r_regionkey IN (1, 3)").select(F.col("r_regionkey").alias("doc_id"))
    kind = F.when(F.col("n_nationkey") % 2 == 0, "schedule").otherwise("other")
    nodes = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("node_id"), kind.alias("section_type"))
    return references.tree_chunks(documents, nodes, ("schedule",))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items per order status after the orders of one customer segment are gone."""
    gone = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linestatus")
    return references.without_documents(gone, lines)[0].groupBy("l_linestatus").agg(F.count("*").alias("n"))


def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with numbers in several forms, one for each customer."""
    shapes = ("{key}.5", "{key}", " {key} ", "", "-", "no {key}", "26,{low}", "{key}%", "-{key}")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0").alias("low"))
    cell = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        cell = F.when(F.col("c_custkey") % 10 == i, _text(shape) if shape else F.lit("")).otherwise(cell)
    rows = rows.withColumn("cell", cell)
    cell = clean_cell(F.col("cell"))
    return rows.select("c_custkey", to_double(F.trim("cell")).alias("as_double"), to_int(F.col("cell")).alias("as_int"), cell["num"].alias("num"), cell["txt"].alias("txt"))


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers, headlines, days and labels made of customers; every seventh has none."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0").alias("d"))
    given = lambda c: F.when(F.col("k") % 7 != 0, c)
    rows = rows.select(
        "k",
        given(F.when(F.col("k") % 2 == 0, _text("c{k}.NS")).otherwise(_text("c{k}"))).alias("ticker"),
        given(F.when(F.col("k") % 3 == 0, _text("No source {k}")).otherwise(_text("Profit {k} up - {segment} - Mint"))).alias("title"),
        given(F.when(F.col("k") % 5 == 0, F.lit("soon")).otherwise(_text("{d}-Jan-2024 10:30:00"))).alias("day"),
        given(_text("Sales {segment}  +")).alias("label"),
    )
    head, source = headline(F.col("title"))
    return rows.select("k", ticker_slug(F.col("ticker")).alias("slug"), head.alias("headline"), source.alias("source"), F.date_format(parse_date(F.col("day")), "yyyy-MM-dd").alias("day"), row_label(F.col("label")).alias("label"), first_filled(F.lit(""), F.col("ticker"), F.lit("none")).alias("filled"))


def xml_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an RSS document for each order."""
    xml = _text("<rss><channel><item><title>A {key} - {status}</title><link>http://x</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item><item><title>{priority}</title></item></channel></rss>")
    # a document takes far longer to read than its row, so rows are dealt out first
    orders = _dealt(spark, sf_dir)
    items = readers.feed_items(orders.select(F.col("key").alias("feed"), F.lit("https://h.example/rss").alias("url"), xml.alias("xml")))
    return items.select("feed", F.col("pos").cast("long").alias("pos"), "headline", "source", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


def prefer_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pages with the same number modulo 50 the one with the smallest id that is not blocked."""
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("slot"), "page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))
    return feeds.preferred(rows, ["slot"], F.col("page_id"), ~feeds.blocked(F.col("title")) & (F.col("page_id") % 7 != 0)).select("slot", "page_id")


QUERIES = {
    f.__name__: f
    for f in (
        dedup_hash, hash_anti_join, html_text_strip, page_headings, html_rows, md_table_parse, cells_to_grid, json_normalize, json_prop_extract, section_groups, section_rows, ref_extract,
        page_sources, ingest_counts, refs_by_code, manifest_values, top_ratios, ref_resolve, tree_recursive, nodes_by_type, cascade_delete, safe_casts, text_helpers, xml_items, prefer_first_source,
    )
}

ORACLE_SQL = {
    "page_sources": """
        SELECT o_orderkey AS page_number, CASE WHEN o_orderkey % 11 <> 0 THEN 'json' WHEN o_orderkey % 2 = 0 THEN 'html' WHEN o_orderkey % 3 = 0 THEN 'markdown' ELSE 'empty' END AS source,
               CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN 3 ELSE 1 END WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_blocks,
               o_orderkey % 11 = 0 AS bad_json FROM orders""",
    "refs_by_code": r"""
        SELECT key AS doc_id, code AS ref_code, min(pos) AS cell_pos FROM (
            SELECT key, pos, unnest(list_transform(regexp_extract_all(cell, '(?i)note\s+(\d+)', 1), lambda n: 'Note ' || n) || list_transform(regexp_extract_all(cell, '(?i)schedule\s+([IVXLCDM]+|[A-Z])\b', 1), lambda x: 'Schedule ' || upper(x))
                || regexp_extract_all(cell, '#\d{1,3}\b') || regexp_extract_all(cell, '\(\d{1,3}\)')) AS code
            FROM (SELECT o_orderkey::VARCHAR AS key, unnest(cells) AS cell, unnest(range(len(cells))) AS pos FROM (
                SELECT o_orderkey, ['Note ' || o_orderkey % 7, '(' || (o_orderkey % 3 + 1) || ')', 'Refer Schedule V', 'See Note ' || o_orderkey % 5, 'as per note 3 #2'] AS cells FROM orders)))
        WHERE key = '1' AND code IN ('Note 1', 'Schedule V', '#9') GROUP BY ALL""",
    "manifest_values": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS value FROM part",
    "top_ratios": """
        SELECT o_orderkey AS k, 'Key' AS name, o_orderkey || ' Cr.' AS value FROM orders UNION ALL SELECT o_orderkey, 'Status', o_orderstatus FROM orders""",
    "dedup_hash": "SELECT sha256(text) AS file_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
    "hash_anti_join": "SELECT item_id, sha256(text) AS h FROM benchmark WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents)",
    "html_text_strip": r"SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)",
    "page_headings": r"""
        SELECT page_id, len(h)::BIGINT AS n_headings, trim(regexp_replace(regexp_replace(h[1], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS first_heading, n_paragraphs
        FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS h, len(regexp_extract_all(html, '(?i)<p[ >]'))::BIGINT AS n_paragraphs FROM pages)""",
    "html_rows": r"""
        SELECT k AS page_number, 0::BIGINT AS "row", true AS is_header, 'Key|' || status AS cells FROM (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders) WHERE k % 3 <> 0
        UNION ALL SELECT k, 1, false, key || '|' || priority FROM (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders) WHERE k % 3 <> 0""",
    "md_table_parse": r"""
        SELECT k AS page_number, unnest(range(5)) AS block, unnest(['heading', 'text', 'table', 'heading', 'text']) AS block_type,
               unnest([status || ' part', 'key ' || key || chr(10) || 'more', 'A|B;' || key || '|' || priority, 'End', 'end']) AS content FROM (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders)""",
    "cells_to_grid": r"""
        WITH c AS (SELECT l_orderkey AS id, l_linenumber - 1 AS r, l_partkey % 4 AS c, max(l_returnflag || l_linestatus) AS v FROM lineitem GROUP BY 1, 2, 3),
        g AS (SELECT id, w, unnest(range(h + 1)) AS r FROM (SELECT id, max(r) AS h, max(c) AS w FROM c GROUP BY id)),
        x AS (SELECT id, r, unnest(range(w + 1)) AS c FROM g)
        SELECT x.id, x.r::BIGINT AS "row", string_agg(coalesce(v, ''), '|' ORDER BY x.c) AS line FROM x LEFT JOIN c ON c.id = x.id AND c.r = x.r AND c.c = x.c GROUP BY 1, 2""",
    "json_normalize": r"""
        WITH o AS (SELECT *, chr(10) || repeat('-', 40) || chr(10) AS bar, greatest(1, least(6, k % 9))::BIGINT AS level FROM (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders) WHERE k % 11 <> 0)
        SELECT k AS page_number, 0::BIGINT AS pos, 'heading' AS block_type, level AS heading_level, trim(priority) AS content FROM o WHERE k % 8 = 0
        UNION ALL SELECT k, 1, 'text', NULL, key FROM o WHERE k % 8 = 0
        UNION ALL SELECT k, 2, 'text', NULL, 'bare' FROM o WHERE k % 8 = 0
        UNION ALL SELECT k, 0, 'table', NULL, 'A | B' || bar || key || ' | 2' || chr(10) || priority || ' | ' FROM o WHERE k % 8 = 1
        UNION ALL SELECT k, 0, 'table', NULL, 'A | B' || bar || priority || ' | ' || chr(10) || ' | ' || key FROM o WHERE k % 8 = 2
        UNION ALL SELECT k, 0, 'table', NULL, key || ' | ' || priority || chr(10) || 'x' FROM o WHERE k % 8 = 3
        UNION ALL SELECT k, 0, 'table', NULL, 'A | B' || bar || key || ' | ' || priority FROM o WHERE k % 8 = 4
        UNION ALL SELECT k, 0, 'table', NULL, 'A' || bar || key FROM o WHERE k % 8 = 5
        UNION ALL SELECT k, 0, 'text', NULL, trim(priority) FROM o WHERE k % 8 = 6
        UNION ALL SELECT k, 0, 'table', NULL, 'x' || bar || key FROM o WHERE k % 8 = 7""",
    "json_prop_extract": "SELECT (props::JSON->>'k')::BIGINT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "section_groups": """
        WITH b AS (SELECT conv_id AS doc_id, turn, turn % 3 = 0 OR turn % 5 = 1 AS h FROM conversations),
        g AS (SELECT *, sum(CASE WHEN h AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY turn) AS grp FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS rn FROM b)),
        s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, grp) AS size, row_number() OVER (PARTITION BY doc_id, grp ORDER BY turn) AS k FROM g)
        SELECT doc_id, turn, (sum(CASE WHEN k = 1 AND (size >= 3 OR grp = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY turn) - 1)::BIGINT AS section FROM s""",
    "section_rows": """
        WITH l AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
        g AS (SELECT *, pos // 10 AS grp, count(*) OVER (PARTITION BY doc_id, pos // 10) AS size FROM l),
        s AS (SELECT doc_id, pos, pos % 10 = 0 AS h, CASE WHEN pos % 10 = 0 THEN '## ' || line ELSE line END AS line, CASE WHEN size < 3 AND grp > 0 THEN grp - 1 ELSE grp END AS section FROM g)
        SELECT doc_id, section::BIGINT AS section, count(*) AS n_blocks, count(*) FILTER (h) AS n_headings, md5(coalesce(string_agg(line, chr(10) || chr(10) ORDER BY pos) FILTER (line <> ''), '')) AS markdown_md5 FROM s GROUP BY doc_id, section""",
    "ref_extract": r"""
        SELECT key AS table_id, ref_code, min(cell_pos) AS cell_pos FROM (
            SELECT key, unnest(['Note ' || k % 7, '(' || k % 3 + 1 || ')', 'Schedule V', 'Note ' || k % 5, 'Note 3', '#2']) AS ref_code, unnest([0, 1, 2, 3, 4, 4])::BIGINT AS cell_pos FROM (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders)) GROUP BY 1, 2""",
    "ref_resolve": r"""
        WITH r AS (SELECT DISTINCT key, k % 7 AS a, k % 5 AS b, unnest([k % 7, k % 5, 3]) AS n FROM (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders))
        SELECT key AS doc_id, 'Note ' || n AS ref_code, CASE WHEN n = a THEN 0 WHEN n = b THEN 1 ELSE 3 END::BIGINT AS section, CASE WHEN n = a THEN 1 WHEN n = b THEN 2 ELSE 3 END::BIGINT AS strategy,
               CASE WHEN n = a THEN 'text of a note' WHEN n = b THEN 'more' ELSE 'this is note 3 of many' END AS resolved_text FROM r
        UNION ALL SELECT key, 'Schedule V', 2, 4, 'see schedule v here' FROM (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders)""",
    "tree_recursive": """
        WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation),
        w AS (SELECT id, 0::BIGINT AS depth, title AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, w.depth + 1, w.path || ' > ' || n.title FROM n JOIN w ON n.parent_id = w.id)
        SELECT id, depth, path FROM w""",
    "nodes_by_type": "SELECT r_regionkey AS doc_id, n_nationkey AS node_id, 1.0::DOUBLE AS score, 'tree' AS score_source FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3) AND n_nationkey % 2 = 0",
    "cascade_delete": "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0) GROUP BY 1",
    "safe_casts": r"""
        SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN c_custkey + 0.5 WHEN 1 THEN c_custkey WHEN 2 THEN c_custkey WHEN 8 THEN -c_custkey END::DOUBLE AS as_double,
               CASE c_custkey % 10 WHEN 1 THEN c_custkey WHEN 2 THEN c_custkey WHEN 8 THEN -c_custkey END::BIGINT AS as_int,
               CASE c_custkey % 10 WHEN 0 THEN c_custkey + 0.5 WHEN 1 THEN c_custkey WHEN 2 THEN c_custkey WHEN 6 THEN 26000 + c_custkey % 1000 WHEN 8 THEN -c_custkey END::DOUBLE AS num,
               CASE c_custkey % 10 WHEN 5 THEN 'no ' || c_custkey WHEN 7 THEN c_custkey || '%' END AS txt FROM customer""",
    "text_helpers": r"""
        SELECT k, CASE WHEN g THEN 'C' || k END AS slug, CASE WHEN g THEN CASE WHEN k % 3 = 0 THEN 'No source ' || k ELSE 'Profit ' || k || ' up - ' || segment END END AS headline,
               CASE WHEN g AND k % 3 <> 0 THEN 'Mint' END AS source, CASE WHEN g AND k % 5 <> 0 THEN '2024-01-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') END AS day,
               CASE WHEN g THEN 'Sales ' || segment END AS label, CASE WHEN NOT g THEN 'none' WHEN k % 2 = 0 THEN 'c' || k || '.NS' ELSE 'c' || k END AS filled
        FROM (SELECT c_custkey AS k, c_mktsegment AS segment, c_custkey % 7 <> 0 AS g FROM customer)""",
    "xml_items": r"""
        SELECT key AS feed, 0::BIGINT AS pos, 'A ' || key AS headline, status AS source, '2024-01-02 10:00:00' AS published FROM (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders)
        UNION ALL SELECT key, 1, priority, 'h.example', NULL FROM (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders)""",
    "prefer_first_source": """
        SELECT page_id % 50 AS slot, min(page_id) AS page_id FROM pages
        WHERE page_id % 7 <> 0 AND NOT regexp_matches(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '404|not found|just a moment|access denied|attention required') GROUP BY 1""",
}
