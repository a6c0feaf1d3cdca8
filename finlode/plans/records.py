"""Record-keeping and disclosure queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import state_hash, verdict_bucket
from ..operators import governance, references, routing, sections
from ..sources import readers, tables
from .analysis import _as_of
from .retrieval import table


def latest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, as the live version of a session that events upsert."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("updated_at"), "event_id", "event_type")
    return tables.latest(rows).select("id", "event_id", "event_type")


def insider_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of the last ten days as one kind of insider disclosure, by user."""
    rows = _as_of(table(spark, sf_dir, "events")).select(F.col("user_id").alias("ticker"), F.col("ts").alias("at"), F.col("event_type").alias("transaction_type"), "as_of")
    return governance.insider_trades(rows, F.col("as_of"), 10, "Purchase").groupBy("ticker").agg(F.count("*").alias("n"))


def holding_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and quarter as holdings: the last two quarters of each, with the shift."""
    quarter = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("ticker"), F.col("o_orderpriority").alias("category"), quarter.alias("quarter")).agg(F.count("*").cast("double").alias("pct"))
    return governance.holdings(rows, 2)


def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without a document and embeddings without a label: what foreign keys would refuse."""
    docs, labels, vectors = (table(spark, sf_dir, t) for t in ("documents", "labels", "embeddings"))
    a = references.orphans(labels.select("doc_id"), docs.select("doc_id"), "doc_id").select(F.lit("label").alias("kind"), "doc_id")
    b = references.orphans(vectors.select(F.col("vec_id").alias("doc_id")), labels.select("doc_id"), "doc_id").select(F.lit("embedding").alias("kind"), "doc_id")
    return a.unionByName(b)


def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of chunks through their sections' tables: orders as chunks, lines as tables, parts' brands as codes."""
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rank"), F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("section"))
    lines = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    n = references.parts_of(lines)
    placed = lines.repartition(n, "l_orderkey").join(table(spark, sf_dir, "orders").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = placed.select(F.col("o_custkey").alias("doc_id"), F.col("l_orderkey").alias("section"), key.alias("table_id"))
    links = lines.select(key.alias("table_id"), F.col("l_returnflag").alias("ref_code"), F.col("l_linestatus").alias("resolved_text"))
    found = references.looked_up(chunks, own, links, n)
    return found.groupBy("ref_code").agg(F.count("*").alias("n"))


def absolute_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as pages of a batch of ten from the order's first page on."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit(1).alias("batch"), F.col("l_linenumber").alias("page_number"))
    ranges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("batch"), (F.col("o_custkey") % 5 * 10 + 1).alias("page_start"))
    return readers.absolute_pages(pages, ranges).select("id", F.col("page_number").cast("long").alias("page_number"))


def table_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders numbered over each customer as tables of a document."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("doc_id"), F.col("l_orderkey").alias("section"), F.lit(1).alias("page_number"), F.col("l_linenumber").alias("pos"))
    return sections.table_index(rows).select("doc_id", "section", F.col("pos").cast("long").alias("pos"), F.col("table_index").cast("long").alias("table_index"))


def route_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the router's log holds of conversation turns, counted."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat_ws(" ", "text", F.when(F.col("turn") % 2 == 0, "eps")).alias("q"))
    log = routing.route_log(routing.routed(rows, "id", "q"), F.lit("2024-01-01").cast("timestamp"))
    return log.groupBy("tier", "confidence", "fallback").agg(F.count("*").alias("n"))


def page_json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties wrapped as page JSON in four shapes, and the pages that come out."""
    p, n = F.col("props"), F.col("event_id") % 4
    json = (
        F.when(n == 0, F.concat(F.lit('{"pages":['), p, F.lit(","), p, F.lit("]}"))).when(n == 1, F.concat(F.lit("["), p, F.lit("]"))).when(n == 2, F.concat(F.lit('{"7":'), p, F.lit("}"))).otherwise(p)
    )
    found = readers.flat_pages(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), json.alias("json")))
    return found.select("id", F.col("page_number").cast("long").alias("page_number"), F.try_variant_get("page", "$.k", "bigint").alias("k"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict buckets of parts' types with a word before, counted."""
    word = F.element_at(F.array(*(F.lit(x) for x in ("Strong Buy", "Sell", "Hold", "Bullish", "bearish"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(verdict_bucket(word).alias("verdict")).agg(F.count("*").alias("n"))


def state_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD5 of regions as state JSON."""
    return table(spark, sf_dir, "region").select("r_regionkey", state_hash(F.col("r_regionkey"), F.col("r_name")).alias("state_md5"))


QUERIES = {
    f.__name__: f
    for f in (latest_sessions, insider_disclosures, holding_shifts, orphan_rows, reference_lookup, absolute_pages, table_numbers, route_log, page_json_shapes, verdicts, state_hashes)
}

ORACLE_SQL = {
    "latest_sessions": "SELECT user_id AS id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "insider_disclosures": "SELECT user_id AS ticker, count(*) AS n FROM events, (SELECT max(ts) AS as_of FROM events) WHERE event_type = 'purchase' AND floor((floor(epoch(as_of)) - floor(epoch(ts))) / 86400) <= 10 GROUP BY 1",
    "holding_shifts": """
        WITH q AS (SELECT o_orderstatus AS ticker, o_orderpriority AS category, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*)::DOUBLE AS pct FROM orders GROUP BY 1, 2, 3)
        SELECT *, pct - lag(pct) OVER (PARTITION BY ticker, category ORDER BY quarter) AS shift FROM q QUALIFY row_number() OVER (PARTITION BY ticker, category ORDER BY quarter DESC) <= 2""",
    "orphan_rows": """
        SELECT 'label' AS kind, doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT 'embedding', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)""",
    "reference_lookup": "SELECT l_returnflag AS ref_code, count(DISTINCT o_custkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "absolute_pages": "SELECT l_orderkey AS id, (o_custkey % 5 * 10 + l_linenumber)::BIGINT AS page_number FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "table_numbers": """
        SELECT o_custkey AS doc_id, l_orderkey AS section, l_linenumber::BIGINT AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) - 1 AS table_index
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "route_log": r"""
        WITH q AS (SELECT concat_ws(' ', text, CASE WHEN turn % 2 = 0 THEN 'eps' END) AS q FROM conversations),
        g AS (SELECT CASE WHEN regexp_matches(q, '(?i)\bnote\s+\d+|\bschedule\s+[ivxlcdm]+\b') THEN 'T3' WHEN len(list_distinct(regexp_extract_all(q, '\b(20\d\d)\b', 1))) > 1 THEN 'T4' ELSE 'T2' END AS guess,
              len(list_filter(['balance sheet', 'profit and loss', 'p&l', 'eps', 'earnings per share', 'cash flow statement', 'total assets', 'total liabilities', 'net worth', 'shareholders equity',
              'revenue from operations', 'ebitda', 'net profit', 'pat', 'gross block', 'depreciation', 'retained earnings'], lambda x: contains(lower(q), x))) > 0 AS phrase FROM q)
        SELECT CASE WHEN guess = 'T2' AND phrase THEN 'T1' ELSE guess END AS tier, CASE WHEN guess = 'T2' THEN 50 ELSE 90 END::INTEGER AS confidence, guess = 'T2' AND phrase AS fallback, count(*) AS n FROM g GROUP BY 1, 2, 3""",
    "page_json_shapes": """
        WITH e AS (SELECT event_id AS id, (props::JSON->>'k')::BIGINT AS k FROM events)
        SELECT id, CASE WHEN id % 4 = 2 THEN 7 ELSE 1 END::BIGINT AS page_number, k FROM e UNION ALL SELECT id, 2, k FROM e WHERE id % 4 = 0""",
    "verdicts": "SELECT CASE p_partkey % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 3 THEN 'positive' ELSE 'negative' END AS verdict, count(*) AS n FROM part GROUP BY 1",
    "state_hashes": """SELECT r_regionkey, md5('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}') AS state_md5 FROM region""",
}
