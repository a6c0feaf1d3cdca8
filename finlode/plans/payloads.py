"""Queries over payloads as services deliver them (JSON, HTML, answers of models) and over disclosures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import not_before, ratio_subset
from ..functions.scalars import answer_json, clean_cell, currency, in_sync, mood_colour, row_label, to_int, valid_confidence, valid_member
from ..operators import feeds, governance, normalize, report, routing, sections
from ..sources import readers, tables
from .analysis import _as_of
from .retrieval import table


def announcement_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as exchange announcements in the three shapes that services use; every seventh date cannot be read."""
    at = F.when(F.col("event_id") % 7 == 0, F.lit("soon")).otherwise(F.date_format("ts", "dd-MMM-yyyy HH:mm:ss"))
    item = F.to_json(F.struct(F.col("event_type").alias("desc"), at.alias("an_dt")))
    n = F.col("event_id") % 3
    json = F.when(n == 0, F.format_string("[%s]", item)).when(n == 1, F.format_string('{"announcements":[%s,%s]}', item, item)).otherwise(F.format_string('{"data":[%s]}', item))
    found = readers.announcements(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), json.alias("json")))
    return found.select("id", F.col("pos").cast("long").alias("pos"), "text", F.unix_timestamp("at").alias("at"))


def macro_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of event types as a series service delivers them: a header, then rows, one of them without a value."""
    days = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("indicator"), F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").cast("double").alias("value"))
    row = F.to_json(F.struct("date", F.when(~F.col("date").endswith("-03"), F.col("value")).alias("value")))
    raw = days.groupBy("indicator").agg(F.concat(F.lit('[{"page":1},['), F.array_join(F.collect_list(row), ","), F.lit("]]")).alias("json"))
    return readers.macro_series(raw)


def ratio_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' figures as two periods of ratios, and the ratios of a family that were asked for."""
    period = lambda y: F.to_json(F.struct(F.lit(y).alias("date"), F.lit("FY").alias("period"), F.col("p_size").alias("currentRatio"), F.col("p_partkey").alias("quickRatio"), F.lit("x").alias("symbol")))
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ticker"), F.concat(F.lit("["), period("2024"), F.lit(","), period("2023"), F.lit("]")).alias("json"))
    kept = ratio_subset(F.col("ratios"), ("currentRatio", "quickRatio", "cashRatio"), ("currentRatio", "unknownRatio"))
    rows = readers.ratio_rows(raw).withColumn("kept", kept)
    return rows.select("ticker", F.col("pos").cast("long").alias("pos"), F.col("kept")["date"].alias("year"), to_int(F.col("kept")["currentRatio"]).alias("ratio"), F.size("kept").cast("long").alias("n"))


def policy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate in the first table row that names it, from pages made of parts' sizes; every fifth page does not name it."""
    label = F.when(F.col("p_partkey") % 5 == 0, "Reverse Rate").otherwise("Policy <b>Repo Rate</b>")
    html = F.concat(F.lit("<table><tr><td>Bank Rate</td><td>9.9%</td></tr><tr class='r'><td>"), label, F.lit("</td><td> : "), F.col("p_size").cast("string"), F.lit(".25 %</td></tr><tr><td>Repo Rate</td><td>1%</td></tr></table>"))
    return table(spark, sf_dir, "part").select("p_partkey", feeds.policy_rate(html, "repo rate").alias("rate"))


def suffix_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' profiles under their name or the name with an exchange's suffix, the first that has a price."""
    suppliers = table(spark, sf_dir, "supplier")
    listed = F.array(*(F.struct(F.concat("s_name", F.lit(s)).alias("candidate"), F.when(F.col("s_suppkey") % m != 0, F.col("s_acctbal")).alias("price")) for s, m in ((".NS", 2), (".BO", 3))))
    profiles = suppliers.select(F.inline(listed))
    tried = suppliers.select("s_suppkey", F.inline(feeds.suffix_candidates(F.col("s_name")))).withColumnRenamed("priority", "place")
    best = feeds.preferred(tried.join(profiles, "candidate"), ["s_suppkey"], F.col("place"), F.col("price").isNotNull())
    return best.select("s_suppkey", "candidate", "price", currency(F.col("candidate")).alias("currency"))


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a profit statement in pages made of orders: labels, and cells as numbers or text."""
    html = F.concat(
        F.lit('<section id="ratios"><table><tr><td>Other</td><td>1</td></tr></table></section><section id="profit-loss"><table class="t"><tr><th>Sales <span>+</span></th><td>'),
        F.format_string("%,d", F.col("o_orderkey")),
        F.lit("</td></tr><tr><th>OPM %</th><td>"),
        (F.col("o_orderkey") % 100).cast("string"),
        F.lit("%</td></tr><tr><td>Raw PDF</td><td>x</td></tr><tr><td>Tax</td><td> - </td></tr></table></section>"),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(feeds.statement_rows(html, "profit-loss")).alias("pos", "cells"))
    cell = clean_cell(F.col("cells")[1])
    return rows.select("o_orderkey", F.col("pos").cast("long").alias("pos"), row_label(F.col("cells")[0]).alias("label"), cell["num"].alias("num"), cell["txt"].alias("txt"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of models' fenced answers made of events: tiers outside of the known ones and confidences outside of 0 to 1 are mended."""
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.concat(F.lit('{"tier":"T'), (k % 6).cast("string"), F.lit('","confidence":'), F.when(k % 10 == 0, F.lit('"high"')).otherwise((k / 50.0).cast("string")), F.lit("}"))
    n = F.col("event_id") % 3
    answer = F.when(n == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 1, F.concat(F.lit("Here it is: "), body)).otherwise(body)
    found = table(spark, sf_dir, "events").select("event_id", answer_json(answer).alias("v"))
    tier = valid_member(F.try_variant_get("v", "$.tier", "string"), ("T1", "T2", "T3", "T4"), "T2")
    return found.select("event_id", tier.alias("tier"), F.round(valid_confidence(F.try_variant_get("v", "$.confidence", "string")), 4).alias("confidence"))


def footnote_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnote marks in cells made of suppliers."""
    k = F.col("s_suppkey")
    cells = F.array(F.concat(F.lit("Amount ("), (k % 5).cast("string"), F.lit(")")), F.concat(F.lit("See note "), (k % 7).cast("string")), F.concat(k.cast("string"), F.repeat(F.lit("*"), (k % 3).cast("int"))))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(normalize.footnotes(cells), " ").alias("marks"))


def heading_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section types by the words of headings made of nations, counted."""
    words = F.array(*(F.lit(w) for w in ("Consolidated Balance Sheet", "Cash Flow Statement", "Note 5: Leases", "Auditor's Report", "Management of", "Outlook for")))
    heading = F.concat(F.element_at(words, (F.col("n_nationkey") % 6 + 1).cast("int")), F.lit(" "), F.col("n_name"))
    return table(spark, sf_dir, "nation").groupBy(sections.valid_section(sections.classified(heading)).alias("section_type")).agg(F.count("*").alias("n"))


def ingestion_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per customer as per document: orders as pages, open ones as sections, lines as tables, returned ones as chunks, late ones as references."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("doc_id", "l_returnflag", "l_quantity")
    return report.ingestion_counts(orders, orders.where("o_orderstatus = 'O'"), lines, lines.where("l_returnflag = 'R'"), lines.where("l_quantity > 49"))


def unknown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of documents' texts that are not known from the first source; a failed one there does not block."""
    files = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("file_hash"), "doc_id", "source")
    known = files.where("doc_id % 2 = 0").select("file_hash", F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("completed").alias("ingestion_status"))
    return tables.new_files(files, known).select("file_hash")


def clarified_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans for suppliers: nothing runs where the confidence is low, and the resolved ticker is offered if nothing else is."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 10 / 10.0).alias("confidence"), F.when(k % 3 == 0, F.array("s_name", F.lit("other"))).alias("candidates"), (k % 2 == 0).alias("should_run"), "s_name")
    ask, offered = routing.clarified(F.col("confidence"), F.col("candidates"), F.col("s_name"))
    return governance.silenced(rows, ask).select("s_suppkey", "should_run", ask.alias("ask_back"), F.array_join(offered, ",").alias("offered"))


def stale_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of agents: how many are older than three days, by type."""
    rows = _as_of(table(spark, sf_dir, "events")).withColumn("finished_at", F.col("ts"))
    found = governance.stale(rows, F.col("as_of"), 72)
    return found.groupBy("event_type").agg(F.count_if("stale").alias("stale"), F.count("*").alias("n"))


def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events not before the same time five days ago, and every tenth, which has no time."""
    rows = _as_of(table(spark, sf_dir, "events")).withColumn("at", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    return rows.where(not_before(F.col("at"), F.col("as_of"), 5)).select("event_id")


def related_party_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as related-party transactions, those of more than 30 thousandths of their year's turnover by status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("ticker"), F.year("o_orderdate").alias("period"), "o_totalprice")
    total = orders.groupBy("ticker", "period").agg(F.sum("o_totalprice").alias("total"))
    rows = orders.join(total, ["ticker", "period"]).withColumn("pct", F.round(100 * F.col("o_totalprice") / F.col("total"), 6))
    return governance.related_parties(rows, 0.03).select("o_orderkey", "pct")


def flagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one of some keywords, by source."""
    rows = table(spark, sf_dir, "documents").select("source", "text")
    return governance.flagged(rows, ("license", "c++ (x)", "PASSWORD")).groupBy("source").agg(F.count("*").alias("n"))


def synced_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event types as hashes that a client sent, or did not send, against the one before, with a mood's colour."""
    sent = F.when(F.col("event_id") % 4 != 0, F.md5(F.col("event_type")))
    own = F.md5(F.when(F.col("event_id") % 3 == 0, F.lit("click")).otherwise(F.col("event_type")))
    mood = F.element_at(F.array(*(F.lit(m) for m in ("Positive", " Neutral ", "Negative", "Unsure"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(in_sync(sent, own).alias("synced"), mood_colour(mood).alias("colour"))
    return rows.groupBy("synced", "colour").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        announcement_payloads, macro_payloads, ratio_payloads, policy_rates, suffix_profiles, statement_lines, model_answers, footnote_marks, heading_types,
        ingestion_counters, unknown_files, clarified_plans, stale_results, recent_events, related_party_shares, flagged_documents, synced_states,
    )
}

ORACLE_SQL = {
    "announcement_payloads": """
        SELECT event_id AS id, p.pos, event_type AS text, CASE WHEN event_id % 7 <> 0 THEN floor(epoch(ts))::BIGINT END AS at
        FROM events JOIN (VALUES (0::BIGINT), (1)) AS p(pos) ON p.pos = 0 OR event_id % 3 = 1""",
    "macro_payloads": """
        SELECT event_type AS indicator, strftime(ts, '%Y-%m-%d') AS period, CASE WHEN day(min(ts)) <> 3 THEN count(*)::DOUBLE END AS value FROM events GROUP BY 1, 2""",
    "ratio_payloads": """
        SELECT p_partkey::VARCHAR AS ticker, p.pos, p.year, p_size::BIGINT AS ratio, 3::BIGINT AS n FROM part CROSS JOIN (VALUES (0::BIGINT, '2024'), (1, '2023')) AS p(pos, year)""",
    "policy_rates": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE p_size + 0.25 END::DOUBLE AS rate FROM part",
    "suffix_profiles": """
        SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 2 <> 0 THEN '.NS' ELSE '.BO' END AS candidate, s_acctbal AS price, 'INR' AS currency
        FROM supplier WHERE s_suppkey % 2 <> 0 OR s_suppkey % 3 <> 0""",
    "statement_lines": """
        SELECT o_orderkey, 0::BIGINT AS pos, 'Sales' AS label, o_orderkey::DOUBLE AS num, NULL::VARCHAR AS txt FROM orders
        UNION ALL SELECT o_orderkey, 1, 'OPM %', NULL, (o_orderkey % 100) || '%' FROM orders
        UNION ALL SELECT o_orderkey, 2, 'Tax', NULL, NULL FROM orders""",
    "model_answers": """
        WITH e AS (SELECT event_id, (props::JSON->>'k')::INTEGER AS k FROM events)
        SELECT event_id, CASE WHEN k % 6 BETWEEN 1 AND 4 THEN 'T' || (k % 6) ELSE 'T2' END AS tier,
               round(CASE WHEN k % 10 = 0 THEN 0.7 ELSE least(1.0, k / 50.0) END::DOUBLE, 4) AS confidence FROM e""",
    "footnote_marks": """
        WITH m AS (SELECT s_suppkey, unnest([(s_suppkey % 5)::VARCHAR, (s_suppkey % 7)::VARCHAR, repeat('*', s_suppkey % 3)]) AS mark FROM supplier)
        SELECT s_suppkey, string_agg(DISTINCT mark, ' ' ORDER BY mark) AS marks FROM m WHERE mark <> '' GROUP BY 1""",
    "heading_types": """
        SELECT CASE n_nationkey % 6 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'cash_flow' WHEN 2 THEN 'note_to_accounts' WHEN 3 THEN 'auditors_report' WHEN 4 THEN 'management_profile' ELSE 'other' END AS section_type,
               count(*) AS n FROM nation GROUP BY 1""",
    "ingestion_counters": """
        WITH p AS (SELECT o_custkey AS doc_id, count(*) AS pages, count_if(o_orderstatus = 'O')::BIGINT AS sections FROM orders GROUP BY 1),
        l AS (SELECT o_custkey AS doc_id, count(*) AS tables, count_if(l_returnflag = 'R')::BIGINT AS chunks, count_if(l_quantity > 49)::BIGINT AS refs
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT doc_id, pages, sections, coalesce(tables, 0) AS tables, coalesce(chunks, 0) AS chunks, coalesce(refs, 0) AS refs FROM p LEFT JOIN l USING (doc_id)""",
    "unknown_files": """
        SELECT DISTINCT sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL
        AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 2)""",
    "clarified_plans": """
        SELECT s_suppkey, s_suppkey % 2 = 0 AND s_suppkey % 10 >= 8 AS should_run, s_suppkey % 10 < 8 AS ask_back,
               CASE WHEN s_suppkey % 3 = 0 THEN s_name || ',other' ELSE s_name END AS offered FROM supplier""",
    "stale_results": """
        SELECT event_type, count_if((floor(epoch(as_of)) - floor(epoch(ts))) / 3600 > 72)::BIGINT AS stale, count(*) AS n
        FROM events, (SELECT max(ts) AS as_of FROM events) GROUP BY 1""",
    "recent_events": "SELECT event_id FROM events, (SELECT max(ts) AS as_of FROM events) WHERE event_id % 10 = 0 OR ts >= as_of - INTERVAL 5 DAY",
    "related_party_shares": """
        WITH t AS (SELECT o_orderkey, round(100 * o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderstatus, year(o_orderdate)), 6) AS pct FROM orders)
        SELECT o_orderkey, pct FROM t WHERE pct >= 0.03""",
    "flagged_documents": r"SELECT source, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i)license|c\+\+ \(x\)|PASSWORD') GROUP BY 1",
    "synced_states": """
        SELECT event_id % 4 = 0 OR event_id % 3 <> 0 OR event_type = 'click' AS synced, CASE event_id % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' WHEN 2 THEN 'red' END AS colour, count(*) AS n
        FROM events GROUP BY 1, 2""",
}
