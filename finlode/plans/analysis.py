"""Feed, series, dashboard and plan queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import ratio_subset, within_days, without_nulls
from ..functions.scalars import band, colour, humanised, risk_colour, severity
from ..operators import feeds, report
from ..streaming.ingest import sessions, telemetry
from .retrieval import table


def _as_of(events: DataFrame) -> DataFrame:
    """Events with the time of the last one, as the moment of asking."""
    return events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("as_of"))))


def lookback_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at most five whole days old, by type; every tenth has no time and stays."""
    rows = _as_of(table(spark, sf_dir, "events")).withColumn("at", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    return rows.where(within_days(F.col("at"), F.col("as_of"), 5)).groupBy("event_type").agg(F.count("*").alias("n"))


def stop_at_first_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events, newest first but for a few out of order, up to the first more than nine days old."""
    rows = _as_of(table(spark, sf_dir, "events"))
    pos = F.unix_timestamp("as_of") - F.unix_timestamp("ts") + F.when(F.col("event_id") % 11 == 0, 200000).otherwise(0)
    rows = rows.withColumn("pos", F.struct(pos, "event_id"))
    kept = feeds.until_stale(rows, "user_id", "pos", "ts", F.col("as_of"), 9)
    return kept.select("event_id", "user_id")


def macro_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean values of event types by day, with the direction since the day before."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("period")).agg(F.round(F.avg("value"), 2).alias("value"))
    found = feeds.trend(days, "event_type", "period", "value")
    return found.select("event_type", "period", "value", "previous", "trend")


def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's longest run of error events, and whether it opens the breaker."""
    runs = feeds.failure_runs(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    longest = runs.groupBy("user_id").agg(F.max("run").cast("long").alias("longest"))
    return longest.join(feeds.breaker_open(runs, "user_id"), "user_id")


def pledge_qoq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' totals by status and quarter, with the change since the quarter before."""
    quarter = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("ticker"), quarter.alias("quarter")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    found = feeds.quarter_change(rows, "ticker", "quarter", "value")
    return found.select("ticker", "quarter", "value", F.round("change", 2).alias("change"))


def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances of nations: customers' if there are any, else suppliers'."""
    a = table(spark, sf_dir, "customer").where("c_nationkey % 4 != 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.max("c_acctbal"), 2).alias("balance"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.max("s_acctbal"), 2).alias("balance"))
    return feeds.with_fallback(a, b, ["k"], ["balance"])


def group_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source: how many, the newest ids first, and whether any is short."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.bool_or(F.col("n_chars") < 100).alias("any_short"), F.max("doc_id").alias("newest"))
    return rows


def completeness_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents as found tables, counted by completeness."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    label = feeds.completeness([F.col("quality"), F.nullif("toxic", F.lit(1)), F.nullif("lang", F.lit("en"))], F.lit(False))
    return rows.groupBy(label.alias("completeness")).agg(F.count("*").alias("n"))


def ratio_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known ratio over a range of part sizes: how many fall into each band."""
    rules = F.broadcast(spark.createDataFrame(report.RATIOS, "key string, label string, higher boolean, green double, yellow double"))

    rows = table(spark, sf_dir, "part").select((F.col("p_size") / 2.0).alias("value")).crossJoin(rules)
    status = band(F.col("value"), F.col("higher"), F.col("green"), F.col("yellow"))
    return rows.groupBy("key", status.alias("status")).agg(F.count("*").alias("n"))


def ratio_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requested ratios of a family, without nulls."""
    m = F.create_map(F.lit("date"), F.lit("2024"), F.lit("a"), F.col("p_size").cast("string"), F.lit("b"), F.when(F.col("p_size") % 2 == 0, "x"), F.lit("c"), F.lit("y"))
    kept = without_nulls(ratio_subset(m, ("a", "b", "d"), ("a", "b", "zz")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"))


def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst colour of each user's events."""
    status = F.when(F.col("event_type") == "error", "Red").when(F.col("event_type") == "purchase", "yellow").when(F.col("event_type") == "view", "green")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(colour(F.max(severity(status))).alias("status"))


def risk_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*(F.lit(x) for x in ("Low", "Medium", "Elevated", "High", "Critical"))), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(level.alias("level"), risk_colour(level).alias("status")).agg(F.count("*").alias("n"))


def humanised_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.floor(F.sum("o_totalprice")).cast("double").alias("total"))
    return rows.select("o_orderstatus", F.regexp_extract(humanised(F.col("total")), r"([BMK]?)$", 1).alias("unit"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of a plan for each customer: agents and helpers, some of them unknown."""
    k = F.col("c_custkey") % 4
    subs = F.when(k == 0, F.array(F.lit("dcf_modeller"), F.lit("nope"))).when(k == 1, F.array(F.lit("moat_scorer"))).when(k == 2, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    agents = F.array(*(F.lit(x) for x in ("quantitative", "qualitative", "mystery", "sentiment")))
    return table(spark, sf_dir, "customer").select(F.element_at(agents, (k + 1).cast("int")).alias("agent"), (k != 1).alias("should_run"), subs.alias("sub_agents"))


def plan_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.plan_warnings(_plan(spark, sf_dir))


def plan_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.plan_tasks(_plan(spark, sf_dir)).select("agent", F.array_join("sub_agents", ",").alias("sub_agents"))


def caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents' results by kinds of events: full where their number is even; two agents have none."""
    agent = F.when(F.col("event_type") == "view", "quantitative").when(F.col("event_type") == "error", "sentiment")
    rows = table(spark, sf_dir, "events").select(agent.alias("agent")).where("agent IS NOT NULL").groupBy("agent").agg(F.count("*").alias("n"))
    return report.caveats(rows.select("agent", F.when(F.col("n") % 2 == 0, "success").otherwise("partial").alias("status")))


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as companies, with ratios of their line items."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("company")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    return rows.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company"), F.col("s_nationkey").alias("nation")), "company")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard of every supplier: ratios from its line items, pillars from the ratios' colours, risks and mood by its nation."""
    rows = _figures(spark, sf_dir)
    part = lambda pos, name, value: F.struct(F.lit(pos).alias("pos"), name.alias("key"), value.cast("string").alias("value"))
    returned, open_ = F.col("returned") * 12 / F.col("n"), F.col("open") * 3 / F.col("n")
    ratios = rows.select("company", F.inline(F.array(
        part(0, F.lit("NIM_pct"), returned), part(1, F.lit("Gross_NPA_pct"), F.col("n") % 5), part(2, F.lit("Unknown"), F.lit(1)),
        part(3, F.lit("PE_Ratio"), F.when(F.col("company") % 3 == 0, "n/a").otherwise((F.col("n") % 50).cast("string"))), part(4, F.lit("Current_Ratio"), open_),
    )))
    status = band(returned, F.lit(True), F.lit(3.5), F.lit(2.8))
    metric = lambda pos, name, value: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("pillar"), value.alias("status"))
    metrics = rows.select("company", F.inline(F.array(
        metric(0, "Asset Quality", F.initcap(status)), metric(1, "Asset Quality", band(F.col("n") % 5, F.lit(False), F.lit(1), F.lit(3))), metric(2, "Growth", F.when(F.col("nation") % 4 > 0, "yellow")), metric(3, "Other", F.lit(None).cast("string")),
    )))
    levels = F.array(*(F.lit(x) for x in ("Low", " Medium", "Elevated", "High ", "Critical")))
    risk = lambda pos, name, value: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("risk"), value.alias("level"))
    risks = rows.where("nation % 6 != 0").select("company", F.inline(F.array(risk(0, "Credit/Market Risk", levels[(F.col("nation") % 5).cast("int")]), risk(1, "Liquidity", levels[(F.col("n") % 5).cast("int")]))))
    mood = F.element_at(F.array(*(F.lit(x) for x in ("Positive", " Neutral", "Negative", "mixed", None))), (F.col("nation") % 5 + 1).cast("int"))
    found = report.manifest(rows.select("company", mood.alias("mood")), ratios, metrics, risks)
    return found.select("company", "section_order", "section", "id", "component_type", "size", "data_path", "label", "status", "ord")


def state_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as a state, of which every fifth changes twice and some are new."""
    parts = table(spark, sf_dir, "part")
    path = F.concat(F.lit("parts."), F.col("p_partkey").cast("string"))
    state = parts.select(path.alias("path"), F.col("p_name").alias("value"))
    some = parts.where("p_partkey % 5 = 0")
    one = some.select(F.lit(1).alias("seq"), path.alias("path"), F.lit("first").alias("value"))
    two = some.select(F.lit(2).alias("seq"), path.alias("path"), F.col("p_brand").alias("value"))
    new = some.select(F.lit(1).alias("seq"), F.concat(path, F.lit(".extra")).alias("path"), F.lit("added").alias("value"))
    return report.patched(state, one.unionByName(two).unionByName(new))


def patch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as components, by brand as sections; some change as a whole, of others something below them."""
    path = F.concat(F.lit("parts."), F.col("p_partkey").cast("string"))
    parts = table(spark, sf_dir, "part")
    components = parts.select(F.col("p_brand").alias("section"), F.col("p_partkey").alias("id"), path.alias("data_path"))
    changes = parts.where("p_partkey % 70 = 0").select(path.alias("path")).unionByName(parts.where("p_partkey % 50 = 0").select(F.concat(path, F.lit(".extra.deep")).alias("path")))
    return report.patch_manifest(components, changes).select("section", "id", "highlight")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type: the telemetry window in batch form."""
    found = telemetry(table(spark, sf_dir, "events"), "ts", "1 hour")
    return found.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("mean", 6).alias("mean"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions with at most six hours between events: how many, and their events."""
    found = sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        lookback_filter, stop_at_first_stale, macro_trend, consecutive_failures, pledge_qoq, source_fallback, group_by_company, completeness_label, ratio_bands, ratio_keys, worst_status,
        risk_colours, humanised_totals, plan_validate, plan_tasks, caveats, manifest, state_patch, patch_manifest, event_windows, event_sessions,
    )
}

_BANDS = ", ".join(f"('{k}', {str(h).lower()}, {g}::DOUBLE, {y}::DOUBLE)" for k, _, h, g, y in report.RATIOS)

ORACLE_SQL = {
    "lookback_filter": "SELECT event_type, count(*) AS n FROM events, (SELECT max(ts) AS as_of FROM events) WHERE event_id % 10 = 0 OR floor((floor(epoch(as_of)) - floor(epoch(ts))) / 86400) <= 5 GROUP BY 1",
    "stop_at_first_stale": """
        WITH e AS (SELECT event_id, user_id, floor(epoch(as_of)) - floor(epoch(ts)) AS age, floor(epoch(as_of)) - floor(epoch(ts)) + CASE WHEN event_id % 11 = 0 THEN 200000 ELSE 0 END AS pos
                   FROM events, (SELECT max(ts) AS as_of FROM events)),
        w AS (SELECT *, max(CASE WHEN floor(age / 86400) > 9 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS ended FROM e)
        SELECT event_id, user_id FROM w WHERE ended = 0""",
    "macro_trend": """
        WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS period, round(avg(value), 2) AS value FROM events GROUP BY 1, 2),
        p AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY period) AS previous FROM d)
        SELECT *, CASE WHEN previous IS NULL THEN NULL WHEN value - previous > 0.1::DOUBLE THEN 'Increasing' WHEN value - previous < -0.1::DOUBLE THEN 'Decreasing' ELSE 'Stable' END AS trend FROM p""",
    "consecutive_failures": """
        WITH e AS (SELECT user_id, ts, event_id, (event_type = 'error')::INTEGER AS f FROM events),
        i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e),
        r AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM i)
        SELECT user_id, max(run)::BIGINT AS longest, max(run) >= 3 AS opened FROM r GROUP BY 1""",
    "pledge_qoq": """
        WITH q AS (SELECT o_orderstatus AS ticker, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)
        SELECT *, round(value - lag(value) OVER (PARTITION BY ticker ORDER BY quarter), 2) AS change FROM q""",
    "source_fallback": """
        WITH a AS (SELECT c_nationkey AS k, round(max(c_acctbal), 2) AS balance FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY 1), b AS (SELECT s_nationkey AS k, round(max(s_acctbal), 2) AS balance FROM supplier GROUP BY 1)
        SELECT coalesce(a.k, b.k) AS k, coalesce(a.balance, b.balance) AS balance, CASE WHEN a.k IS NOT NULL THEN 'primary' ELSE 'secondary' END AS source FROM a FULL JOIN b ON a.k = b.k""",
    "group_by_company": "SELECT source, count(*) AS n, bool_or(n_chars < 100) AS any_short, max(doc_id) AS newest FROM documents GROUP BY 1",
    "completeness_label": """
        SELECT CASE WHEN k = 3 THEN 'full' WHEN k > 0 THEN 'partial' ELSE 'failed' END AS completeness, count(*) AS n
        FROM (SELECT (quality IS NOT NULL)::INTEGER + (nullif(toxic, 1) IS NOT NULL)::INTEGER + (nullif(lang, 'en') IS NOT NULL)::INTEGER AS k FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""",
    "ratio_bands": f"""
        WITH r(key, higher, green, yellow) AS (VALUES {_BANDS}), v AS (SELECT p_size / 2.0::DOUBLE AS value FROM part)
        SELECT key, CASE WHEN higher THEN CASE WHEN value >= green THEN 'green' WHEN value >= yellow THEN 'yellow' ELSE 'red' END
               ELSE CASE WHEN value <= green THEN 'green' WHEN value <= yellow THEN 'yellow' ELSE 'red' END END AS status, count(*) AS n FROM v, r GROUP BY 1, 2""",
    "ratio_keys": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a,b,date' ELSE 'a,date' END AS keys FROM part",
    "worst_status": """
        SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'view' THEN 1 END) WHEN 3 THEN 'red' WHEN 2 THEN 'yellow' WHEN 1 THEN 'green' END AS status FROM events GROUP BY 1""",
    "risk_colours": """
        SELECT level, CASE level WHEN 'Low' THEN 'green' WHEN 'Medium' THEN 'yellow' WHEN 'Elevated' THEN 'yellow' WHEN 'High' THEN 'red' END AS status, count(*) AS n
        FROM (SELECT ['Low', 'Medium', 'Elevated', 'High', 'Critical'][p_size % 5 + 1] AS level FROM part) GROUP BY 1, 2""",
    "humanised_totals": "SELECT o_orderstatus, CASE WHEN sum(o_totalprice) >= 1e9 THEN 'B' WHEN sum(o_totalprice) >= 1e6 THEN 'M' WHEN sum(o_totalprice) >= 1e3 THEN 'K' ELSE '' END AS unit FROM orders GROUP BY 1",
    "plan_validate": r"""
        SELECT 'mystery' AS agent, NULL::VARCHAR AS sub_agent, 'unknown agent' AS warning FROM customer WHERE c_custkey % 4 = 2
        UNION ALL SELECT 'quantitative', 'nope', 'unknown sub-agent' FROM customer WHERE c_custkey % 4 = 0""",
    "plan_tasks": r"""SELECT CASE c_custkey % 4 WHEN 0 THEN 'quantitative' ELSE 'sentiment' END AS agent, CASE c_custkey % 4 WHEN 0 THEN 'dcf_modeller' ELSE '' END AS sub_agents FROM customer WHERE c_custkey % 4 IN (0, 3)""",
    "caveats": r"""
        WITH r AS (SELECT CASE event_type WHEN 'view' THEN 'quantitative' ELSE 'sentiment' END AS agent, CASE WHEN count(*) % 2 = 0 THEN 'success' ELSE 'partial' END AS status FROM events WHERE event_type IN ('view', 'error') GROUP BY 1)
        SELECT a.agent, coalesce(r.status, 'failed') AS status FROM (VALUES ('quantitative'), ('qualitative'), ('risk_governance'), ('sentiment')) a(agent) LEFT JOIN r ON r.agent = a.agent""",
    "manifest": """
        WITH r AS (SELECT l_suppkey AS company, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY 1),
        f AS (SELECT r.*, s_nationkey AS nation, returned * 12 / n AS nim, n % 5 AS npa, n % 50 AS pe, open * 3 / n AS cur FROM r JOIN supplier ON s_suppkey = company),
        c AS (SELECT *, CASE WHEN nim >= 3.5 THEN 1 WHEN nim >= 2.8 THEN 2 ELSE 3 END AS nim_s, CASE WHEN npa <= 1 THEN 1 WHEN npa <= 3 THEN 2 ELSE 3 END AS npa_s, ['green', 'yellow', 'red'] AS colours FROM f),
        m AS (
            SELECT company, 2 AS section_order, 'key_ratios' AS section, 'metric_nim' AS id, 'metric_card' AS component_type, 'small' AS size, 'quantitative_result.data.raw_ratios.NIM_pct' AS data_path, 'Net Interest Margin' AS label, colours[nim_s] AS status, 0 AS ord FROM c
            UNION ALL SELECT company, 2, 'key_ratios', 'metric_gross_npa', 'metric_card', 'small', 'quantitative_result.data.raw_ratios.Gross_NPA_pct', 'Gross NPA', CASE WHEN npa <= 1.5 THEN 'green' WHEN npa <= 3 THEN 'yellow' ELSE 'red' END, 1 FROM c
            UNION ALL SELECT company, 2, 'key_ratios', 'metric_pe', 'metric_card', 'small', 'quantitative_result.data.raw_ratios.PE_Ratio', 'Price / Earnings', CASE WHEN company % 3 = 0 THEN NULL WHEN pe <= 20 THEN 'green' WHEN pe <= 35 THEN 'yellow' ELSE 'red' END, 2 FROM c
            UNION ALL SELECT company, 2, 'key_ratios', 'metric_current', 'metric_card', 'small', 'quantitative_result.data.raw_ratios.Current_Ratio', 'Current Ratio', CASE WHEN cur >= 2 THEN 'green' WHEN cur >= 1 THEN 'yellow' ELSE 'red' END, 3 FROM c
            UNION ALL SELECT company, 3, 'investment_pillars', 'pillar_asset_quality', 'pillar_card', 'medium', 'synthesis.dynamic_investment_pillars.Asset Quality', 'Asset Quality', colours[greatest(nim_s, npa_s)], 0 FROM c
            UNION ALL SELECT company, 3, 'investment_pillars', 'pillar_growth', 'pillar_card', 'medium', 'synthesis.dynamic_investment_pillars.Growth', 'Growth', CASE WHEN nation % 4 > 0 THEN 'yellow' END, 1 FROM c
            UNION ALL SELECT company, 3, 'investment_pillars', 'pillar_other', 'pillar_card', 'medium', 'synthesis.dynamic_investment_pillars.Other', 'Other', NULL, 2 FROM c
            UNION ALL SELECT company, 4, 'risk_dashboard', 'risk_creditmarket_risk', 'risk_card', 'small', 'synthesis.key_risk_dashboard.Credit/Market Risk', 'Credit/Market Risk', ['green', 'yellow', 'yellow', 'red', NULL][nation % 5 + 1], 0 FROM c WHERE nation % 6 <> 0
            UNION ALL SELECT company, 4, 'risk_dashboard', 'risk_liquidity', 'risk_card', 'small', 'synthesis.key_risk_dashboard.Liquidity', 'Liquidity', ['green', 'yellow', 'yellow', 'red', NULL][n % 5 + 1], 1 FROM c WHERE nation % 6 <> 0
            UNION ALL SELECT company, 1, 'executive_summary', 'text_executive_summary', 'text_block', 'full', 'synthesis.executive_summary', 'Executive Summary', NULL, 0 FROM c
            UNION ALL SELECT company, 5, 'sentiment', 'sentiment_mood', 'sentiment_block', 'medium', 'sentiment_result.data.market_sentiment', 'Market Sentiment', ['green', 'yellow', 'red', NULL][nation % 5 + 1], 0 FROM c WHERE nation % 5 < 4
            UNION ALL SELECT company, 5, 'sentiment', 'sentiment_macro', 'macro_block', 'medium', 'sentiment_result.data.macroeconomic_environment', 'Macro Environment', NULL, 1 FROM c WHERE nation % 5 < 4)
        SELECT company, section_order::INTEGER AS section_order, section, id, component_type, size, data_path, label, status, ord::INTEGER AS ord FROM m""",
    "state_patch": """
        SELECT 'parts.' || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END AS value, p_partkey % 5 = 0 AS changed FROM part
        UNION ALL SELECT 'parts.' || p_partkey || '.extra', 'added', true FROM part WHERE p_partkey % 5 = 0""",
    "patch_manifest": r"""
        WITH c AS (SELECT p_brand AS section, p_partkey AS id, p_partkey % 70 = 0 OR p_partkey % 50 = 0 AS highlight FROM part)
        SELECT * FROM c WHERE section IN (SELECT section FROM c WHERE highlight)""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "event_sessions": """
        WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)
        SELECT user_id, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)::BIGINT AS sessions, count(*) AS events FROM e GROUP BY 1""",
}
