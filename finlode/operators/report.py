"""Execution plans, dashboard manifests and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import band, colour, mood_colour, risk_colour, severity
from ..functions.vocab import AGENTS, DASHBOARD, RATIOS



def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, s) for a, subs in AGENTS.items() for s in subs], "agent string, sub_agent string")


def plan_warnings(plan: DataFrame) -> DataFrame:
    """(agent, sub_agent, warning) of plan rows (agent, should_run, sub_agents) that the registry does not know."""
    known = F.broadcast(registry(plan.sparkSession))
    agents = plan.join(known.select("agent").distinct(), "agent", "left_anti").select("agent", F.lit(None).cast("string").alias("sub_agent"), F.lit("unknown agent").alias("warning"))
    subs = plan.join(known.select("agent").distinct(), "agent", "left_semi").select("agent", F.explode("sub_agents").alias("sub_agent"))
    return agents.unionByName(subs.join(known, ["agent", "sub_agent"], "left_anti").withColumn("warning", F.lit("unknown sub-agent")))


def plan_tasks(plan: DataFrame) -> DataFrame:
    """(agent, sub_agents): known agents that should run, with the helpers they are known to have."""
    known = F.broadcast(registry(plan.sparkSession))
    run = plan.where("should_run").join(known.select("agent").distinct(), "agent", "left_semi")
    subs = run.select("agent", F.explode("sub_agents").alias("sub_agent")).join(known, ["agent", "sub_agent"], "left_semi")
    lists = subs.groupBy("agent").agg(F.array_sort(F.collect_set("sub_agent")).alias("approved"))
    return run.select("agent").join(lists, "agent", "left").select("agent", F.coalesce("approved", F.array().cast("array<string>")).alias("sub_agents"))


def caveats(results: DataFrame) -> DataFrame:
    """(agent, status): every agent of the registry; without a result it failed."""
    agents = results.sparkSession.createDataFrame([(a,) for a in AGENTS], "agent string")
    return agents.join(results, "agent", "left").select("agent", F.coalesce("status", F.lit("failed")).alias("status"))


def _component(section: str, id_: Column, kind: str, size: str, path: Column, label: Column, status: Column, order: Column) -> list[Column]:
    values = (F.lit(section), id_, F.lit(kind), F.lit(size), path, label, status.cast("string"), order.cast("int"))
    return [F.col("company"), *(v.alias(n) for v, n in zip(values, ("section", "id", "component_type", "size", "data_path", "label", "status", "ord"), strict=True))]


def _place() -> Column:
    """A row's number within its company, from 0."""
    return F.row_number().over(Window.partitionBy("company").orderBy("pos")) - 1


def ratio_components(ratios: DataFrame) -> DataFrame:
    """Metric cards of the known ratios of (company, pos, key, value), in input order; text values have no status."""
    rules = F.broadcast(ratios.sparkSession.createDataFrame(RATIOS, "key string, label string, higher boolean, green double, yellow double"))
    rows = ratios.join(rules, "key")
    id_ = F.concat(F.lit("metric_"), F.regexp_replace(F.lower("key"), "_pct|_ratio", ""))
    status = band(F.col("value").try_cast("double"), F.col("higher"), F.col("green"), F.col("yellow"))
    return rows.select(*_component("key_ratios", id_, "metric_card", "small", F.concat(F.lit("quantitative_result.data.raw_ratios."), "key"), F.col("label"), status, _place()))


def pillar_components(metrics: DataFrame) -> DataFrame:
    """Pillar cards of (company, pos, pillar, status): a pillar is as bad as its worst metric."""
    worst = metrics.groupBy("company", "pillar").agg(F.min("pos").alias("pos"), colour(F.max(severity(F.col("status")))).alias("worst"))
    id_ = F.concat(F.lit("pillar_"), F.replace(F.lower("pillar"), F.lit(" "), F.lit("_")))
    return worst.select(*_component("investment_pillars", id_, "pillar_card", "medium", F.concat(F.lit("synthesis.dynamic_investment_pillars."), "pillar"), F.col("pillar"), F.col("worst"), _place()))


def risk_components(risks: DataFrame) -> DataFrame:
    """Risk cards of (company, pos, risk, level)."""
    id_ = F.concat(F.lit("risk_"), F.replace(F.replace(F.lower("risk"), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("")))
    return risks.select(*_component("risk_dashboard", id_, "risk_card", "small", F.concat(F.lit("synthesis.key_risk_dashboard."), "risk"), F.col("risk"), risk_colour(F.col("level")), _place()))


def manifest(companies: DataFrame, ratios: DataFrame, metrics: DataFrame, risks: DataFrame) -> DataFrame:
    """All components of each company of (company, mood), sections in their fixed order; sections without any do not appear.

    A company without a mood has no sentiment section. Every order is within a company, so companies are independent.
    """
    text = lambda s: F.lit(s)
    felt = companies.where("mood IS NOT NULL")
    parts = [
        companies.select(*_component("executive_summary", text("text_executive_summary"), "text_block", "full", text("synthesis.executive_summary"), text("Executive Summary"), F.lit(None), F.lit(0))),
        *(t.join(companies.select("company"), "company", "left_semi") for t in (ratio_components(ratios), pillar_components(metrics), risk_components(risks))),
        felt.select(*_component("sentiment", text("sentiment_mood"), "sentiment_block", "medium", text("sentiment_result.data.market_sentiment"), text("Market Sentiment"), mood_colour(F.col("mood")), F.lit(0))),
        felt.select(*_component("sentiment", text("sentiment_macro"), "macro_block", "medium", text("sentiment_result.data.macroeconomic_environment"), text("Macro Environment"), F.lit(None), F.lit(1))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    place = F.array_position(F.array(*(F.lit(s) for s in DASHBOARD)), F.col("section"))
    return out.withColumn("section_order", place.cast("int"))


def patched(state: DataFrame, changes: DataFrame) -> DataFrame:
    """A state (path, value) after changes (seq, path, value): new paths are added, the last change of a path counts."""
    last = changes.groupBy("path").agg(F.max_by("value", "seq").alias("new"), F.lit(True).alias("changed")).select("path", "new", F.lit(True).alias("changed"))
    joined = state.join(last, "path", "full_outer")
    return joined.select("path", F.when(F.col("changed"), F.col("new")).otherwise(F.col("value")).alias("value"), F.coalesce("changed", F.lit(False)).alias("changed"))


def patch_manifest(components: DataFrame, changes: DataFrame) -> DataFrame:
    """Components of the sections that changes touch, with whether the component itself is touched.

    A change touches a component whose path is its own or a prefix of it up to a dot, so components are joined by equality
    with the prefixes of the changed paths.
    """
    names = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, F.lit(1), n), "."))
    touched = changes.select(F.explode(prefixes).alias("data_path")).distinct().withColumn("highlight", F.lit(True))
    marked = components.join(touched, "data_path", "left").select(*components.columns, F.coalesce("highlight", F.lit(False)).alias("highlight"))
    return marked.join(marked.where("highlight").select("section").distinct(), "section", "left_semi")


def with_values(components: DataFrame, state: DataFrame) -> DataFrame:
    """Components with the ``value`` that a state (path, value) has at their path; null where it has none."""
    return components.join(state.select(F.col("path").alias("data_path"), "value"), "data_path", "left")


def patch_text(changes: DataFrame, summary: str) -> DataFrame:
    """(text): a summary of an update and its changed paths in order, as Markdown."""
    paths = changes.agg(F.array_sort(F.collect_set("path")).alias("paths"))
    lines = F.transform("paths", lambda p: F.concat(F.lit("- `"), p, F.lit("`\n")))
    listed = F.when(F.size("paths") > 0, F.concat(F.lit("\n**Changed fields:**\n"), F.array_join(lines, ""))).otherwise("")
    return paths.select(F.concat(F.lit(f"## Update Applied\n{summary}\n"), listed).alias("text"))


def clarification(candidates: Column) -> Column:
    """A question back that lists the candidates."""
    return F.concat(F.lit("Which of these is meant?\n"), F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("- "), c)), "\n"))


def ingestion_counts(pages: DataFrame, sections: DataFrame, tables: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, pages, sections, tables, chunks, refs): how much of each a document gave."""
    out = None
    for name, df in (("pages", pages), ("sections", sections), ("tables", tables), ("chunks", chunks), ("refs", refs)):
        one = df.groupBy("doc_id").agg(F.count("*").alias(name))
        out = one if out is None else out.join(one, "doc_id", "left")
    return out.na.fill(0)
