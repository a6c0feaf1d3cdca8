"""Routing of questions to retrieval strategies by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import CONFIDENCE, STRATEGIES, TABLE_PHRASES


def table_phrase(question: Column) -> Column:
    """The first table phrase, in alphabetical order, that a question has anywhere in it; null if none."""
    found = F.filter(F.array(*(F.lit(p) for p in sorted(TABLE_PHRASES))), lambda p: F.lower(question).contains(p))
    return F.try_element_at(found, F.lit(1))


def years(question: Column) -> Column:
    return F.transform(F.array_distinct(F.regexp_extract_all(question, F.lit(r"\b(20\d\d)\b"), 1)), lambda y: y.cast("int"))


def cover_page(text: Column) -> Column:
    """(fiscal_year, fiscal_quarter, report_type) of a report's first text: its first year from 2000 on and first quarter."""
    quarter = F.upper(F.nullif(F.regexp_extract(text, r"(?i)\b(Q[1-4])\b", 1), F.lit("")))
    return F.struct(
        F.try_element_at(years(text), F.lit(1)).alias("fiscal_year"),
        quarter.alias("fiscal_quarter"),
        F.when(quarter.isNotNull(), "quarterly").otherwise("annual").alias("report_type"),
    )


def routed(questions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tier, confidence, strategy, phrase, n_years, fallback): the offline router, a question at a time.

    Notes and schedules ask for references, several years for a trend; else the confidence is low, and a table phrase
    then overrides it to a fact lookup.
    """
    q = F.coalesce(F.col(text_col), F.lit(""))
    rows = questions.select(F.col(id_col).alias("id"), q.alias("q")).withColumn("phrase", table_phrase(F.col("q"))).withColumn("n_years", F.size(years(F.col("q"))).cast("long"))
    guess = F.when(F.col("q").rlike(r"(?i)\bnote\s+\d+|\bschedule\s+[ivxlcdm]+\b"), "T3").when(F.col("n_years") > 1, "T4").otherwise("T2")
    rows = rows.withColumn("guess", guess).withColumn("sure", F.when(F.col("guess") == "T2", 0.5).otherwise(0.9))
    fallback = (F.col("sure") < CONFIDENCE) & F.col("phrase").isNotNull()
    rows = rows.withColumn("fallback", fallback).withColumn("tier", F.when(fallback, "T1").otherwise(F.col("guess")))
    names = F.create_map(*(F.lit(x) for kv in STRATEGIES.items() for x in kv))
    return rows.select("id", "tier", F.col("sure").alias("confidence"), names[F.col("tier")].alias("strategy"), "phrase", "n_years", "fallback")


def route_log(routes: DataFrame, at: Column) -> DataFrame:
    """Rows for the router's log, confidence as whole percent."""
    return routes.select("id", "tier", F.round(F.col("confidence") * 100).cast("int").alias("confidence"), "fallback", at.alias("created_at"))


def clarified(confidence: Column, candidates: Column, ticker: Column) -> tuple[Column, Column]:
    """Whether to ask back (below 0.8), and the candidates, the resolved ticker if there are none."""
    return confidence < 0.8, F.when(F.coalesce(F.size(candidates), F.lit(0)) < 1, F.array(ticker)).otherwise(candidates)
