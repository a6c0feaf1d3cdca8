"""Governance disclosures with their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import any_keyword, within_days


def insider_trades(rows: DataFrame, as_of: Column, days: int = 90, kind: str = "All") -> DataFrame:
    """Insider disclosures (ticker, at, transaction_type, ...) of the last days, of one kind or all."""
    found = rows.where(within_days(F.col("at"), as_of, days))
    return found if kind == "All" else found.where(F.lower("transaction_type") == kind.lower())


def related_parties(rows: DataFrame, least_pct: float = 0.0) -> DataFrame:
    """Related-party transactions (ticker, period, pct, ...) of at least a share."""
    return rows.where(F.col("pct") >= least_pct)


def holdings(rows: DataFrame, quarters: int = 2, category: str = "All") -> DataFrame:
    """Institutional holdings (ticker, category, quarter, pct): the last quarters, with the shift since the one before."""
    found = rows if category == "All" else rows.where(F.col("category") == category)
    key = Window.partitionBy("ticker", "category")
    shift = found.withColumn("shift", F.col("pct") - F.lag("pct").over(key.orderBy("quarter")))
    return shift.withColumn("n", F.row_number().over(key.orderBy(F.desc("quarter")))).where(F.col("n") <= quarters).drop("n")


def flagged(announcements: DataFrame, keywords: tuple[str, ...] = ()) -> DataFrame:
    """Announcements with any of the keywords, all without keywords."""
    return announcements.where(any_keyword(F.col("text"), keywords))


def loaded(sessions: DataFrame, session_id: str) -> DataFrame:
    """A session's state as a variant, if it has a dashboard and can be read."""
    rows = sessions.where((F.col("id") == session_id) & F.col("has_dashboard")).select("id", F.try_parse_json("shared_state_json").alias("state"))
    return rows.where("state IS NOT NULL")


def silenced(plan: DataFrame, ask_back: Column) -> DataFrame:
    """A plan of which nothing runs where the question must be asked back first."""
    return plan.withColumn("should_run", F.col("should_run") & ~ask_back)


def stale(results: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Adds the age of results in hours and whether they are stale."""
    return results.withColumn("age_hours", (F.unix_timestamp(as_of) - F.unix_timestamp("finished_at")) / 3600).withColumn("stale", F.col("age_hours") > hours)
