"""Feeds and time series: look-back, trends, failure runs, source preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import within_days


def until_stale(items: DataFrame, feed: str, pos: str, at: str, as_of: Column, days: int) -> DataFrame:
    """Items before a feed's first one that is too old, in feed order; items without a date do not end it."""
    old = (~within_days(F.col(at), as_of, days)).cast("int")
    order = Window.partitionBy(feed).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("ended", F.max(F.coalesce(old, F.lit(0))).over(order)).where("ended = 0").drop("ended")


def trend(series: DataFrame, key: str, period: str, value: str, dead_band: float = 0.1) -> DataFrame:
    """Each value with the one before and the direction: within the dead band it is stable; nulls are left out first."""
    rows = series.where(F.col(value).isNotNull())
    before = F.lag(value).over(Window.partitionBy(key).orderBy(period))
    change = F.col(value) - F.col("previous")
    label = F.when(F.col("previous").isNull(), F.lit(None)).when(change > dead_band, "Increasing").when(change < -dead_band, "Decreasing").otherwise("Stable")
    return rows.withColumn("previous", before).withColumn("trend", label)


def failure_runs(log: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Adds ``run``: failures in a row up to each event; a success sets it back to 0."""
    window = Window.partitionBy(key).orderBy(*order)
    rows = log.withColumn("failed", failed.cast("int")).withColumn("island", F.sum(1 - F.col("failed")).over(window))
    return rows.withColumn("run", F.sum("failed").over(Window.partitionBy(key, "island").orderBy(*order))).drop("island", "failed")


def breaker_open(runs: DataFrame, key: str, limit: int = 3) -> DataFrame:
    """(key, opened): whether a source ever had ``limit`` failures in a row; it stays closed off from then on."""
    return runs.groupBy(key).agg((F.max("run") >= limit).alias("opened"))


def preferred(rows: DataFrame, keys: list[str], priority: Column, usable: Column) -> DataFrame:
    """Of each key the usable row with the least priority value."""
    order = Window.partitionBy(*keys).orderBy("priority")
    return rows.where(usable).withColumn("priority", priority).withColumn("best", F.row_number().over(order)).where("best = 1").drop("best", "priority")


def with_fallback(primary: DataFrame, secondary: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values of the primary source, or else of the secondary, and which one it was."""
    other = secondary.select(*keys, *(F.col(c).alias(f"other_{c}") for c in columns))
    joined = primary.withColumn("has", F.lit(True)).join(other, keys, "full_outer")
    source = F.when(F.col("has"), "primary").otherwise("secondary").alias("source")
    return joined.select(*keys, *(F.coalesce(c, f"other_{c}").alias(c) for c in columns), source)


def quarter_change(rows: DataFrame, key: str, quarter: str, value: str) -> DataFrame:
    """Each quarter's value with the one before and the difference."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(quarter))
    return rows.withColumn("previous", before).withColumn("change", F.col(value) - F.col("previous"))


def completeness(tables: list[Column], has_ratios: Column) -> Column:
    """full with all tables, partial with any of them or ratios, else failed."""
    found = sum((t.isNotNull().cast("int") for t in tables), F.lit(0))
    return F.when(found == len(tables), "full").when((found > 0) | has_ratios, "partial").otherwise("failed")


def blocked(title: Column) -> Column:
    """Whether a fetched page is an error or a challenge, by its title."""
    return F.lower(title).rlike("404|not found|just a moment|access denied|attention required")


def suffix_candidates(ticker: Column, suffixes: tuple[str, ...] = ("", ".NS", ".BO")) -> Column:
    """A ticker with exchange suffixes to try, in order."""
    return F.array(*(F.struct(F.lit(i).alias("priority"), F.concat(ticker, F.lit(s)).alias("candidate")) for i, s in enumerate(suffixes)))


def statement_rows(html: Column, table_id: str) -> Column:
    """A statement's lines: arrays of cells of the table in the section with an id; "Raw PDF" lines are left out."""
    section = F.regexp_extract(html, rf'(?is)id="{table_id}".*?<table[^>]*>(.*?)</table>', 1)
    rows = F.regexp_extract_all(section, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cells = F.transform(
        rows,
        lambda r: F.transform(
            F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))
        ),
    )
    return F.filter(cells, lambda r: (F.size(r) > 0) & (r[0] != "Raw PDF"))


def policy_rate(html: Column, label: str) -> Column:
    """The first number before a percent sign in the first table row that mentions a label."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    row = F.try_element_at(F.filter(rows, lambda r: F.lower(r).contains(label.lower())), F.lit(1))
    return F.regexp_extract(row, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1).try_cast("double")
