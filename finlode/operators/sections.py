"""Grouping of content blocks into sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import SECTION_TYPES


def grouped(blocks: DataFrame, small: int = 3, merge: bool = True) -> DataFrame:
    """Adds ``section`` (from 0) to (doc_id, page_number, pos, block_type, heading_level, ...).

    A heading of level 1 or 2 begins a group unless it is the first block. A group of fewer than ``small`` blocks then
    joins the one before, except the first. Both are running sums, so a document is one window partition and is never
    gathered into one row.
    """
    order = Window.partitionBy("doc_id").orderBy("page_number", "pos")
    begins = (F.col("block_type") == "heading") & (F.col("heading_level") <= 2) & (F.row_number().over(order) > 1)
    rows = blocks.withColumn("group", F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(order))
    if not merge:
        return rows.withColumnRenamed("group", "section")
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy("doc_id", "group")))
    head = F.row_number().over(Window.partitionBy("doc_id", "group").orderBy("page_number", "pos")) == 1
    stays = head & ((F.col("size") >= small) | (F.col("group") == 0))
    rows = rows.withColumn("stays", stays.cast("int"))
    return rows.withColumn("section", F.sum("stays").over(order) - 1).drop("group", "size", "stays")


def markdown(block_type: Column, level: Column, text: Column) -> Column:
    return F.when(block_type == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)


def section_rows(blocks: DataFrame, preview: int = 3000) -> DataFrame:
    """(doc_id, section, page_start, page_end, n_blocks, headings, content_markdown, preview) of grouped blocks."""
    line = markdown(F.col("block_type"), F.coalesce("heading_level", F.lit(1)), F.coalesce("content_text", F.lit("")))
    shown = F.when(F.col("block_type") == "table", F.concat(F.lit("[TABLE] "), F.coalesce("content_text", F.lit("")))).otherwise(line)
    parts = F.array_sort(F.collect_list(F.struct("page_number", "pos", line.alias("line"), shown.alias("shown"), "block_type", "content_text")))
    out = blocks.groupBy("doc_id", "section").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.count("*").alias("n_blocks"), parts.alias("parts"))
    return out.select(
        "doc_id",
        "section",
        "page_start",
        "page_end",
        "n_blocks",
        F.transform(F.filter("parts", lambda p: p["block_type"] == "heading"), lambda p: p["content_text"]).alias("headings"),
        F.array_join(F.transform(F.filter("parts", lambda p: p["line"] != ""), lambda p: p["line"]), "\n\n").alias("content_markdown"),
        F.substring(F.array_join(F.transform("parts", lambda p: p["shown"]), "\n"), 1, preview).alias("preview"),
    )


#: Words of headings by which the offline classifier knows a section's type.
HEADING_WORDS = (
    ("balance sheet", "balance_sheet"),
    ("profit and loss", "profit_loss"),
    ("cash flow", "cash_flow"),
    ("schedule", "schedule"),
    ("notes to", "note_to_accounts"),
    ("note ", "note_to_accounts"),
    ("directors", "directors_report"),
    ("management discussion", "mda"),
    ("auditor", "auditors_report"),
    ("management", "management_profile"),
    ("vision", "vision_mission"),
    ("risk", "risk_factors"),
    ("shareholder", "shareholders_info"),
    ("governance", "corporate_governance"),
    ("standalone", "standalone_financials"),
    ("consolidated", "consolidated_financials"),
)


def classified(heading: Column) -> Column:
    """The offline stand-in for a section classifier: the first known words in a heading, else other."""
    text = F.lower(F.coalesce(heading, F.lit("")))
    out = F.lit("other")
    for words, kind in reversed(HEADING_WORDS):
        out = F.when(text.contains(words), kind).otherwise(out)
    return out


def valid_section(col: Column) -> Column:
    return F.when(col.isin(*SECTION_TYPES), col).otherwise("other")


def table_index(tables: DataFrame) -> DataFrame:
    """Numbers the tables of a document from 0 by section and position."""
    return tables.withColumn("table_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "page_number", "pos")) - 1)
