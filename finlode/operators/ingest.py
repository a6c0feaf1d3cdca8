"""Ingestion of report pages in one call: blocks, sections, tables, chunks, references and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunking, normalize, references, resolve, sections

KEYS = ("doc_id", "page_number")


def ingested(pages: DataFrame, documents: DataFrame, classify=sections.classified, summarise=None, size: int = chunking.CHUNK_SIZE, overlap: int = chunking.CHUNK_OVERLAP, saved=lambda df: df) -> dict[str, DataFrame]:
    """The tables that reports give: blocks, sections, tables, chunks, refs and nodes, by name.

    ``pages`` (doc_id, page_number, json, html, markdown); ``documents`` (doc_id, company, report_type, fiscal_year,
    fiscal_quarter). ``classify`` gives a section's type from its first heading, ``summarise`` a summary from its text; both
    are functions of a column, such as a model behind a Pandas UDF. Pages meet by document only, so documents are
    independent of each other, and everything stays a plan until one of the tables is used. ``saved`` may write a frame to
    a table and read it again: blocks in sections, sections, tables and marks, which several of the results are made from.
    """
    blocks = normalize.page_blocks(pages, KEYS)
    shown = blocks.withColumn("content_text", F.coalesce("content_text", "table_text"))
    grouped = saved(sections.grouped(shown))
    summary: Column = F.lit(None).cast("string") if summarise is None else summarise(F.col("content_markdown"))
    heading = F.try_element_at("headings", F.lit(1))
    rows = sections.section_rows(grouped).withColumn("section_type", sections.valid_section(classify(heading)))
    rows = rows.withColumn("section_path", F.filter(F.array(heading), lambda h: h.isNotNull())).withColumn("summary", summary)
    rows = saved(rows)
    tables = sections.table_index(grouped.where("block_type = 'table'"))
    tables = saved(tables.withColumn("table_id", F.concat_ws("/", "doc_id", "table_index")))
    cells = tables.select("doc_id", "table_id", F.posexplode(F.flatten(F.concat("headers", "rows"))).alias("cell_pos", "cell"))
    marks = saved(references.extracted(cells).join(tables.select("table_id", "doc_id"), "table_id"))
    refs = marks.join(resolve.resolved(marks, rows), ["doc_id", "ref_code"])
    return {
        "blocks": blocks,
        "sections": rows,
        "tables": tables,
        "chunks": chunking.section_chunks(rows, documents, size, overlap),
        "refs": refs,
        "nodes": references.section_tree(rows),
    }
