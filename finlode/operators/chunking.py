"""Overlapping chunks of documents with contextual prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sentence_trim, title_words
from ..functions.vocab import CHUNK_OVERLAP, CHUNK_SIZE, NARRATIVE_TYPES


def windows(n: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, tail: bool = False) -> Column:
    """First tokens of a text's windows; ``tail`` also starts one inside the last full window, as long as tokens are left."""
    step = max(size - overlap, 1)
    last = n - 1 if tail else F.greatest(n - overlap - 1, F.lit(0))
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, F.lit(step)))


def chunked(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, tail: bool = False, trim: bool = True) -> DataFrame:
    """(id, chunk_index, chunk_text, n_tokens): windows of white-space tokens; one task makes all chunks of a text.

    A text that fits is one chunk as it is. Others give windows, each but the last cut at a sentence end in its second
    half if ``trim``. Blank and null texts give none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = rows.withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != "")).withColumn("n", F.size("words"))
    cut = rows.select("id", "text", "words", "n", F.posexplode(windows(F.col("n"), size, overlap, tail)).alias("chunk_index", "first"))
    part = F.array_join(F.slice("words", F.col("first") + 1, size), " ")
    length = F.least(F.lit(size), F.col("n") - F.col("first"))
    whole = F.col("n") <= size
    if trim:
        part = F.when(F.col("first") + size < F.col("n"), sentence_trim(part)).otherwise(part)
    out = cut.select("id", "chunk_index", F.when(whole, F.col("text")).otherwise(F.trim(part)).alias("chunk_text"), length.cast("long").alias("n_tokens"))
    return out.where("chunk_text != ''")


def prefix(company: Column, report_type: Column, year: Column, quarter: Column, section: Column, summary: Column) -> Column:
    """The header of a chunk: company, report and section, then the summary if there is one."""
    report = F.when(F.coalesce(quarter, F.lit("")) != "", F.concat(quarter, F.lit(" "), year.cast("string"))).otherwise(
        F.concat(F.initcap(report_type), F.lit(" Report "), year.cast("string"))
    )
    header = F.concat(F.lit("["), company, F.lit(" | "), report, F.lit(" | "), title_words(section), F.lit("]"))
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat(header, F.lit("\nSummary: "), summary)).otherwise(header)


def section_chunks(sections: DataFrame, documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, types: tuple[str, ...] = NARRATIVE_TYPES) -> DataFrame:
    """Chunks of the narrative sections of documents, each with its header and the text to be embedded.

    ``sections`` (doc_id, section, section_type, section_path, page_start, page_end, content_markdown, summary);
    ``documents`` (doc_id, company, report_type, fiscal_year, fiscal_quarter). Blank sections give none. Result: doc_id,
    section, chunk_index, chunk_text, n_tokens, metadata_prefix, full_text, section_type, section_path, page_start, page_end.
    """
    rows = sections.where(F.col("section_type").isin(*types)).join(documents, "doc_id")
    head = prefix(F.col("company"), F.col("report_type"), F.col("fiscal_year"), F.col("fiscal_quarter"), F.col("section_type"), F.col("summary"))
    kept = ("doc_id", "section", "section_type", "section_path", "page_start", "page_end")
    named = rows.select(F.struct(*kept, head.alias("metadata_prefix")).alias("id"), "content_markdown")
    found = chunked(named, "id", "content_markdown", size, overlap).select("id.*", "chunk_index", "chunk_text", "n_tokens")
    return found.withColumn("full_text", F.concat("metadata_prefix", F.lit("\n\n"), "chunk_text"))


def page_ranges(pages: DataFrame, batch: int = 10) -> DataFrame:
    """(id, page_start, page_end): inclusive ranges of at most ``batch`` pages, from 1; a file without pages is an error."""
    checked = F.when(F.col("total_pages") > 0, F.col("total_pages")).otherwise(F.raise_error(F.lit("a document has no pages")))
    starts = pages.select("id", checked.alias("total")).select("id", "total", F.explode(F.sequence(F.lit(1), "total", F.lit(batch))).alias("page_start"))
    return starts.select("id", "page_start", F.least(F.col("page_start") + batch - 1, F.col("total")).alias("page_end"))
