"""Queries in subword tokens; SQL has no tokenizer, so it checks what follows from the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import search, subwords
from ..sources.scratch import scratch
from .retrieval import table


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def subword_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 subword tokens that overlap by 16, cut at sentence ends; their texts as MD5."""
    found = subwords.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", _path(), 128, 16)
    return found.select("id", F.col("chunk_index").cast("long").alias("chunk_index"), "first_token", "n_tokens", F.md5("chunk_text").alias("chunk_md5"))


def subword_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters that the windows of each text cover, without gaps, and whether every window is a piece of its text."""
    docs = table(spark, sf_dir, "documents")
    found = subwords.chunked(docs, "doc_id", "text", _path(), 128, 16, trim=False)
    before = F.coalesce(F.max("end").over(Window.partitionBy("id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("new", F.greatest(F.col("end") - F.greatest("begin", before), F.lit(0))).withColumn("gap", F.col("begin") > before)
    sums = found.groupBy("id").agg(F.sum("new").alias("n_chars"), F.bool_or("gap").alias("gaps"), F.max("n_tokens").alias("most"), F.max("chunk_index").alias("windows"))
    return sums.select(F.col("id").alias("doc_id"), "n_chars", "gaps", (F.col("most") <= 128).alias("sized"), ((F.col("windows") == 0) | (F.col("most") == 128)).alias("full"))


def context_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents in order of id as far as 3000 subword tokens go; the sizes are a table, as they are read twice."""
    path = scratch(spark)
    subwords.sized(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), _path()).drop("text").write.parquet(path)
    rows = spark.read.parquet(path)
    return search.within_budget(rows, "source", "doc_id", "tokens", 3000)


QUERIES = {f.__name__: f for f in (subword_chunks, subword_cover, context_subwords)}

ORACLE_SQL = {
    "subword_cover": r"SELECT doc_id, length(text)::BIGINT AS n_chars, false AS gaps, true AS sized, true AS full FROM documents WHERE regexp_matches(text, '\S')",
}
