"""A corpus pipeline of five of the training-data operators, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finlode.llm.common import released, saved, shared_dir, table
from finlode.llm.decontaminate import decontaminate
from finlode.llm.mixing import resampled
from finlode.llm.near_dedup import near_representatives
from finlode.llm.quality import good_documents
from finlode.llm.token_files import read_token_files, write_token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the document with the smallest id stays."""
    return near_representatives(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated at the rates that bring the languages to their target shares; the total is so large that none is thinned out."""
    return resampled(docs, table(spark, sf_dir, "labels"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as token ids in byte-plane files; returns what the files hold of each document."""
    path = shared_dir(spark)
    write_token_files(docs, path)
    return read_token_files(spark, path)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder, read again, and deleted once used."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
        if before is not None:
            released(before)
        before = docs
    return docs


#: The classifiers and the tokenizer cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None
