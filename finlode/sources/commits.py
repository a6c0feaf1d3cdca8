"""Batches that are there wholly or not at all, over all the tables that they write, and their compaction.

A table is a folder with one folder for each batch, ``batch=<name>``. A batch first writes its part of every table, over
whatever an earlier try left, and then its row of ``commits``; what has no such row is not read. Compaction is a batch as
well, whose row names those that it stands for. So a batch that is tried again, or fails half way, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMITS = "replaces array<string>, batch string"


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def _deleted(spark: SparkSession, path: str) -> None:
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def batches(spark: SparkSession, root: str) -> DataFrame:
    """(batch): the batches that are there, without those that a compaction stands for."""
    if not _exists(spark, f"{root}/commits"):
        return spark.createDataFrame([], "batch string")
    rows = spark.read.schema(_COMMITS).parquet(f"{root}/commits")
    replaced = rows.select(F.explode("replaces").alias("batch"))
    return rows.select("batch").distinct().join(replaced, "batch", "left_anti")


def committed(tables: dict[str, DataFrame], root: str, batch: str, replaces: tuple[str, ...] = ()) -> None:
    """Writes one batch: its part of every table, then the row that makes it count. Doing it again replaces it by itself."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    done = spark.createDataFrame([(list(replaces),)], "replaces array<string>").coalesce(1)
    done.write.mode("overwrite").parquet(f"{root}/commits/batch={batch}")


def is_committed(spark: SparkSession, root: str, batch: str) -> bool:
    """Whether a batch's row of commits has been written whole."""
    return _exists(spark, f"{root}/commits/batch={batch}/_SUCCESS")


def opened(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table's rows of all batches that are there; others' folders are not read, as the batch is a folder."""
    if not _exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch string").parquet(f"{root}/{name}")
    return rows.join(batches(spark, root), "batch", "left_semi").drop("batch")


def compacted(spark: SparkSession, root: str, schemas: dict[str, str], batch: str, reduce: Callable[[str, DataFrame], DataFrame] = lambda name, rows: rows) -> None:
    """All batches that are there as one, with what ``reduce`` makes of each table, such as the last version of each key.

    The old batches stop to count when the new one is committed; their folders stay, for those who still read them, until
    ``cleaned``.
    """
    old = tuple(r["batch"] for r in batches(spark, root).collect())  # one row for each batch since the last compaction
    if old:
        committed({name: reduce(name, opened(spark, root, name, schema)) for name, schema in schemas.items()}, root, batch, old)


def cleaned(spark: SparkSession, root: str, names: tuple[str, ...]) -> None:
    """Deletes the folders of batches that a compaction stands for; their rows of commits go last."""
    rows = spark.read.schema(_COMMITS).parquet(f"{root}/commits")
    gone = [r["batch"] for r in rows.select(F.explode("replaces").alias("batch")).distinct().collect()]
    for name in (*names, "commits"):
        for batch in gone:
            _deleted(spark, f"{root}/{name}/batch={batch}")
