"""Batches over several tables: tried again, failed half way, compacted; and a stream that is replayed."""

import pytest
from pyspark.sql import functions as F

from finlode.sources import commits, tables
from finlode.streaming import ingest

SCHEMAS = {"a": "id int, v string", "b": "id int, n int"}


def rows_of(spark, root):
    return {name: sorted(tuple(r) for r in commits.opened(spark, root, name, schema).collect()) for name, schema in SCHEMAS.items()}


def batch(spark, *values):
    rows = spark.createDataFrame([(i, v) for i, v in values], "id int, v string")
    return {"a": rows, "b": rows.select("id", F.length("v").alias("n"))}


def test_batches_count_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert rows_of(spark, root) == {"a": [], "b": []}
    commits.committed(batch(spark, (1, "x")), root, "0")
    commits.committed(batch(spark, (1, "x")), root, "0")
    batch(spark, (2, "yy"))["a"].write.parquet(f"{root}/a/batch=1")
    assert rows_of(spark, root) == {"a": [(1, "x")], "b": [(1, 1)]} and not commits.is_committed(spark, root, "1")
    commits.committed(batch(spark, (2, "yyy")), root, "1")
    assert rows_of(spark, root) == {"a": [(1, "x"), (2, "yyy")], "b": [(1, 1), (2, 3)]}


def test_compaction(spark, tmp_path):
    root = f"file://{tmp_path}"
    for i, v in enumerate(["x", "yy", "zzz"]):
        commits.committed({k: t.withColumn("id", F.lit(7)) for k, t in batch(spark, (i, v)).items()}, root, str(i))
    before = rows_of(spark, root)
    commits.compacted(spark, root, SCHEMAS, "c0")
    assert rows_of(spark, root) == before and [r[0] for r in commits.batches(spark, root).collect()] == ["c0"]
    commits.committed(batch(spark, (9, "late")), root, "1")  # replayed: another batch stands for it
    assert rows_of(spark, root) == before
    commits.committed(batch(spark, (9, "new")), root, "3")
    commits.compacted(spark, root, SCHEMAS, "c1", lambda name, rows: tables.latest(rows, "id", rows.columns[1]))
    assert rows_of(spark, root) == {"a": [(7, "zzz"), (9, "new")], "b": [(7, 3), (9, 3)]}
    commits.cleaned(spark, root, tuple(SCHEMAS))
    assert rows_of(spark, root) == {"a": [(7, "zzz"), (9, "new")], "b": [(7, 3), (9, 3)]}
    import os

    assert sorted(os.listdir(tmp_path / "a")) == ["batch=c1"]


def test_a_replayed_stream(spark, tmp_path):
    """A batch that fails between its tables is tried again from the checkpoint; a stream that starts anew writes nothing twice."""
    root = f"file://{tmp_path}"
    spark.createDataFrame([(1, "x"), (2, "yy")], "id int, v string").coalesce(1).write.parquet(f"{root}/in")
    tries = []

    def transform(rows):
        tries.append(1)
        if len(tries) == 1:
            rows.write.mode("overwrite").parquet(f"{root}/out/a/batch=stream-0")
            raise RuntimeError("lost between two tables")
        return {"a": rows, "b": rows.select("id", F.length("v").alias("n"))}

    def run(check):
        ingest.ingested_once(ingest.landed(spark, f"{root}/in", SCHEMAS["a"]), f"{root}/out", f"{root}/{check}", transform)

    with pytest.raises(Exception, match="lost between"):
        run("check")
    assert rows_of(spark, f"{root}/out") == {"a": [], "b": []}
    want = {"a": [(1, "x"), (2, "yy")], "b": [(1, 1), (2, 2)]}
    run("check")
    assert rows_of(spark, f"{root}/out") == want and len(tries) == 2
    run("other")  # a lost checkpoint: the same batch comes again
    assert rows_of(spark, f"{root}/out") == want and len(tries) == 2


def test_a_second_try_of_a_plain_batch(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([(1, "x")], "id int, v string").coalesce(1).write.parquet(f"{root}/in")
    for check in ("one", "two"):
        ingest.ingested(ingest.landed(spark, f"{root}/in", SCHEMAS["a"]), f"{root}/out", f"{root}/{check}", lambda b: b)
    assert spark.read.parquet(f"{root}/out").count() == 1
