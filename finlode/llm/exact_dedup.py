"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved, table

#: A run's key is the SHA-256 digest; it is verified by a second, independent hash and the length.
KEY = ("digest", "verify", "n_bytes")
ENTRY = "digest binary, verify bigint, n_bytes bigint, slot bigint, keep_id {id}, n bigint"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for batch in batches:
        # bytes.lower() changes A-Z only, and no byte of a non-ASCII character is one of them
        raw = [x.lower() for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()),
                pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64).view(np.int64)),
                pa.array([len(x) for x in raw], pa.int64()),
                pa.array(np.full(len(raw), task), pa.int64()),
            ],
            names=["doc_id", *KEY, "run"],
        )


def _folded(entries: pa.Table, best: str) -> pa.Table:
    """Sorted entries with neighbours of one slot and key as one entry."""
    n = entries.num_rows
    first = np.zeros(n, bool)
    first[0] = True
    for k in ("slot", *KEY):
        column = entries.column(k)
        first[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy()
    groups = pa.table({"group": np.cumsum(first), "keep_id": entries.column("keep_id"), "n": entries.column("n")})
    groups = groups.group_by("group", use_threads=False).aggregate([("keep_id", best), ("n", "sum")])
    heads = entries.take(pa.array(np.flatnonzero(first)))
    return pa.table([*(heads.column(k) for k in (*KEY, "slot")), groups.column(f"keep_id_{best}"), groups.column("n_sum")], names=[*KEY, "slot", "keep_id", "n"])


def _merging(best: str):
    """Folds a stream of sorted entries; the last entry of a batch waits for the next batch."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                entries = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
                entries = _folded(entries if held is None else pa.concat_tables([held, entries]).combine_chunks(), best)
                yield from entries.slice(0, entries.num_rows - 1).to_batches()
                held = entries.slice(entries.num_rows - 1).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return merge


def _merge(runs: DataFrame, slot: Column, merging, schema: str) -> DataFrame:
    """One round: the runs of a slot meet, each digest in one task, in sorted order; of equal verified keys one entry remains."""
    entries = runs.withColumn("slot", slot)
    return entries.repartition("slot", "digest").sortWithinPartitions("slot", *KEY).mapInArrow(merging, schema)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    fan_in: int = 8,
    rounds: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical after lower-casing A-Z. ``keep`` says which id of a group stays,
    ``smallest`` or ``largest``. Each scan task makes a sorted run of (digest, verification, length, id, count),
    with one entry for each of its distinct texts. In every round ``fan_in`` neighbouring runs are merged into
    one, until one is left; with ``rounds`` given, runs start in ``fan_in ** rounds`` slots instead of one each.
    What a round holds of a digest is one entry per run, so a group of any size meets itself at most ``fan_in``
    at a time. The groups of several rows then go back down the same tree, round by round, and to the rows by
    run: no task gets more rows of a group than one scan task read.

    A null text is the empty text, and all empty texts are one group. A null id takes part in its group
    but stays only where the whole group has null ids. Rows that repeat an id keep their own result
    rows; of rows that tie on the kept id, each is marked kept. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    source = documents(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    schema, merging = ENTRY.format(id=kind), _merging("min" if keep == "smallest" else "max")
    rows = saved(source.mapInArrow(_digests, f"doc_id {kind}, digest binary, verify bigint, n_bytes bigint, run bigint"))
    slots = (rows.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0] + 1) if rounds is None else fan_in**rounds
    rows = rows.withColumn("slot", F.pmod("run", F.lit(slots)))
    # a run is sorted and merged where it lies
    entries = rows.select(*KEY, "slot", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("n"))
    levels = [saved(entries.sortWithinPartitions("slot", *KEY).mapInArrow(merging, schema))]
    up = F.floor(F.col("slot") / fan_in)
    while True:
        levels.append(saved(_merge(levels[-1], up, merging, schema)))
        slots = -(-slots // fan_in)
        if slots == 1:
            break
    found = levels.pop().where("n > 1").select(*KEY, "slot", "keep_id", "n")
    for level in reversed(levels):
        below = level.select(*KEY, F.col("slot").alias("below"), up.alias("slot")).join(found, [*KEY, "slot"])
        # a run that was read in two parts has two entries of a key in the lowest level
        found = below.dropDuplicates([*KEY, "slot", "below"]).select(*KEY, F.col("below").alias("slot"), "keep_id", "n")
    named = rows.join(found, [*KEY, "slot"], "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return named.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_bytes",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_dedup`` of all documents; the largest doc_id of each group stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP4_SQL = """
WITH t AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
    FROM documents
), h AS (
    SELECT doc_id, sha256(norm) AS text_sha256, CAST(octet_length(encode(norm)) AS BIGINT) AS n_bytes, norm FROM t
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256, n_bytes
FROM h WINDOW w AS (PARTITION BY norm)
"""
