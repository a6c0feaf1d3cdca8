"""Streaming extensions: ingestion of landed files, telemetry windows and a stateful circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import commits


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New files of rows as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(files: DataFrame, at: str = "at", key: str = "file_hash", late: str = "1 day") -> DataFrame:
    """Each file hash once within the time that late files may come."""
    return files.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def ingested(stream: DataFrame, target: str, checkpoint: str, transform) -> None:
    """Takes all that has landed, transforms it in batches and adds these to a table; runs until nothing is left.

    Each batch has a folder of its own, by its number in the stream, which a second try of the batch writes over.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingested_once(stream: DataFrame, root: str, checkpoint: str, transform, name: str = "stream") -> None:
    """The same for several tables at once: ``transform`` gives tables by name, and a batch counts in all of them or in none.

    A batch that has been committed is not written again when the stream replays it; one that failed half way is.
    """

    def write(batch: DataFrame, number: int) -> None:
        committed_once(batch, root, f"{name}-{number}", transform)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def committed_once(batch: DataFrame, root: str, name: str, transform) -> None:
    """Writes a batch's tables unless the batch is there already."""
    if not commits.is_committed(batch.sparkSession, root, name):
        commits.committed(transform(batch), root, name)


def telemetry(events: DataFrame, at: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and mean values by window and type; batch and stream alike."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key: events with at most a gap between."""
    rows = events.withWatermark(at, gap) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))


def breaker(calls: DataFrame, limit: int = 3) -> DataFrame:
    """(source, run, opened) for each batch of calls (source, seq, failed): state is the run of failures, and whether it ever reached the limit."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, opened = state.get if state.exists else (0, False)
        rows: list[Any] = sorted((int(s), bool(f)) for frame in frames for s, f in zip(frame["seq"], frame["failed"], strict=True))
        for _, failed in rows:
            run = run + 1 if failed else 0
            opened = opened or run >= limit
        state.update((run, opened))
        yield pd.DataFrame({"source": [key[0]], "run": [run], "opened": [opened]})

    return calls.groupBy("source").applyInPandasWithState(step, "source string, run long, opened boolean", "run long, opened boolean", "update", GroupStateTimeout.NoTimeout)
