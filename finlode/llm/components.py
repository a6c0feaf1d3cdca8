"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of each batch by as few as keep the same nodes connected, all to smallest nodes."""
    for batch in batches:
        parent: dict = {}

        def root(x):
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x], x = top, up
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, batch.column(0).type), pa.array([root(x) for x in nodes], batch.column(0).type)], names=["u", "v"]
        )


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest one."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    handed = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node that has links, the smallest node it can reach.

    ``links`` has two columns of one type, in any direction; repeated links and links of a node to itself do no
    harm, links with a null end are left out. Union-find within tasks first thins the links out. Then rounds of
    large-star and small-star steps, each a table in the shared folder, bring every node to its component's
    smallest node; the number of rounds grows with the logarithm of the longest path.
    """
    a, b = links.columns
    raw = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    kind = raw.schema["u"].dataType.simpleString()
    now = saved(raw.distinct().mapInArrow(_union_find, f"u {kind}, v {kind}"))
    before = None
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1000003), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        old, now = now, saved(_small_star(_large_star(now)))
        dropped(old)
    tops = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
