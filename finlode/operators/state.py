"""Nested states as rows: JSON taken apart to typed paths, compared, patched and put together again.

A path is an array of steps. A step is an object's key or, in brackets, a place in an array; a key that begins with a
bracket or a backslash has a backslash before it. Every value without parts is a leaf, empty objects and arrays too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of JSON that are taken apart at a time; leaves take some hundred times as many in Python.
TEXTS = 1 << 18

_LEAVES = "path array<string>, place int, kind string, value string"


class _Number(str):
    """A number as it is written."""


def _leaves(text: str) -> list[tuple[list[str], int, str, str]]:
    """(path, place, kind, value as JSON) of each leaf, in order; no leaf where the text is not JSON."""
    try:
        top = json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_Number)
    except ValueError:
        return []
    out: list[tuple[list[str], int, str, str]] = []
    todo = [([], top)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict) and value:
            todo += [([*path, f"\\{k}" if k[:1] in ("[", "\\") else k], v) for k, v in reversed(value.items())]
        elif isinstance(value, list) and value:
            todo += [([*path, f"[{i}]"], v) for i, v in reversed(list(enumerate(value)))]
        elif isinstance(value, _Number):
            out.append((path, len(out), "number", str(value)))
        else:
            kind = {str: "string", bool: "boolean", type(None): "null", dict: "object", list: "array"}[type(value)]
            out.append((path, len(out), kind, json.dumps(value, ensure_ascii=False)))
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts, its last column, have about TEXTS bytes together, or one row; they bound a worker's memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
    begin = total = 0
    for row, size in enumerate(sizes):
        if total and total + size > TEXTS:
            yield batch.slice(begin, row - begin)
            begin, total = row, 0
        total += size
    yield batch.slice(begin)


def flattened(states: DataFrame, id_col: str = "id", json_col: str = "state", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, path, place, kind, value) of each leaf of JSON texts; numbers stay as they are written. Null and malformed texts have no leaves.

    ``keep`` are columns that each leaf takes along.
    """
    rows = states.select(F.col(id_col).alias("id"), *keep, F.col(json_col).alias("state"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            found = [(i, *leaf) for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if text is not None for leaf in _leaves(text)]
            row, *columns = zip(*found, strict=True) if found else ([], [], [], [], [])
            own = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
            kinds = (pa.list_(pa.string()), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names[:-1], "path", "place", "kind", "value"])

    return rows.mapInArrow(take, schema + _LEAVES)


def step_path(dotted: Column) -> Column:
    """The path that a dotted text means: a.b[0].c; a key cannot have a dot or bracket here."""
    steps = F.split(F.regexp_replace(dotted, r"\[(\d+)\]", ".[$1]"), r"\.")
    return F.filter(steps, lambda s: s != "")


def dotted(path: Column) -> Column:
    return F.regexp_replace(F.array_join(path, "."), r"\.(\[\d+\])", "$1")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, path, change, old, new) of leaves that were added, removed or changed."""
    old, new = (t.select("id", "path", F.col("value").alias(name)) for t, name in ((before, "old"), (after, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return old.join(new, ["id", "path"], "full_outer").where("NOT (old <=> new)").select("id", "path", change.alias("change"), "old", "new")


def _above(path: Column, least: int, own: bool) -> Column:
    """A path's beginnings of ``least`` steps or more, itself included if asked."""
    top = F.size(path) if own else F.size(path) - 1
    return F.when(top >= least, F.transform(F.sequence(F.lit(least), top), lambda n: F.slice(path, F.lit(1), n))).otherwise(F.array().cast("array<array<string>>"))


def patched(leaves: DataFrame, changes: DataFrame) -> DataFrame:
    """Leaves (id, path, place, kind, value) after changes (id, seq, path, value): each sets a path to a JSON value, or removes it if that is null.

    Later changes, by ``seq``, count before earlier ones. What is at or below the path goes; a value above it that had no
    parts becomes an object or array with the path in it, so parents are made as needed. New leaves come after all others.
    A leaf stays if no later change is at a beginning of its path or below it: both are joins by equality, of beginnings
    with paths.
    """
    rows = changes.select("id", F.col("seq").cast("bigint").alias("seq"), "path", "value")
    own = flattened(rows.withColumn("target", F.col("path")).drop("path"), "id", "value", ("seq", "target"))
    own = own.select("id", F.concat("target", "path").alias("path"), (F.col("place") + F.lit(1 << 30)).alias("place"), "kind", "value", "seq")
    every = leaves.select("id", "path", "place", "kind", "value", F.lit(-1).cast("bigint").alias("seq")).unionByName(own)
    at = rows.groupBy("id", "path").agg(F.max("seq").alias("later"))
    under = rows.where("value IS NOT NULL").select("id", "seq", F.explode(_above(F.col("path"), 0, False)).alias("path")).groupBy("id", "path").agg(F.max("seq").alias("below"))
    keyed = every.select("id", "path", "place", "kind", "value", "seq", F.explode(_above(F.col("path"), 0, True)).alias("start"))
    over = keyed.join(at.withColumnRenamed("path", "start"), ["id", "start"]).groupBy("id", "path", "seq").agg(F.max("later").alias("later"))
    kept = every.join(over, ["id", "path", "seq"], "left").join(under, ["id", "path"], "left")
    kept = kept.where(F.coalesce(F.col("later") <= F.col("seq"), F.lit(True)) & F.coalesce(F.col("below") <= F.col("seq"), F.lit(True)))
    place = F.row_number().over(Window.partitionBy("id").orderBy("place", "seq", "path")) - 1
    return kept.select("id", "path", place.cast("int").alias("place"), "kind", "value")


def rebuilt(leaves: DataFrame) -> DataFrame:
    """(id, state): JSON texts of leaves, from the deepest level up; keys in order of their first leaf, places of arrays closed up.

    A level is one grouping by parent. Where a parent has both keys and places, it is an object, and its places are keys.
    The number of levels is asked for once.
    """
    deepest = leaves.agg(F.max(F.size("path"))).first()[0] or 0
    rows = leaves.select("id", "path", "place", "value")
    place = F.regexp_extract("step", r"^\[(\d+)\]$", 1)
    name = F.when(place != "", place).otherwise(F.regexp_replace("step", r"^\\", ""))
    text = F.to_json(F.array(name))
    for depth in range(deepest, 0, -1):
        deep = F.size("path") == depth
        rows = rows.withColumn("step", F.when(deep, F.element_at("path", -1))).withColumn("parent", F.when(deep, F.slice("path", 1, depth - 1)).otherwise(F.col("path")))
        child = F.struct("place", F.when(place != "", place.cast("bigint")).alias("n"), F.substring(text, F.lit(2), F.length(text) - 2).alias("key"), "value")
        rows = rows.groupBy("id", "parent").agg(
            F.sort_array(F.collect_list(F.when(F.col("step").isNotNull(), child))).alias("children"), F.max(F.when(F.col("step").isNull(), F.col("value"))).alias("own"), F.min("place").alias("place")
        )
        children = F.col("children")
        listed = F.transform(F.array_sort(F.transform(children, lambda c: F.struct(c["n"].alias("n"), c["value"].alias("value")))), lambda c: c["value"])
        members = F.transform(children, lambda c: F.concat(c["key"], F.lit(":"), c["value"]))
        array = F.forall(children, lambda c: c["n"].isNotNull())
        whole = F.when(array, F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))).otherwise(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))
        rows = rows.select("id", F.col("parent").alias("path"), "place", F.when(F.size(children) > 0, whole).otherwise(F.col("own")).alias("value"))
    return rows.select("id", F.col("value").alias("state"))
