"""A vector index: coarse cells with short codes of every vector, and exact scores for the few that the codes leave.

Below the index's folder, ``model`` holds what was fitted on a sample; each segment has ``codes``, sorted by cell, and
``vectors``, in folders by a hash of the id, so that the vectors of a few ids are few files. Vectors are taken at length
one, so an inner product is the cosine similarity. Rows without a vector, or with one of zeros, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrow import whole_runs
from .search import cosine

#: Rows that a model is fitted on at most; the only thing here that is not made of all rows.
SAMPLE = 8192
#: Rows of a cell's part, and questions, that meet in one tile; folders of vectors; scores of a product.
ROWS, ASKED, SLOTS, SCORES = 1 << 16, 1 << 15, 64, 1 << 22
#: Width of a uniform quantiser's steps in standard deviations, by bits, that leaves the least squared error of normal values.
STEPS = {1: 1.596, 2: 0.9957, 4: 0.3352, 8: 0.0308}


@dataclass(frozen=True)
class Model:
    """Centres of cells, and for each dimension a quantiser's lowest level and step."""

    centres: np.ndarray
    low: np.ndarray
    step: np.ndarray
    bits: int

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes of vectors, and how far each is from what its code stands for."""
        values = np.clip(np.rint((unit - self.low) / self.step), 0, (1 << self.bits) - 1).astype(np.uint8)
        error = np.linalg.norm(unit - (self.low + values * self.step), axis=1)
        planes = (values[:, :, None] >> np.arange(self.bits, dtype=np.uint8)) & 1
        return np.packbits(planes.reshape(len(unit), -1), axis=1), error

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        planes = np.unpackbits(codes, axis=1, count=len(self.low) * self.bits).reshape(len(codes), -1, self.bits)
        return self.low + (planes << np.arange(self.bits, dtype=np.uint8)).sum(2) * self.step


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length one, and which rows have a length."""
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.linalg.norm(matrix, axis=1)
    keep = np.flatnonzero(norm > 0)
    return matrix[keep] / norm[keep, None], keep


def fitted(rows: DataFrame, cells: int | None = None, bits: int = 2, sample: int = SAMPLE, rounds: int = 12, vector_col: str = "embedding", id_col: str = "id") -> Model:
    """Cells by spherical k-means and quantisers from at most ``sample`` rows, those with the least hashes of their ids.

    By default there are as many cells as the square root of the rows says, and one for eight sampled rows at most.
    """
    given = rows.where(F.col(vector_col).isNotNull())
    n = given.count()
    some = given.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).toArrow()
    unit, _ = _units(some.column(0).combine_chunks().cast(pa.list_(pa.float32()))) if n else (np.zeros((0, 1)), None)
    if not len(unit):
        return Model(np.zeros((1, 1)), np.zeros(1), np.ones(1), bits)
    cells = min(cells or max(1, int(n**0.5)), max(1, len(unit) // 8))
    rng = np.random.default_rng(1)
    centres = unit[rng.choice(len(unit), cells, replace=False)]
    for _ in range(rounds):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    spread = np.maximum(unit.std(0), 1e-9)
    step = spread * STEPS[bits]
    return Model(centres, unit.mean(0) - step * ((1 << bits) - 1) / 2, step, bits)


def stored(spark: SparkSession, model: Model, root: str) -> None:
    """Writes a model, a row for each cell and one for the quantiser, so that later segments are made with the same one."""
    rows = [("cell", i, x.tolist(), None, model.bits) for i, x in enumerate(model.centres)] + [("levels", -1, model.low.tolist(), model.step.tolist(), model.bits)]
    spark.createDataFrame(rows, "kind string, cell int, a array<double>, b array<double>, bits int").coalesce(1).write.mode("overwrite").parquet(f"{root}/model")


def loaded(spark: SparkSession, root: str) -> Model:
    """The model below a folder; it has a bounded number of cells."""
    rows = spark.read.parquet(f"{root}/model").orderBy("cell").collect()
    return Model(np.array([r["a"] for r in rows[1:]]), np.array(rows[0]["a"]), np.array(rows[0]["b"]), rows[0]["bits"])


def _slot(id_: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(slots)).cast("int")


def _facet(name: str) -> str:
    return f"facet {name}"


def built(rows: DataFrame, root: str, segment: str, model: Model, id_col: str = "id", vector_col: str = "embedding", slots: int = SLOTS, facets: tuple[str, ...] = ()) -> None:
    """Writes every row as one segment; writing a segment of the same name again replaces it. Ids are keys.

    ``facets`` are columns that questions may restrict; they are kept as text beside the codes.
    """
    extra = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(_facet(f)) for f in facets]
    given = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"), *extra)
    kind = given.schema["id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, keep = _units(batch.column(1))
            packed, error = model.codes(unit)
            cell = np.argmax(unit @ model.centres.T, axis=1)
            columns = [pa.array(cell.astype(np.int32)), batch.column(0).take(pa.array(keep)), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns + [c.take(pa.array(keep)) for c in batch.columns[2:]], names=["cell", "id", "code", "error", "same", *names])

    names = [_facet(f) for f in facets]
    schema = f"cell int, id {kind}, code binary, error double, same long" + "".join(f", `{n}` string" for n in names)
    coded = given.select("id", "embedding", F.xxhash64("embedding", *names).alias("same"), *names).mapInArrow(code, schema)
    # codes come last: without them a segment is not there
    placed = given.select("id", "embedding", _slot(F.col("id"), slots).alias("slot"))
    placed.repartitionByRange("slot", "id").write.partitionBy("slot").mode("overwrite").parquet(f"{root}/vectors/segment={segment}")
    coded.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{root}/codes/segment={segment}")


@dataclass(frozen=True)
class Index:
    codes: DataFrame
    vectors: DataFrame
    model: Model
    slots: int = SLOTS
    facets: tuple[str, ...] = ()


def opened(spark: SparkSession, root: str, slots: int = SLOTS, id_type: str = "bigint", facets: tuple[str, ...] = ()) -> Index:
    """The index below a folder, with all segments that are there now."""
    extra = "".join(f"`{_facet(f)}` string, " for f in facets)
    codes = spark.read.schema(f"cell int, id {id_type}, code binary, error double, same bigint, {extra}segment string").parquet(f"{root}/codes")
    vectors = spark.read.schema(f"id {id_type}, embedding array<float>, segment string, slot int").parquet(f"{root}/vectors")
    return Index(codes, vectors, loaded(spark, root), slots, facets)


def _cells(model: Model, probes: int):
    """Questions (query_id, vector, facets) at length one with the cells nearest to each."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, keep = _units(batch.column(1))
            n = min(probes, len(model.centres))
            scores = unit @ model.centres.T
            best = np.argpartition(-scores, n - 1, axis=1)[:, :n] if len(unit) else np.zeros((0, n), np.int64)
            columns = [batch.column(0).take(pa.array(keep)), pa.array(unit.tolist(), pa.list_(pa.float64())), pa.array(best.tolist(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns + [c.take(pa.array(keep)) for c in batch.columns[2:]], names=["query_id", "unit", "cells", *batch.schema.names[2:]])

    return near


def _allowed(asked: pa.Table, own: pa.Table, facets: tuple[str, ...]) -> np.ndarray:
    """Which rows each question may have: those with one of its values in every facet that it restricts."""
    out = np.ones((asked.num_rows, own.num_rows), bool)
    for f in facets:
        values = own.column(_facet(f)).combine_chunks().dictionary_encode()
        place = {v: i for i, v in enumerate(values.dictionary.to_pylist())}
        rows = values.indices.to_numpy()
        for q, wanted in enumerate(asked.column(f"wanted {f}").to_pylist()):
            if wanted is not None:
                flags = np.zeros(len(place), bool)
                flags[[place[v] for v in wanted if v in place]] = True
                out[q] &= flags[rows]
    return out


def _tiles(model: Model, k: int, keep: int, exact: bool, facets: tuple[str, ...]):
    """Candidates of tiles (cell, part, group): questions (mark 0) come before the codes that they are to meet (mark 1).

    Of equal vectors only the k smallest ids can be among the k best. With ``exact``, all rows stay whose score can be
    among the k best as far as their codes' errors tell, else the ``keep`` best by their codes.
    """

    def tile(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        mark = rows.column("mark").to_numpy()
        asked, own = rows.slice(0, int((mark == 0).sum())), rows.slice(int((mark == 0).sum()))
        if not asked.num_rows or not own.num_rows:
            return
        own = own.take(pa.array(_copies(own, k)))
        ids, error = own.column("id").combine_chunks(), own.column("error").to_numpy()
        width = -(-len(model.low) * model.bits // 8)
        codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(-1, width)
        unit = asked.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(asked.num_rows, -1)
        values = np.empty((len(codes), len(model.low)))
        for low in range(0, len(codes), 4096):
            values[low : low + 4096] = model.decoded(codes[low : low + 4096])
        some = min(k if exact else keep, len(codes)) - 1
        step = max(1, SCORES // len(codes))
        for low in range(0, len(unit), step):
            score = unit[low : low + step] @ values.T
            allowed = _allowed(asked.slice(low, step), own, facets)
            score = np.where(allowed, score, -np.inf)
            floor = score - error if exact else score
            least = -np.partition(-floor, some, axis=1)[:, some : some + 1]
            question, row = np.nonzero(allowed & (score + error >= least - 1e-9 if exact else score >= least))
            found = score[question, row]
            yield pa.RecordBatch.from_arrays(
                [asked.column("query_id").combine_chunks().take(pa.array(question + low)), ids.take(pa.array(row)), pa.array(found), pa.array(error[row])], names=["query_id", "id", "guess", "error"]
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_runs(batches, "cell", "part", "team"):
            for a, b in zip(starts, np.append(starts[1:], rows.num_rows), strict=True):
                yield from tile(rows.slice(int(a), int(b - a)))

    return scan


def _copies(rows: pa.Table, k: int) -> np.ndarray:
    """Places of the rows that are among the k smallest ids of their equal vectors."""
    order = rows.select(["same", "id"]).append_column("at", pa.array(np.arange(rows.num_rows))).sort_by([("same", "ascending"), ("id", "ascending")])
    same = order.column("same").to_numpy()
    first = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
    rank = np.arange(len(same)) - np.repeat(first, np.diff(np.append(first, len(same))))
    return np.sort(order.column("at").to_numpy()[rank < k])


def nearest(index: Index, questions: DataFrame, k: int, probes: int = 1 << 30, refine: int = 10, exact: bool = False) -> DataFrame:
    """(query_id, id, score): the k nearest rows of each question of a table (query_id, vector), ties by id.

    For each facet that the index has, the table may have a column of that name with the values that a question allows, an
    array of texts; null, or no such column, allows all. Each question meets the codes of its ``probes`` nearest cells, by default of all. The ``refine`` * k best by their codes
    are scored by their vectors, to 12 digits. With ``exact`` and all cells, the rows whose codes leave a chance are
    scored instead, and the answer is that of a full scan; that takes codes of 8 bits to be few.

    Questions with one vector and the same limits are answered once. Cells and questions are cut into parts that meet in
    tiles, by matrix products; a large cell or many questions make more tiles, not larger ones. Where all cells are to be
    met, rows are cut by their ids instead, so that a question is copied for each ``ROWS`` of them, not for each cell. Candidates meet their vectors by (slot, id); for few questions Spark reads only
    these slots' folders.
    """
    kind = questions.schema["query_id"].dataType.simpleString()
    id_kind = index.codes.schema["id"].dataType.simpleString()
    wanted = [f"wanted {f}" for f in index.facets]
    limits = [(F.array_sort(F.col(f)) if f in questions.columns else F.lit(None)).cast("array<string>").alias(w) for f, w in zip(index.facets, wanted, strict=True)]
    given = questions.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"), *limits)
    given = given.groupBy("vector", *wanted).agg(F.collect_list("query_id").alias("asking")).withColumn("query_id", F.array_min("asking"))
    schema = f"query_id {kind}, unit array<double>, cells array<int>" + "".join(f", `{w}` array<string>" for w in wanted)
    every_cell = probes >= len(index.model.centres)
    asked = given.select("query_id", "vector", *wanted).mapInArrow(_cells(index.model, 1 if every_cell else probes), schema)
    asked = asked.select("query_id", "unit", (F.lit(0) if every_cell else F.explode("cells")).alias("cell"), *wanted)
    codes = index.codes.withColumn("cell", F.lit(0)) if every_cell else index.codes
    # one row for each cell, of which the model has a bounded number
    teams = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("teams"))
    parts = codes.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts"))
    shape = F.broadcast(teams.join(parts, "cell"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(shape, "cell").select(
        "cell", every("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("teams")).cast("int").alias("team"), F.lit(0).alias("mark"), "query_id", "unit",
        F.lit(None).cast(id_kind).alias("id"), F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("error"), F.lit(None).cast("bigint").alias("same"),
        *wanted, *(F.lit(None).cast("string").alias(_facet(f)) for f in index.facets),
    )
    right = codes.join(shape, "cell").select(
        "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), every("teams").alias("team"), F.lit(1).alias("mark"), F.lit(None).cast(kind).alias("query_id"),
        F.lit(None).cast("array<double>").alias("unit"), "id", "code", "error", "same",
        *(F.lit(None).cast("array<string>").alias(w) for w in wanted), *(_facet(f) for f in index.facets),
    )
    n = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = ["cell", "part", "team"]
    both = left.unionByName(right).repartition(n, *tile).sortWithinPartitions(*tile, "mark")
    found = both.mapInArrow(_tiles(index.model, k, refine * k, exact, index.facets), f"query_id {kind}, id {id_kind}, guess double, error double")
    own = Window.partitionBy("query_id")
    if exact:
        floor = F.col("guess") - F.col("error")
        few = found.withColumn("at", F.row_number().over(own.orderBy(F.desc(floor)))).withColumn("floor", F.min(F.when(F.col("at") <= k, floor)).over(own))
        few = few.where(F.col("guess") + F.col("error") >= F.col("floor") - 1e-9)
    else:
        few = found.withColumn("at", F.row_number().over(own.orderBy(F.desc("guess"), "id"))).where(F.col("at") <= refine * k)
    few = few.select("query_id", "id", _slot(F.col("id"), index.slots).alias("slot"))
    scored = few.join(index.vectors.select("slot", "id", "embedding"), ["slot", "id"]).join(given.select("query_id", "vector"), "query_id")
    scored = scored.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("vector")), 12).alias("score"))
    best = scored.withColumn("at", F.row_number().over(own.orderBy(F.desc("score"), "id"))).where(F.col("at") <= k).drop("at")
    return best.withColumnRenamed("query_id", "first").join(given.select(F.col("query_id").alias("first"), F.explode("asking").alias("query_id")), "first").select("query_id", "id", "score")


def completed(index: Index, questions: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k nearest, of answers ``found`` by coarse codes and of what these missed.

    What they missed comes from an exact search of an index of the same rows with fine codes (see ``nearest``), which costs
    a second scan of codes and few vectors; scores of both are true ones, so the best of all are those of a full scan.
    """
    more = nearest(index, questions, k, exact=True).join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = found.select("query_id", "id", "score").unionByName(more.select("query_id", "id", "score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return both.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).drop("at")
