"""Retrieval: dense and keyword top-k, rank fusion and reranking, for one question or a table of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vocab import CANDIDATES, FINAL, RRF_K

#: Okapi BM25's saturation and length weights.
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def index_terms(text: Column, language: str = "english") -> Column:
    """A text's tokens without the language's common words, as Spark's own list of these has them."""
    return F.filter(tokens(text), lambda t: ~t.isin(*StopWordsRemover.loadDefaultStopWords(language)))


def query_terms(text: Column) -> Column:
    """A question's terms: what spaces separate, if all letters or digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), " "), lambda t: t.rlike(r"^[\p{L}\p{N}]+$")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is all zeros."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def dense_top_k(chunks: DataFrame, vector: list[float], k: int = CANDIDATES, where: Column | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the k chunks nearest to one vector, ties by id; chunks without a vector are left out."""
    rows = chunks if where is None else chunks.where(where)
    score = cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in vector)))
    return rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)


def keyword_top_k(chunks: DataFrame, terms: tuple[str, ...], k: int = CANDIDATES, every: bool = True, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score) of the k best chunks by BM25, ties by id; with ``every``, chunks that have all terms.

    Each scan, one for the totals and one for the scores, splits a text into tokens once: lengths and the terms' counts
    come out of a generator, past which no filter on them can be pushed. Nothing is shuffled but the totals and the k best
    rows of each task.
    """
    if not terms:
        return chunks.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    found = tokens(F.col(text_col))
    counts = [(F.size("found") - F.size(F.array_remove("found", w))).alias(f"tf{i}") for i, w in enumerate(terms)]
    rows = chunks.select(F.col(id_col).alias("id"), F.explode(F.array(found)).alias("found")).select("id", F.inline(F.array(F.struct(F.size("found").alias("n"), *counts))))
    totals = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    hits = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    match = hits[0]
    for h in hits[1:]:
        match = (match & h) if every else (match | h)
    return rows.where(match).crossJoin(F.broadcast(totals)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def ranked(rows: DataFrame) -> DataFrame:
    """Ranks from 1 by score, ties by id; only for a list that is already cut to the best."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fused(*branches: DataFrame, k: int = CANDIDATES, rrf_k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal rank fusion of branches that are cut to their best already."""
    parts = [ranked(b).select("id", (1.0 / (rrf_k + F.col("rank"))).alias("part")) for b in branches]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fused_batch(*branches: DataFrame, k: int = CANDIDATES, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, id, score): ``fused`` for each question of branches (query_id, id, score), each cut to its best already."""
    own = Window.partitionBy("query_id")
    parts = [b.select("query_id", "id", (1.0 / (rrf_k + F.row_number().over(own.orderBy(F.desc("score"), "id")))).alias("part")) for b in branches]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    total = rows.groupBy("query_id", "id").agg(F.round(F.sum("part"), 12).alias("score"))
    return total.withColumn("at", F.row_number().over(own.orderBy(F.desc("score"), "id"))).where(F.col("at") <= k).drop("at")


def reranked(rows: DataFrame, scorer=None, k: int = FINAL) -> DataFrame:
    """The best k rows, by a scorer's column if there is one, else by the scores they have."""
    rows = rows if scorer is None else rows.withColumn("score", scorer)
    return rows.orderBy(F.desc("score"), "id").limit(k)


def _nearest(ids: pa.Array, vectors: np.ndarray, k: int):
    """For Arrow batches (id, embedding): the task's best k of every question, by one matrix product for each batch."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((len(unit), k), -np.inf)
        held: np.ndarray | None = None
        kind = None
        for batch in batches:
            rows = batch.column(1)
            if not batch.num_rows:
                continue
            matrix = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            norm = np.linalg.norm(matrix, axis=1)
            keep = np.flatnonzero(norm > 0)
            kind, names = batch.column(0).type, np.array(batch.column(0).to_pylist())[keep]
            held = np.empty((len(unit), k), names.dtype) if held is None else held.astype(np.promote_types(held.dtype, names.dtype))
            if not len(keep):
                continue
            scores = np.round((matrix[keep] / norm[keep, None]) @ unit.T, 12)
            # a question's best so far and what is as good as the last of them, ties by id
            for q in np.flatnonzero(scores.max(0) >= top[:, -1]).tolist():
                own = scores[:, q]
                cut = max(top[q, -1], np.partition(own, -min(k, len(own)))[-min(k, len(own))])
                new = np.flatnonzero(own >= cut)
                score, name = np.concatenate([top[q], own[new]]), np.concatenate([held[q], names[new]])
                order = np.lexsort((name, -score))[:k]
                top[q], held[q] = score[order], name[order]
        if held is not None:
            q, at = np.nonzero(np.isfinite(top))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(held[q, at].tolist(), kind), pa.array(top[q, at])], names=["query_id", "id", "score"])

    return best


def dense_batch(chunks: DataFrame, queries: DataFrame, k: int = CANDIDATES, block: int = 4096) -> DataFrame:
    """(query_id, id, score): the k nearest chunks of each question of a table (query_id, vector).

    Questions are taken in blocks of about ``block``, each against all chunks: a block's vectors go to every task, which
    keeps the best k of each question over all that it reads, so k rows for each question and task are shuffled and no
    pair of all becomes a row. Scores are rounded to 12 digits, ties go to the smaller id.
    """
    blocks = max(1, -(-queries.count() // block))
    rows = chunks.where("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = None
    for b in range(blocks):
        part = queries.where((F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) & F.col("vector").isNotNull()).collect()
        if part:
            ids = pa.array([r["query_id"] for r in part], to_arrow_type(queries.schema["query_id"].dataType))
            near = _nearest(ids, np.array([r["vector"] for r in part], float), k)
            found = rows.mapInArrow(near, f"query_id {kinds[0]}, id {kinds[1]}, score double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def within_budget(rows: DataFrame, group: str, order: str, size: str, budget: int, width: int = 1 << 16) -> DataFrame:
    """``rows`` and their running ``total`` of ``size`` in each group, in the order of a whole number, as far as a budget goes.

    Sums of ranges of ``width`` numbers come first; only the few ranges that begin within the budget are read again and
    summed row by row, so a group is never one task's, however large it is. Sizes are not negative.
    """
    placed = rows.withColumn("its range", F.floor(F.col(order) / width)).withColumn("its group", F.coalesce(F.col(group).cast("string"), F.lit("")))
    sums = placed.groupBy("its group", "its range").agg(F.sum(size).alias("sum"))
    before = Window.partitionBy("its group").orderBy("its range").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).where(F.col("base") <= budget).drop("sum")
    inside = Window.partitionBy("its group", "its range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.join(begun, ["its group", "its range"]).withColumn("total", F.col("base") + F.sum(size).over(inside))
    return found.where(F.col("total") <= budget).select(*rows.columns, "total")


def context(rows: DataFrame, budget: int) -> DataFrame:
    """The first rows by rank whose tokens stay within a budget; it stops at the first that does not fit."""
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("total", F.sum("tokens").over(before)).where(F.col("total") <= budget)
