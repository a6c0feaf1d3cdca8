"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import blocks, documents, table

#: Words of a passage; hashed word buckets of its features.
PASSAGE, BUCKETS = 64, 24
#: Labelled documents that the model is fitted on at most; the bound keeps training on the driver small.
MAX_LABELLED = 4000
#: Score from which a document counts as good.
THRESHOLD = 0.3

_UPPER = W.byte_class(lambda b: 65 <= b <= 90)
_DIGIT = W.byte_class(lambda b: 48 <= b <= 57)
_SYMBOL = W.byte_class(lambda b: 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126)
_STOP = W.byte_class(lambda b: chr(b) in ".,;:")
_SHAPES = 11
FEATURES = _SHAPES + 2 + BUCKETS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a block of texts, and each text's first passage (one more entry than texts).

    A text without words has one passage of zeros. Features are means over a passage's words of their shape (length,
    capitals, digits, symbols, repetition of the word before), the share of distinct words, the passage's length, and
    shares of hashed words.
    """
    found = W.find(data, offsets, W.SOLID)
    counts = np.diff(found.first)
    each = np.maximum(1, -(-counts // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(each)])
    out = np.zeros((bounds[-1], FEATURES), np.float32)
    n = len(found.hash)
    if not n:
        return out, bounds
    which = bounds[found.row] + (np.arange(n) - found.first[found.row]) // PASSAGE
    size = (found.end - found.start).astype(np.float32)

    def held(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)])
        return total[found.end] - total[found.start]

    upper, digit, symbol = held(_UPPER), held(_DIGIT), held(_SYMBOL)
    last, head = data[found.end - 1], data[found.start]
    before_last = data[np.maximum(found.end - 2, found.start)]
    again = np.zeros(n, bool)
    again[1:] = (found.hash[1:] == found.hash[:-1]) & (found.row[1:] == found.row[:-1])
    shape = np.stack(
        [
            again,
            symbol == size,
            (upper >= 0.5 * size) & (size > 1),
            _SYMBOL[last] & ~_STOP[last],
            (last == before_last) & _SYMBOL[last] & (size > 1),
            _UPPER[head],
            _STOP[last],
            digit > 0,
            np.log1p(size) / 3,
            symbol / size,
            size > 20,
        ],
        axis=1,
    ).astype(np.float32)
    starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    length = np.diff(np.append(starts, n)).astype(np.float32)
    at = which[starts]
    out[at, :_SHAPES] = np.add.reduceat(shape, starts, axis=0) / length[:, None]
    _, first = np.unique(W.mix(found.hash + which.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    out[at, _SHAPES] = np.bincount(which[first], minlength=len(out))[at] / length
    out[at, _SHAPES + 1] = length / PASSAGE
    bucket = (found.hash % np.uint64(BUCKETS)).astype(np.int64)
    shares = np.bincount(which * BUCKETS + bucket, minlength=len(out) * BUCKETS).reshape(-1, BUCKETS)
    out[at, _SHAPES + 2 :] = shares[at] / length[:, None]
    return out, bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """Encoder, gated attention and output weights; features are centred and scaled first."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        w, heads = self.weights, bounds[:-1]
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["encode"] + w["encode_0"])
        t, g = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
        s = (t * g) @ w["attend"]
        row = np.repeat(np.arange(len(heads)), np.diff(bounds))
        e = np.exp(s - np.maximum.reduceat(s, heads)[row])
        a = e / np.add.reduceat(e, heads)[row]
        z = np.add.reduceat(a[:, None] * h, heads, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "row": row, "z": z, "score": _sigmoid(z @ w["out"] + w["out_0"])}

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each bag's probability of the label 1."""
        return self.forward(x, bounds)["score"] if len(bounds) > 1 else np.empty(0)

    def gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f, heads = self.weights, self.forward(x, bounds), bounds[:-1]
        d_out = (f["score"] - y) / len(y)
        dz = (d_out[:, None] * w["out"])[f["row"]]
        da = (dz * f["h"]).sum(1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, heads)[f["row"]])
        dt = ds[:, None] * w["attend"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * w["attend"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ w["value"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
        return {
            "encode": f["x"].T @ dh,
            "encode_0": dh.sum(0),
            "value": f["h"].T @ dt,
            "gate": f["h"].T @ dg,
            "attend": (f["t"] * f["g"]).T @ ds,
            "out": f["z"].T @ d_out,
            "out_0": d_out.sum(keepdims=True),
        }


def fit(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 300, rate: float = 0.02, decay: float = 1e-4) -> AttentionModel:
    """Fits the model to labelled bags by Adam on the cross-entropy, from a fixed seed."""
    rng = np.random.default_rng(11)
    d = x.shape[1]
    weights = {
        "encode": rng.normal(0, d**-0.5, (d, hidden)),
        "encode_0": np.zeros(hidden),
        "value": rng.normal(0, hidden**-0.5, (hidden, gate)),
        "gate": rng.normal(0, hidden**-0.5, (hidden, gate)),
        "attend": rng.normal(0, gate**-0.5, gate),
        "out": rng.normal(0, hidden**-0.5, hidden),
        "out_0": np.zeros(1),
    }
    scale = x.std(0)
    model = AttentionModel(x.mean(0), np.where(scale > 1e-6, scale, 1.0), weights)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, steps + 1):
        for k, grad in model.gradients(x, bounds, y).items():
            grad = grad + decay * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch):
            x, bounds = passages(data, offsets)
            bags = [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(bags, pa.binary())], names=["label", "bag"])


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> AttentionModel | None:
    """A model from the labelled documents whose fold is not 0; None if these lack one of the two labels.

    At most ``max_labelled`` documents are used, those with the smallest hashes of their ids; their passages come to
    the driver as features, not as texts. Of several labels of an id the mean counts.
    """
    known = (
        labels.select(labels[label_id_col].alias("doc_id"), labels[label_col].cast("double").alias("label"))
        .where(F.col("label").isNotNull() & (fold("doc_id") != 0))
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    bags = documents(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("label", "text", "doc_id")
    rows = bags.mapInArrow(_bags, "label int, bag binary").collect()
    rows = sorted((r["label"], bytes(r["bag"])) for r in rows)
    y = np.array([r[0] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    x = [np.frombuffer(r[1], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(np.concatenate(x).astype(float), np.concatenate([[0], np.cumsum([len(b) for b in x])]), y)


def _scored(model: AttentionModel | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(offsets) - 1, 0.5)
    return model.score(*passages(data, offsets))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, **columns: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A document is a bag of passages of 64 words, all of its text. Each passage is encoded; gated attention weighs the
    encodings; the weighted sum gives the probability that the document's label is 1. The model learns from labelled
    documents whose crc32(id as text) mod 5 is not 0 and sees texts only. Scoring is one scan without a shuffle.

    A null or empty text is one passage without words and gets a score as any other. A null id is never learned from
    and counts as held out. Repeated rows get the same scores; other columns are ignored, whatever their names; an
    empty table gives an empty result. Without labels of both kinds all scores are 0.5.
    """
    model = learned(docs, labels, id_col, text_col, max_labelled=max_labelled, **columns)
    source = documents(docs, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scored(model, data, offsets), pa.float64())], names=["doc_id", "score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, **columns: str) -> DataFrame:
    """``docs`` with all its columns, without the rows whose ``quality_scores`` score is below the threshold."""
    model = learned(docs, labels, id_col, text_col, max_labelled=max_labelled, **columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, text_col):
                yield part.take(pa.array(np.flatnonzero(_scored(model, data, offsets) >= threshold)))

    return docs.mapInArrow(keep, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality_scores`` of all documents, learned from ``labels.quality``."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
