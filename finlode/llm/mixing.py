"""Mixing documents to target weights by soft domain membership."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import blocks, documents, saved, table

#: Hashed words of the domain classifier; labelled documents it is fitted on at most.
BUCKETS, MAX_LABELLED = 1 << 12, 4000
#: Share of the token total that each domain should have: the weight of a domain is its labelled share to this power.
FLATTEN = 0.7
#: How far the default total is above the least at which no domain is thinned out, so that no document's rate is below 1.
HEADROOM = 1.05


@dataclass
class DomainModel:
    """Multinomial logistic regression over shares of hashed words."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, shares: np.ndarray) -> np.ndarray:
        z = shares @ self.weights + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def word_shares(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shares of hashed words, as square roots, and its number of words (runs of characters other than white space)."""
    found = W.find(data, offsets, W.SOLID)
    n = len(offsets) - 1
    counts = np.diff(found.first)
    place = found.row * BUCKETS + (found.hash % np.uint64(BUCKETS)).astype(np.int64)
    table_ = np.bincount(place, minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.sqrt(table_ / np.maximum(counts, 1)[:, None]).astype(np.float32), counts


def fit(shares: np.ndarray, domain: np.ndarray, domains: list[str], steps: int = 150, rate: float = 0.3, decay: float = 1e-4) -> DomainModel:
    """Fits the classifier by Adam from zero."""
    y = np.eye(len(domains))[domain]
    model = DomainModel(domains, np.zeros((shares.shape[1], len(domains))), np.zeros(len(domains)))
    parts = [model.weights, model.bias]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in parts]
    for step in range(1, steps + 1):
        d = (model.posteriors(shares) - y) / len(y)
        for w, g, m in zip(parts, (shares.T @ d + decay * model.weights, d.sum(0)), moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            w -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return model


#: Texts of one classifier step; with BUCKETS it bounds the table of shares in memory.
STEP = 512


def _steps(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for low in range(0, batch.num_rows, STEP):
        yield from blocks(batch.slice(low, STEP), text)


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domain_col: str, label_id_col: str, max_labelled: int) -> DomainModel | None:
    """A classifier from the documents that the labelled table names; their domain is ``domain_col``. None without any.

    At most ``max_labelled`` documents are used, those with the smallest hashes of their ids.
    """
    known = labels.select(labels[label_id_col].alias("doc_id")).where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[domain_col].cast("string").alias("domain")).where("domain IS NOT NULL AND text IS NOT NULL")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _steps(batch):
                found, counts = word_shares(data, offsets)
                rows = [x.tobytes() for x in found.astype(np.float16)]
                keep = pa.array(counts > 0)
                yield pa.RecordBatch.from_arrays([part.column("domain").filter(keep), pa.array(rows, pa.binary()).filter(keep)], names=["domain", "shares"])

    rows = texts.join(F.broadcast(known), "doc_id").select("domain", "text").mapInArrow(shares, "domain string, shares binary").collect()
    if not rows:
        return None
    rows = sorted((r["domain"], bytes(r["shares"])) for r in rows)
    domains = sorted({r[0] for r in rows})
    x = np.stack([np.frombuffer(r[1], np.float16) for r in rows]).astype(np.float32)
    return fit(x, np.array([domains.index(r[0]) for r in rows]), domains)


def domain_posteriors(docs: DataFrame, model: DomainModel, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tie, n_tokens, posterior): each document's words and its probabilities of the model's domains."""
    source = documents(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _steps(batch):
                shares, counts = word_shares(data, offsets)
                p = model.posteriors(shares)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tie"), pa.array(counts, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))],
                    names=["doc_id", "tie", "n_tokens", "posterior"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(scan, f"doc_id {kind}, tie long, n_tokens long, posterior array<double>")


def _posteriors(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """A row of probabilities for each row of a batch."""
    return batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


@dataclass
class Fit:
    """The fitted rates: their start, the steps' moves, the totals that they give and should give, and whether steps settled."""

    start: float
    moves: list[np.ndarray]
    totals: np.ndarray
    targets: np.ndarray
    converged: bool

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        """The rates of documents with these posteriors."""
        rate = np.full(len(posteriors), self.start)
        for move in self.moves:
            rate = np.maximum(0.0, rate + posteriors @ move)
        return rate


def fit_rates(members: DataFrame, targets: np.ndarray, start: float, max_steps: int = 60, tolerance: float = 1e-6) -> Fit:
    """Projected-gradient least squares for rates r >= 0 so that sum of r * tokens * posterior is the target of each domain.

    Rates are measured in tokens and residuals in the inverse of the matrix sum tokens * posterior * posterior', so the
    gradient step of a document is posterior . (inverse . residual), of length one, the same for equal posteriors. The
    matrix is that of the documents whose rates are not at the bound, as only these can move; where such a step leads
    away from the targets, that of all documents is taken, which cannot. Each step is one distributed sum of as many
    numbers as there are domains and pairs of them; documents stay where they are, and a document's rate is recomputed
    from its posterior and the steps so far. The plan of a step is the same each time, only its numbers differ. It ends
    when the totals meet the targets or no longer change, by ``tolerance`` of all tokens; a fit that has not settled
    after ``max_steps`` says so, with a warning.
    """
    n = len(targets)
    limit = tolerance * max(targets.sum(), 1)
    moves: list[np.ndarray] = []
    upper = np.triu_indices(n)
    names = [f"s{i}" for i in range(n + len(upper[0]))]

    def summed() -> tuple[np.ndarray, np.ndarray]:
        """Totals with the moves so far, and the inverse matrix of the documents that are not at the bound."""
        fit = Fit(start, list(moves), targets, targets, False)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(names))
            for batch in batches:
                p, tokens = _posteriors(batch, n), batch.column("n_tokens").to_numpy().astype(float)
                rate = fit.rates(p)
                free = p[rate > 0]
                out[:n] += (rate * tokens) @ p
                out[n:] += (free.T @ (free * tokens[rate > 0, None]))[upper]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=names)

        sums = members.select("n_tokens", "posterior").mapInArrow(partial, ", ".join(f"{x} double" for x in names))
        found = np.array(list(sums.agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in names)).first()), float)
        matrix = np.zeros((n, n))
        matrix[upper] = found[n:]
        return found[:n], np.linalg.pinv(matrix + np.triu(matrix, 1).T, rcond=1e-9)

    totals, inverse = summed()
    everyone, settled = inverse, np.abs(totals - targets).max() <= limit
    while not settled and len(moves) < max_steps:
        residual = totals - targets
        for use in (inverse, everyone):
            moves.append(-use @ residual)
            new, free = summed()
            if (new - targets) @ everyone @ (new - targets) <= residual @ everyone @ residual or use is everyone:
                break
            moves.pop()
        settled = np.abs(new - targets).max() <= limit or np.abs(new - totals).max() <= limit
        totals, inverse = new, free
    if not settled:
        warnings.warn(f"rates have not settled after {max_steps} steps; largest residual {np.abs(totals - targets).max():.4g} tokens", RuntimeWarning, stacklevel=2)
    return Fit(start, moves, totals, targets, bool(settled))


def learned_mix(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float] | None,
    total: float | None,
    id_col: str,
    text_col: str,
    domain_col: str,
    label_id_col: str,
    max_labelled: int,
    total_share: float | None = None,
) -> tuple[DomainModel, Fit, DataFrame] | None:
    """The classifier, the fitted rates, and the table (doc_id, tie, n_tokens, posterior) that they were fitted on."""
    model = learned(docs, labels, id_col, text_col, domain_col, label_id_col, max_labelled)
    if model is None:
        return None
    members = saved(domain_posteriors(docs, model, id_col, text_col))
    n = len(model.domains)
    sums = members.agg(*(F.coalesce(F.sum(F.col("n_tokens") * F.col("posterior")[d]), F.lit(0.0)) for d in range(n))).first()
    mass = np.array(list(sums), float)
    if weights is None:
        share = (mass / max(mass.sum(), 1)) ** FLATTEN
    else:
        share = np.array([float(weights.get(d, 0.0)) for d in model.domains])
    share = share / share.sum() if share.sum() else np.full(n, 1 / n)
    if total is None and total_share is not None:
        total = total_share * float(mass.sum())
    if total is None:
        total = HEADROOM * float((mass[share > 0] / share[share > 0]).max())
    return model, fit_rates(members, total * share, total / max(mass.sum(), 1)), members


def _draw(id_: Column, tie: Column, seed: int) -> Column:
    """A fixed number in [0, 1) for an id, a hash of a text and a seed."""
    return F.pmod(F.xxhash64(F.lit(seed), id_, tie), F.lit(1 << 30)) / float(1 << 30)


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "lang",
    label_id_col: str = "doc_id",
    max_labelled: int = MAX_LABELLED,
    seed: int = 7,
    total_share: float | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, domain, posterior, rate, copies, domain_target, domain_reached.

    A classifier, fitted on the documents that the labelled table names, gives each document's probabilities of the
    domains. Rates are fitted so that the domains' expected tokens, rate * tokens * probability summed over all
    documents, are ``total`` times ``weights``; weights are scaled to sum 1, and domains not named have weight 0. By
    default a weight is the domain's expected share to the power FLATTEN, and the total is ``total_share`` times the corpus's
    tokens if that is given, else HEADROOM times the least at which no domain has fewer tokens than there are. ``copies``
    is the rate rounded up or down with the odds of its fraction, by a hash of id, text and seed, so reruns agree.
    ``domain`` is a document's likeliest, with its target and the expected tokens that the rates reach.

    A null or empty text has no tokens, the classifier's posterior for no words, and the rate of that posterior. Rows
    that repeat id and text have the same rate and copies; null ids are ids like others. Without labelled documents
    every rate is 1. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    mix = learned_mix(docs, labels, weights, total, id_col, text_col, domain_col, label_id_col, max_labelled, total_share)
    if mix is None:
        words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
        none = F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("posterior")
        return documents(docs, id_col, text_col).select("doc_id", F.size(words).cast("long").alias("n_tokens"), *none, F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), *(F.lit(None).cast("double").alias(c) for c in ("domain_target", "domain_reached")))
    model, fitted, found = mix
    n = len(model.domains)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fitted.rates(_posteriors(batch, n)))], names=[*batch.schema.names, "rate"])

    kind = found.schema["doc_id"].dataType.simpleString()
    found = found.mapInArrow(rated, f"doc_id {kind}, tie long, n_tokens long, posterior array<double>, rate double")
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    names = F.array(*(F.lit(d) for d in model.domains))
    rate = F.col("rate")
    up = (_draw(F.col("doc_id"), F.col("tie"), seed) < rate - F.floor(rate)).cast("int")
    of_domain = lambda values, name: F.element_at(F.array(*(F.lit(float(x)) for x in values)), best).alias(name)
    return found.select(
        "doc_id",
        "n_tokens",
        F.element_at(names, best).alias("domain"),
        "posterior",
        "rate",
        (F.floor(rate) + up).cast("int").alias("copies"),
        of_domain(fitted.targets, "domain_target"),
        of_domain(fitted.totals, "domain_reached"),
    )


def resampled(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "lang",
    label_id_col: str = "doc_id",
    max_labelled: int = MAX_LABELLED,
    seed: int = 7,
) -> DataFrame:
    """``docs`` with all its columns, each row as many times as ``mixed`` says; after the fit one scan, no join."""
    mix = learned_mix(docs, labels, weights, total, id_col, text_col, domain_col, label_id_col, max_labelled)
    if mix is None:
        return docs
    model, fitted, _ = mix

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _steps(batch, text_col):
                rate = fitted.rates(model.posteriors(word_shares(data, offsets)[0]))
                draw = part.columns[-1].to_numpy(zero_copy_only=False)
                times = np.floor(rate).astype(np.int64) + (draw < rate - np.floor(rate))
                rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), times)))
                yield pa.RecordBatch.from_arrays(rows.columns[:-1], names=rows.schema.names[:-1])

    tie = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.select("*", _draw(docs[id_col], tie, seed).alias("draw of the mix")).mapInArrow(repeat, docs.schema)


#: Target weights of the query: English, most of the corpus, is to be a small part of it, so many rates end at the bound 0.
OP1_WEIGHTS = {"de": 0.4, "en": 0.03, "es": 0.17, "fr": 0.4}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mixed`` over all documents, to OP1_WEIGHTS of as many tokens as there are; the domains are languages."""
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), OP1_WEIGHTS, total_share=1.0)
