"""Model-backed steps as batch functions with offline defaults: any function of the same shape can take their place."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: From texts to vectors, a batch at a time.
Embedder = Callable[[list[str]], list[list[float]]]


def hash_embedder(dim: int = 64) -> Embedder:
    """Feature hashing of words, of length one: the same text has the same vector everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return embed


def embedded(chunks: DataFrame, embed: Embedder | None = None, dim: int = 64, batch: int = 100, tries: int = 5, wait: float = 1.0) -> DataFrame:
    """(id, embedding) from (id, text): batches of texts, blanks as zero vectors, a failing batch tried again after a growing wait."""
    use = embed or hash_embedder(dim)

    def call(texts: list[str]) -> list[list[float]]:
        for k in range(tries):
            try:
                return use(texts)
            except (ConnectionError, TimeoutError):
                if k + 1 == tries:
                    raise
                time.sleep(wait * 2**k)
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].fillna("")
            vectors: list[list[float]] = [[0.0] * dim for _ in texts]
            filled = [i for i, t in enumerate(texts) if t.strip()]
            for low in range(0, len(filled), batch):
                part = filled[low : low + batch]
                for i, v in zip(part, call([texts.iloc[i] for i in part]), strict=True):
                    vectors[i] = v
            yield pd.DataFrame({"id": frame["id"], "embedding": vectors})

    kind = chunks.schema["id"].dataType.simpleString()
    return chunks.select("id", "text").mapInPandas(run, f"id {kind}, embedding array<float>")
