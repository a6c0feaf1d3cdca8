"""Sizes and chunks in subword tokens of a tokenizer file, cut out of the text itself by the tokens' places."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.pretokens import Encoder
from ..functions.scalars import sentence_trim
from ..functions.vocab import CHUNK_OVERLAP, CHUNK_SIZE

#: Characters that are encoded at a time: texts up to that are taken together, a longer one is cut where no token is.
PART = 1 << 18

_WORD = re.compile(r"(?<=\S) (?=\w)")
_LOADED: dict[str, tuple[Encoder, np.ndarray]] = {}


def _encoder(path: str) -> tuple[Encoder, np.ndarray]:
    """A worker's encoder and the bytes of each token, read once; strings of special tokens in a text are ordinary text."""
    if path not in _LOADED:
        encoder = Encoder(path)
        encoder.tokenizer.encode_special_tokens = True
        encoder.added = []
        size = np.zeros(encoder.tokenizer.get_vocab_size() + 1, np.int64)
        for token, i in encoder.tokenizer.get_vocab().items():
            size[i] = len(token)  # a token is written with one character for each byte
        _LOADED[path] = encoder, size
    return _LOADED[path]


def parts(text: str, size: int | None = None) -> Iterator[tuple[int, str]]:
    """(begin, part) of a text: parts of ``size`` characters or a little more, cut before a blank with a word after it, which no token spans."""
    begin, size = 0, size or PART
    while len(text) - begin > size:
        found = _WORD.search(text, begin + size)
        if not found:
            break
        yield begin, text[begin : found.start()]
        begin = found.start()
    yield begin, text[begin:]


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[str], list[tuple[int, int, bool]]]]:
    """Texts or parts of them of PART characters or a little more together, and of each its row, its begin and whether its text ends with it; null counts as empty."""
    block, about, size = [], [], 0
    for row, text in enumerate(texts):
        own = list(parts(text or ""))
        for begin, part in own:
            block.append(part)
            about.append((row, begin, begin == own[-1][0]))
            size += len(part)
            if size >= PART:
                yield block, about
                block, about, size = [], [], 0
    if block:
        yield block, about


def _encoded(block: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block; pieces that the worker has met before do not go through the library."""
    return _encoder(path)[0].encode(block)


def all_token_ends(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    """For each text where each of its tokens ends, in characters; a token within a character ends with it."""
    held: list[np.ndarray] = []
    for block, about in _blocks(texts):
        ids, bounds = _encoded(block, path)
        raw = np.frombuffer("".join(block).encode("utf-8", "surrogatepass"), np.uint8)
        # characters begun up to a token's last byte
        ends = np.cumsum((raw & 0xC0) != 0x80)[np.cumsum(_encoder(path)[1][ids]) - 1] if len(ids) else np.empty(0, np.int64)
        shift = 0
        for i, (_, begin, last) in enumerate(about):
            held.append(ends[bounds[i] : bounds[i + 1]] - shift + begin)
            shift += len(block[i])
            if last:
                yield np.concatenate(held)
                held = []


def token_ends(text: str, path: str) -> np.ndarray:
    """Where each token of a text ends, in characters; a token within a character ends with it."""
    return next(all_token_ends([text], path))


def token_counts(texts: list[str | None], path: str) -> list[int]:
    """The number of tokens of each text."""
    out = [0] * len(texts)
    for block, about in _blocks(texts):
        bounds = _encoded(block, path)[1]
        for (row, _, _), n in zip(about, np.diff(bounds).tolist(), strict=True):
            out[row] += n
    return out


def sized(rows: DataFrame, path: str, text_col: str = "text", name: str = "tokens") -> DataFrame:
    """``rows`` with the number of subword tokens of a text; null counts as empty."""
    at = rows.columns.index(text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = token_counts(batch.column(at).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, name])

    return rows.mapInArrow(count, StructType([*rows.schema.fields, StructField(name, LongType())]))


def chunked(docs: DataFrame, id_col: str, text_col: str, path: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, tail: bool = False, trim: bool = True) -> DataFrame:
    """(id, chunk_index, first_token, n_tokens, begin, end, chunk_text): windows of subword tokens, as pieces of the text.

    A text of at most ``size`` tokens is one chunk as it is. Others give windows of ``size`` tokens, each ``overlap`` into the
    one before; with ``tail``, one also starts inside the last full window as long as tokens are left. Windows are cut at
    characters: a token within a character takes all of it. ``begin`` and ``end`` bound a window in the text, and the
    windows cover all of it; ``chunk_text`` is what is left of it at a sentence end in its second half if ``trim``, without
    blanks around. Blank and null texts, and windows of blanks, give no chunk.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(r"\S"))
    kind = rows.schema["id"].dataType.simpleString()
    step = max(size - overlap, 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column(1).to_pylist()
            for row, (text, ends) in enumerate(zip(texts, all_token_ends(texts, path), strict=True)):
                n = len(ends)
                last = n - 1 if tail else max(n - overlap - 1, 0)
                for index, first in enumerate(range(0, last + 1, step) if n > size else [0]):
                    stop = min(first + size, n)
                    begin, end = int(ends[first - 1]) if first else 0, int(ends[stop - 1]) if stop < n else len(text)
                    out.append((row, index, first, stop - first, begin, end, stop < n, n <= size, text[begin:end]))
            row, *columns = zip(*out, strict=True) if out else [[] for _ in range(9)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            names = ["id", "chunk_index", "first_token", "n_tokens", "begin", "end", "more", "whole", "text"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    found = rows.mapInArrow(cut, f"id {kind}, chunk_index int, first_token long, n_tokens long, begin long, end long, more boolean, whole boolean, text string")
    part = F.when(F.col("more"), sentence_trim(F.col("text"))).otherwise(F.col("text")) if trim else F.col("text")
    text = F.when(F.col("whole"), F.col("text")).otherwise(F.regexp_replace(part, r"^\s+|\s+$", ""))
    return found.select("id", "chunk_index", "first_token", "n_tokens", "begin", "end", text.alias("chunk_text")).where("chunk_text != ''")
