"""Token ids in bit-plane or byte-plane files.

The file format is a Parquet table, so that Spark writes, commits and reads it in any store. A row is a
chunk of up to ``chunk_ids`` ids (fixed size; only the last of a part is shorter):

* ``part``, ``chunk``: its place; parts and chunks in order give all ids in ascending doc_id order
* ``n_ids``, ``planes``: the ids, transposed into 32 bit planes or 4 byte planes, each compressed with zstandard
* ``doc``, ``doc_order``, ``doc_ids``, ``opens``, ``closes``: for each document with ids in the chunk its doc_id,
  its number in the part, how many of its ids the chunk has, and whether its first and last ids are here

Parquet reads only the columns asked for, so all columns but ``planes`` are the chunk index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import blocks, documents, shared_dir, table
from .pretokens import encoder, vocabulary

CHUNK_IDS = 1 << 16
#: Bytes of text that the tokenizer takes at once, and characters of a part of a longer text.
TEXT_BYTES = 1 << 19


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """uint32 ids as 4 byte planes or 32 bit planes, lowest first, not compressed."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of ``to_planes``."""
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(x, np.uint8) for x in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little") for x in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def _zero_steps() -> list[list[int]]:
    """What 1, 2, 4, ... appended zero bytes do to a CRC-32, as linear maps over its bits."""
    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    steps = []
    for _ in range(3 + 48):
        steps.append(step)
        step = [_times(step, row) for row in step]
    return steps[3:]


_STEPS = _zero_steps()


def crc_joined(one: int, two: int, n: int) -> int:
    """The CRC-32 of two byte strings end to end from those of each; n is the second's length."""
    for k, step in enumerate(_STEPS):
        if n >> k & 1:
            one = _times(step, one)
    return one ^ two


CHUNK_SCHEMA = (
    "part int, chunk long, n_ids long, planes array<binary>, doc array<{id}>, doc_order array<long>, "
    "doc_ids array<long>, opens array<boolean>, closes array<boolean>"
)


class _Chunks:
    """Makes chunk rows of one part from documents in order."""

    def __init__(self, part: int, size: int, planes: str, level: int, schema: pa.Schema):
        self.part, self.size, self.planes, self.schema = part, size, planes, schema
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.chunk, self.order, self.ids, self.room = 0, 0, [], size
        self.docs: list[tuple] = []

    def add(self, doc, ids: np.ndarray, opens: bool = True, closes: bool = True) -> Iterator[pa.RecordBatch]:
        """Takes a document's ids, or some of them in order: its first if it opens, its last if it closes."""
        at = 0
        while at < len(ids):
            take = min(self.room, len(ids) - at)
            self.ids.append(ids[at : at + take])
            first, last, size = opens and at == 0, closes and at + take == len(ids), take
            if self.docs and self.docs[-1][1] == self.order:
                _, _, before, first, _ = self.docs.pop()
                size += before
            self.docs.append((doc, self.order, size, first, last))
            at, self.room = at + take, self.room - take
            if not self.room:
                yield self.close()
        self.order += closes

    def close(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        planes = [self.compress(x) for x in to_planes(ids, self.planes)]
        columns = [list(x) for x in zip(*self.docs, strict=True)]
        values = [[self.part], [self.chunk], [len(ids)], [planes], *([x] for x in columns)]
        self.chunk, self.ids, self.docs, self.room = self.chunk + 1, [], [], self.size
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, self.schema, strict=True)], schema=self.schema)


def write_token_files(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_path: str | None = None,
    end_id: int = 0,
    chunk_ids: int = CHUNK_IDS,
    planes: str = "byte",
    level: int = 3,
    parts: int | None = None,
) -> None:
    """Encodes all texts, appends ``end_id`` to each, and writes all ids in ascending doc_id order.

    Rows are dealt over parts by ranges of doc_id, ties by a hash of the text, so a part is a range of ids
    and rows that share one id can still spread over parts. A part is encoded as a stream: chunks are written as soon
    as they are full, and a long document is encoded part by part, cut before white space, and goes through many
    chunks. Beyond the row itself, memory is bounded but for a stretch without white space, which is taken whole.

    A null text is the empty text, which gives the end id alone. Null ids come first. Rows that repeat an id
    are documents of their own, in the order of their texts' hashes. Other columns are ignored, whatever
    their names. An empty table gives an empty file.
    """
    if planes not in ("bit", "byte"):
        raise ValueError("planes are 'bit' or 'byte'")
    spark = docs.sparkSession
    vocabulary_path = vocabulary_path or vocabulary()
    source = documents(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    schema_sql = CHUNK_SCHEMA.format(id=source.schema["doc_id"].dataType.simpleString())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Chunks(TaskContext.get().partitionId(), chunk_ids, planes, level, schema)
        use = encoder(vocabulary_path)
        for batch in batches:
            for rows, raw, _ in blocks(batch, limit=TEXT_BYTES):
                if len(raw) > TEXT_BYTES:  # one long text
                    doc, opens = rows.column(0)[0].as_py(), True
                    for part in use.parts(rows.column(1)[0].as_py(), TEXT_BYTES):
                        if part:
                            yield from out.add(doc, use.encode([part])[0], opens, False)
                            opens = False
                    yield from out.add(doc, np.array([end_id], np.uint32), opens)
                    continue
                texts = rows.column(1).to_pylist()
                ids, bounds = use.encode(texts)
                for i, doc in enumerate(rows.column(0).to_pylist()):
                    yield from out.add(doc, np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)))
        if out.ids:
            yield out.close()

    schema = to_arrow_schema(spark.createDataFrame([], schema_sql).schema)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(encode, schema_sql).write.parquet(path)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's documents with the CRC-32 of their ids there."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            planes = row.column("planes")[0].as_py()
            n = row.column("n_ids")[0].as_py()
            raw = from_planes([expand(x) for x in planes], n).tobytes()
            sizes = np.array(row.column("doc_ids")[0].as_py(), np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            k = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(k, row.column("part")[0].as_py()), pa.int32()),
                    pa.array(np.full(k, row.column("chunk")[0].as_py()), pa.int64()),
                    row.column("doc").flatten(),
                    row.column("doc_order").flatten(),
                    pa.array(sizes),
                    pa.array(at[:-1]),
                    pa.array(crcs, pa.int64()),
                    row.column("opens").flatten(),
                    row.column("closes").flatten(),
                ],
                names=["part", "chunk", "doc_id", "doc_order", "n_tokens", "at", "ids_crc32", "opens", "closes"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold of each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Chunks are decoded independently. Only documents that cross a chunk's end are brought together, and of
    those only sizes and checksums. Starts come from the chunk index: a running total over chunk rows within
    each part, and one over the parts, of which there are as many as files.
    """
    chunks = spark.read.parquet(path)
    kind = chunks.schema["doc"].dataType.elementType.simpleString()
    index = chunks.select("part", "chunk", "n_ids")
    size = index.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = size.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))
    earlier = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.select("part", "chunk", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("chunk_start"))
    starts = starts.join(parts, "part").select("part", "chunk", (F.col("part_start") + F.col("chunk_start")).alias("base"))
    pieces = chunks.mapInArrow(
        _fragments,
        f"part int, chunk long, doc_id {kind}, doc_order long, n_tokens long, at long, ids_crc32 long, opens boolean, closes boolean",
    )
    pieces = pieces.join(starts, ["part", "chunk"]).withColumn("start", F.col("base") + F.col("at"))
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = F.col("opens") & F.col("closes")
    order = ["part", "doc_order", "chunk"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = pieces.where(~whole).select(*columns, "part", "doc_order", "chunk", "opens").repartition(n, "part").sortWithinPartitions(*order)
    return pieces.where(whole).select(columns).unionByName(split.mapInArrow(_joined, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents from their pieces, which come in order: (doc_id, start, n_tokens, ids_crc32, ..., opens)."""
    open_: list | None = None
    for batch in batches:
        done = []
        rows = zip(*(batch.column(k).to_pylist() for k in ("doc_id", "start", "n_tokens", "ids_crc32", "opens")), strict=True)
        for doc, start, size, crc, opens in rows:
            if opens:
                if open_:
                    done.append(open_)
                open_ = [doc, start, size, crc]
            else:
                open_ = [*open_[:2], open_[2] + size, crc_joined(open_[3], crc, 4 * size)]
        yield _documents(done, batch.schema)
    if open_:
        yield _documents([open_], batch.schema)


def _documents(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(k).type) for k, c in enumerate(columns)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to byte-plane files and read back."""
    path = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), path, planes="byte")
    return read_token_files(spark, path)
