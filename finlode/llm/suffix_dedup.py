"""Removal of byte strings that occur again, by suffix arrays of the places where that is open."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, merged, released, saved, table
from .suffix_order import suffix_array
from .words import mix

#: Length of a repeated string, of an anchor's k-gram, and of a symbol of the suffix arrays, in bytes.
LENGTH, GRAM, SYMBOL = 200, 48, 16
#: Distinct segments that one task compares; a larger group is split by the bytes around its anchor first.
MAX_GROUP = 1000
#: Starts that share a part of a split group, split by split; at 1 all strings of a part are equal.
BANDS = (32, 8, 1)
#: Symbols of one suffix array; whole groups are put together up to that.
BATCH_SYMBOLS = 200_000
#: Bytes of a text that one pass of the anchor scan takes.
PIECE = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) < n:
        _tables[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, PIECE), base, np.uint64)]))
    return _tables[base][:n]


class RollingHash:
    """64-bit hashes of any substring of a byte array, in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * _powers(_BASE, n))])
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys."""
    n = len(keys)
    table_ = np.concatenate([keys, np.full(-n % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    before = np.minimum.accumulate(table_, axis=1).ravel()
    after = np.minimum.accumulate(table_[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.arange(n - width + 1)
    return np.minimum(after[first], before[first + width - 1])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Every string of ``length`` bytes within a text, by anchor: (row, first start, last start, anchor place, anchor, segment).

    A string's anchor is its k-gram with the least hash, the last of equal ones. Strings with one anchor place start
    side by side, and together make a segment. Equal strings, wherever they are, have equal anchors at equal distances.
    ``anchor`` hashes the k-gram; ``segment`` the whole segment with the anchor's place in it.
    """
    n = len(data)
    empty = tuple(np.empty(0, np.int64) for _ in range(4)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    if n < length:
        return empty
    hashes = RollingHash(data)
    at = np.arange(n - gram + 1)
    grams = hashes.of(at, at + gram)
    least = _least((grams & ~_LOW) | (_LOW - at.astype(np.uint64)), length - gram + 1)
    start = np.arange(n - length + 1)
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[row + 1]
    start, row, place = start[inside], row[inside], (_LOW - (least[inside] & _LOW)).astype(np.int64)
    if not len(start):
        return empty
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    first, last = start[cut], start[np.append(cut[1:], len(start)) - 1]
    place, row = place[cut], row[cut]
    raw = memoryview(np.ascontiguousarray(data))
    named = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
    segment = mix(named + (place - first).astype(np.uint64) * np.uint64(_BASE) + mix((last - first).astype(np.uint64)))
    return row, first, last, place, grams[place], segment


KEY = ("k1", "k2")
ROW = "k1 long, k2 long, start long, lead int, span int, anchor long, segment long"


def _anchored(length: int, gram: int):
    """Rows of ROW: where a segment starts, how far in its anchor is, and how many starts it has beyond the first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch):
                if part.num_rows == 1 and len(data) > PIECE:  # a long text in pieces that overlap by one string
                    pieces = [(b, data[b : b + PIECE + length - 1]) for b in range(0, len(data), PIECE)]
                    pieces = [(b, d, np.array([0, len(d)])) for b, d in pieces]
                else:
                    pieces = [(0, data, offsets)]
                for base, bytes_, bounds in pieces:
                    row, first, last, place, anchor, segment = segments(bytes_, bounds, length, gram)
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("k1").take(rows),
                            part.column("k2").take(rows),
                            pa.array(first - bounds[row] + base),
                            pa.array((place - first).astype(np.int32)),
                            pa.array((last - first).astype(np.int32)),
                            pa.array(anchor.view(np.int64)),
                            pa.array(segment.view(np.int64)),
                        ],
                        names=["k1", "k2", "start", "lead", "span", "anchor", "segment"],
                    )

    return scan


def _cut_out(length: int):
    """Segments' bytes from rows (text, places) of their documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py().encode()
                places = batch.column("places").slice(i, 1).flatten()
                start, lead, span = (places.field(k) for k in range(1, 4))
                pieces = [raw[s : s + n + length] for s, n in zip(start.to_pylist(), span.to_pylist(), strict=True)]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [places.field(0), *(pa.array([batch.column(k)[i].as_py()] * n, pa.int64()) for k in KEY), start, lead, span, pa.array(pieces, pa.binary())],
                    names=["anchor", *KEY, "start", "lead", "span", "bytes"],
                )

    return cut


def repeated_starts(pieces: list[bytes], leads: list[int], spans: list[int], length: int) -> list[np.ndarray]:
    """Of each segment, the starts (from its own) of strings that some other place in these segments has too.

    Segments are cut into symbols of SYMBOL bytes, counted from their anchors; distinct symbols are numbered in the
    order of their bytes. Suffixes that begin at symbols are ordered by ``suffix_array``. Neighbours with a long enough
    common prefix form runs; a string that starts up to SYMBOL - 1 bytes before a symbol repeats if within its run the
    same bytes come before.
    """
    bodies, heads = [], []
    for raw, lead in zip(pieces, leads, strict=True):
        head = lead % SYMBOL
        heads.append(head)
        bodies.append([raw[i : i + SYMBOL] for i in range(head, len(raw), SYMBOL)])
    symbols = sorted({x for body in bodies for x in body})
    number = {x: i + 2 for i, x in enumerate(symbols)}
    text: list[int] = []
    for body in bodies:
        text += [number[x] for x in body]
        text.append(1)  # the end of a segment is smaller than any symbol
    order = np.array(suffix_array(text))
    tokens = np.array([*text, *[0] * (length // SYMBOL + 2)])
    sizes = np.array([len(b) + 1 for b in bodies])
    owner = np.repeat(np.arange(len(bodies)), sizes)
    index = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.array([len(p) for p in pieces])
    place = np.array(heads)[owner] + SYMBOL * index  # of each suffix in its segment
    real = np.array(text) > 1
    order = order[real[order]]
    left = ends[owner] - place
    # common prefixes of neighbours, in bytes, as far as matters
    one, two = order[:-1], order[1:]
    same, equal = np.zeros(len(one), np.int64), np.ones(len(one), bool)
    for t in range(length // SYMBOL + 1):
        a, b = tokens[one + t], tokens[two + t]
        equal &= (a == b) & (a > 1)
        same += SYMBOL * equal
    table_ = np.zeros((len(symbols) + 2, SYMBOL), np.uint8)
    for i, x in enumerate(symbols):
        table_[i + 2, : len(x)] = np.frombuffer(x, np.uint8)
    step = same // SYMBOL
    a, b = table_[tokens[np.minimum(one + step, len(tokens) - 1)]], table_[tokens[np.minimum(two + step, len(tokens) - 1)]]
    same = np.minimum(same + np.cumprod(a == b, axis=1).sum(1), np.minimum(left[one], left[two]))
    # the SYMBOL bytes before each suffix, nearest first
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    origin = (np.cumsum(ends) - ends)[owner[order]] + place[order]
    acc = np.zeros(len(order), np.uint64)
    rank = owner[order]
    leads_, spans_ = np.array(leads), np.array(spans)
    found_row, found_start = [], []
    for back in range(SYMBOL):
        if back:
            ok = place[order] >= back
            acc = np.where(ok, mix(acc * np.uint64(_BASE) + flat[np.maximum(origin - back, 0)] + np.uint64(1)), acc)
        start = place[order] - back
        valid = (start >= 0) & (start <= spans_[rank]) & (place[order] <= leads_[rank]) & (left[order] >= length - back)
        run = np.concatenate([[0], np.cumsum(same < length - back)]) if len(order) else np.empty(0, np.int64)
        key = mix(acc + run.astype(np.uint64) * np.uint64(_BASE))[valid]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        many = counts[inverse] > 1
        found_row.append(rank[valid][many])
        found_start.append(start[valid][many])
    rows, starts = np.concatenate(found_row), np.concatenate(found_start)
    by_row = np.argsort(rows, kind="stable")
    cut = np.searchsorted(rows[by_row], np.arange(len(pieces) + 1))
    return [np.sort(starts[by_row[cut[i] : cut[i + 1]]]) for i in range(len(pieces))]


def _compared(length: int):
    """Spans (k1, k2, start, end) of repeated strings from rows sorted by anchor; whole groups share a suffix array."""

    def flush(group: list[tuple]) -> list[tuple]:
        out = []
        for (_, k1, k2, start, _, _, _), hits in zip(group, repeated_starts([g[6] for g in group], [g[4] for g in group], [g[5] for g in group], length), strict=True):
            a, b = merged(hits, hits + length)
            out += [(k1, k2, start + int(x), start + int(y)) for x, y in zip(a, b, strict=True)]
        return out

    def emit(spans: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*spans, strict=True)) if spans else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "start", "end"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BATCH_SYMBOLS and row[0] != waiting[-1][0]:
                    yield emit(flush(waiting))
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[6]) // SYMBOL + 2
        if waiting:
            yield emit(flush(waiting))

    return compare


SEGMENT = "anchor long, k1 long, k2 long, start long, lead int, span int, bytes binary"


def _split(length: int, width: int):
    """Segments cut into parts of at most ``width`` starts, whose new anchors are the bytes that all strings of a part hold.

    Strings whose anchor is d bytes in are put together by d // width. All of them hold the same bytes around the
    anchor, so equal strings still have equal anchors, and strings that differ there no longer meet.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, k1, k2, start, lead, span, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for band in range((lead - span) // width, lead // width + 1):
                    low, high = max(band * width, lead - span), min(band * width + width - 1, lead)
                    core = raw[lead - band * width : lead + length - (band * width + width - 1)]
                    key = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=anchor.to_bytes(8, "little", signed=True), salt=bytes([band])).digest(), "little", signed=True)
                    out.append((key, k1, k2, start + lead - high, high, high - low, raw[lead - high : lead - low + length]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), batch.schema, strict=True)] if out else [c.slice(0, 0) for c in batch.columns], names=batch.schema.names)

    return split


def _removed(with_bytes: bool):
    """Documents' figures, and their remaining bytes if asked for, from rows (doc_id, text, spans)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in blocks(batch):
                out = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans"), strict=True):
                    raw = text.encode()
                    a = b = np.empty(0, np.int64)
                    if spans.is_valid and len(spans.values):
                        a, b = merged(*(spans.values.field(i).to_numpy() for i in range(2)))
                    kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                    out.append((len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept)[: 4 + with_bytes])
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + with_bytes]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in zip(*out, strict=True))], names=["doc_id", *names])

    return apply


def repeated_spans(source: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """(k1, k2, start, end): bytes of documents (k1, k2, text) in strings that start anywhere else, not yet merged."""
    rows = saved(source.select(*KEY, "text").mapInArrow(_anchored(length, gram), ROW))
    where = F.struct(*KEY, "start", "lead", "span").alias("place")
    kinds = saved(rows.select("anchor", "segment", where).groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.max("place").alias("place")))
    # segments that occur again as they are
    whole = rows.join(kinds.where("n > 1").select("anchor", "segment"), ["anchor", "segment"])
    spans = saved(whole.select(*KEY, "start", (F.col("start") + F.col("span") + length).alias("end")))
    # a segment that occurs once may share strings with the others of its anchor
    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("size > 1 AND least = 1").select("anchor")
    needed = kinds.join(open_, "anchor").select("anchor", "place.*")
    places = saved(needed.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "start", "lead", "span")).alias("places")))
    released(rows)
    now = saved(source.select(*KEY, "text").join(places, list(KEY)).mapInArrow(_cut_out(length), SEGMENT).dropDuplicates([*KEY, "start"]))
    released(kinds, places)
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for width in BANDS:
        sizes = saved(now.groupBy("anchor").agg(F.count("*").alias("size")).where(F.col("size") > max_group).select("anchor"))
        small = now.join(sizes, "anchor", "left_anti").repartition(n, "anchor").sortWithinPartitions("anchor")
        found = saved(small.mapInArrow(_compared(length), "k1 long, k2 long, start long, end long"))
        spans = spans.unionByName(found)
        if sizes.isEmpty():
            released(now, sizes)
            return spans
        # groups that no one task should hold
        parts = saved(now.join(sizes, "anchor").select(now.columns).mapInArrow(_split(length, width), SEGMENT))
        released(now, sizes)
        alone = parts.groupBy("anchor").agg(F.count("*").alias("size")).where("size > 1").select("anchor")
        now = saved(parts.join(alone, "anchor").select(parts.columns))
        released(parts)
    # what is left are groups of equal strings, two at least in each
    return spans.unionByName(now.select(*KEY, "start", (F.col("start") + length).alias("end")))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP, with_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, if asked for).

    A byte of a text's UTF-8 goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
    document or another. Strings never cross documents and are judged on the input.

    A scan gives every such string an anchor, the k-gram of ``gram`` bytes with the least hash in it, and cuts texts
    into segments of the strings that share an anchor. Equal strings have equal anchors, so it is enough to compare
    segments of equal anchors. Equal segments are counted. Only where an anchor's segments differ and one of them
    occurs once are bytes fetched, one copy of each distinct segment, and compared by a suffix array. A group of more than
    ``max_group`` is split by the bytes that its strings have around the anchor, more of them at each split; the last
    split leaves groups of equal strings only.

    A null or empty text, or one shorter than ``length``, keeps all its bytes. Rows with null ids and rows that repeat
    an id are documents of their own; of rows that repeat id and text each is the other's copy. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    source = documents(docs, id_col, text_col)
    source = source.select("doc_id", F.xxhash64("doc_id").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"), "text")
    spans = repeated_spans(source, length, gram, max_group)
    lists = saved(spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    released(spans)
    kind = source.schema["doc_id"].dataType.simpleString()
    joined = source.join(lists, list(KEY), "left").select("doc_id", "text", "spans")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return joined.mapInArrow(_removed(with_bytes), schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``suffix_dedup`` of all documents, strings of 200 bytes; the remaining bytes as their digest."""
    return suffix_dedup(table(spark, sf_dir, "documents"), with_bytes=False)


OP7_SQL = """
WITH t AS (
    SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), w AS (
    SELECT doc_id, i, md5(h[i + 1:i + 200]) AS k FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM t WHERE n >= 200)
), m AS (
    SELECT doc_id, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) d ON w.k = d.k
), g AS (
    SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM m
), r AS (
    SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run
), p AS (
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y, b - a AS gone FROM r
    UNION ALL SELECT t.doc_id, coalesce(max(r.b), 0), any_value(t.n), 0 FROM t LEFT JOIN r ON r.doc_id = t.doc_id GROUP BY t.doc_id
)
SELECT p.doc_id, any_value(t.n) AS n_bytes, sum(gone)::BIGINT AS n_removed, count_if(gone > 0)::BIGINT AS n_spans,
       sha256(unhex(string_agg(hex(h[x + 1:y]), '' ORDER BY x, y))) AS kept_sha256
FROM p JOIN t ON t.doc_id = p.doc_id GROUP BY p.doc_id
"""
