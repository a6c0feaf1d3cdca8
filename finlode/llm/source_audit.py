"""How far sources of one language differ in their words: sorted run-length scans with exact whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrow import new_runs, whole_runs
from . import words as W
from .common import blocks, saved, table

#: Letters A-Z in either case and every character that is not ASCII.
LETTERS = W.byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Bytes of text in a block whose words are sorted together; a longer text is a block of its own.
RUN_BYTES = 8 << 20
#: Cells of a table of counts, terms by sources, that is worked on at a time; and of sums that a task holds back.
CELLS, HELD = 1 << 20, 1 << 22

_RUNS = "lang string, term string, source string, docs bigint, n bigint"


def _words(data: np.ndarray, found: W.Words) -> pa.DictionaryArray:
    """The words of a block after lower-casing A-Z, as codes and a list of the distinct ones."""
    offsets = np.concatenate([[0], np.cumsum(found.end - found.start)]).astype(np.int64)
    text = W.LOWER[data[LETTERS[data]]]
    column = pa.LargeStringArray.from_buffers(len(found.start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text)))
    return column.dictionary_encode()


def _block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (lang, term, source) of each block's words, sorted by (term, lang, source, document)."""
    for batch in batches:
        for part, data, offsets in blocks(batch, limit=RUN_BYTES):
            found = W.find(data, offsets, LETTERS, lower=False)
            if not len(found.start):
                continue
            lang, source = (part.column(i).dictionary_encode() for i in (0, 1))
            n_docs, n_sources = part.num_rows, len(source.dictionary)
            group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
            order = np.argsort(group, kind="stable")
            place = np.empty(n_docs, np.int64)
            place[order] = np.arange(n_docs)
            word = _words(data, found)
            # one number for (term, group, document), so that a plain sort is the secondary sort
            keys = np.sort(word.indices.to_numpy().astype(np.int64) * n_docs + place[found.row])
            term, own = keys // n_docs, group[order][keys % n_docs]
            new_doc = np.concatenate([[True], keys[1:] != keys[:-1]])
            starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (own[1:] != own[:-1])]))
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(own[starts] // n_sources)),
                    word.dictionary.take(pa.array(term[starts])).cast(pa.string()),
                    source.dictionary.take(pa.array(own[starts] % n_sources)),
                    pa.array(np.add.reduceat(new_doc.astype(np.int64), starts)),
                    pa.array(np.diff(np.append(starts, len(keys)))),
                ],
                names=["lang", "term", "source", "docs", "n"],
            )


def _common_terms(least: int):
    """Keeps the runs of terms that occur in ``least`` documents of their language; one row a term has ``new`` 1."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_runs(batches, "lang", "term"):
            docs = np.add.reduceat(rows.column("docs").to_numpy(), starts)
            size = np.diff(np.append(starts, rows.num_rows))
            new = np.zeros(rows.num_rows, np.int64)
            new[starts] = 1
            out = rows.select(["lang", "term", "source", "n"]).append_column("new", pa.array(new)).filter(pa.array(np.repeat(docs >= least, size)))
            yield from out.combine_chunks().to_batches()

    return scan


def share(count: np.ndarray, total: np.ndarray, smooth: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + smooth) / total) in whole numbers; long division in two steps where 64 bits suffice."""
    up = np.asarray(count, np.int64) + smooth
    low = 32000
    if scale % low or int(np.max(total, initial=0)) >= 2**63 // max(low, scale // low):
        return (1 + up.astype(object) * scale // np.asarray(total).astype(object)).astype(np.int64)
    quotient, rest = np.divmod(up * (scale // low), total)
    return 1 + quotient * low + rest * low // total


class _Language:
    """What a task sums of one language's terms: its sources with their totals, and the distances of pairs of sources."""

    def __init__(self, lang: str, groups: pa.Table, smooth: int, scale: int):
        self.lang, self.smooth, self.scale = lang, smooth, scale
        self.sources = groups.column("source").combine_chunks()
        totals = groups.column("n").to_numpy()
        add = smooth * int(groups.column("new")[0].as_py())
        self.totals, self.total = totals + add, int(totals.sum()) + add
        self.sums: np.ndarray | None = None

    def terms(self, rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Adds runs of terms; yields the terms that a source has more often than its language."""
        width = len(self.sources)
        step = max(1, CELLS // width)
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        source = pc.index_in(rows.column("source").combine_chunks(), value_set=self.sources).to_numpy()
        n = rows.column("n").to_numpy()
        for low in range(0, len(starts), step):
            a, b = np.searchsorted(run, [low, low + step])
            counts = np.zeros((min(step, len(starts) - low), width), np.int64)
            counts[run[a:b] - low, source[a:b]] = n[a:b]
            p = share(counts, self.totals, self.smooth, self.scale)
            q = share(counts.sum(1), np.array([self.total]), self.smooth, self.scale)
            more = p[run[a:b] - low, source[a:b]] - q[run[a:b] - low]
            at = np.flatnonzero(more > 0)
            own = rows.slice(int(a), int(b - a)).take(pa.array(at))
            yield from self._rows("term", own.column("source").combine_chunks(), own.column("term").combine_chunks(), more[at])
            if width * width <= HELD:
                self.sums = np.zeros((width, width), np.int64) if self.sums is None else self.sums
                for i in range(width):
                    self.sums[i, i + 1 :] += np.abs(p[:, i + 1 :] - p[:, i : i + 1]).sum(0)
            else:
                for i in range(width - 1):
                    yield from self._pairs(i, np.abs(p[:, i + 1 :] - p[:, i : i + 1]).sum(0))

    def rest(self) -> Iterator[pa.RecordBatch]:
        """The sums that were held back."""
        for i in range(0 if self.sums is None else len(self.sources) - 1):
            yield from self._pairs(i, self.sums[i, i + 1 :])

    def _pairs(self, i: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        return self._rows("pair", self.sources.take(pa.array(np.full(len(values), i))), self.sources.slice(i + 1), values)

    def _rows(self, part: str, source: pa.Array, item: pa.Array, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(value):
            fixed = (pa.array([x], pa.string()).take(pa.array(np.zeros(len(value), np.int64))) for x in (self.lang, part))
            yield pa.RecordBatch.from_arrays([*fixed, source, item, pa.array(value)], names=["lang", "part", "source", "item", "value"])


def _partials(smooth: int, scale: int):
    """Partial distances and terms of rows (slot, lang, mark, term, source, n, new), in that order.

    In each slot a language's rows begin with those of mark 0: all its sources with their totals and its number of terms.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads, language = None, [], None
        for rows, starts in whole_runs(batches, "slot", "lang", "mark", "term"):
            change = new_runs(rows, "slot", "lang", "mark")[starts]
            cuts = np.flatnonzero(change | (np.arange(len(starts)) == 0))
            for one, end in zip(cuts, np.append(cuts[1:], len(starts)), strict=True):
                first, last = int(starts[one]), int(starts[end]) if end < len(starts) else rows.num_rows
                piece = rows.slice(first, last - first)
                key = tuple(piece.column(name)[0].as_py() for name in ("slot", "lang"))
                if key != at:
                    if language:
                        yield from language.rest()
                    at, heads, language = key, [], None
                if piece.column("mark")[0].as_py() == 0:
                    heads.append(piece)
                    continue
                language = language or _Language(key[1], pa.concat_tables(heads), smooth, scale)
                yield from language.terms(piece.combine_chunks(), starts[one:end] - first)
        if language:
            yield from language.rest()

    return scan


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def source_audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least: int = 30,
    smooth: int = 5,
    scale: int = 1_000_000_000,
    top: int = 50,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language differ, and by which terms.

    Terms are runs of letters A-Z and of characters that are not ASCII, A-Z lower-cased; a language keeps those that at
    least ``least`` of its documents have. A source gives each kept term the share p = 1 + floor(scale * (count + smooth)
    / (N + smooth * V)), with N its count of all kept terms and V their number; the language's own share q is over all
    its sources. Part ``pair`` has every other source of the language with the sum of |p - q| over all kept terms, part
    ``term`` the ``top`` kept terms of the source with the largest p - q above 0. Ranks go by value, ties by the item's
    bytes. All arithmetic is in whole numbers and exact.

    Words are sorted by (term, language, source, document) in blocks of text, so a document never leaves its block and
    what is shuffled are runs with document and word counts, summed before the shuffle; a term that every document has is
    one row for each source and task. A second scan, sorted by (lang, term, source), drops rare terms. The last one
    reads, in each of its slots, first a language's sources with their totals and then its terms, and gives partial
    distances and terms: nothing is collected or broadcast.

    A null text, language or source is the empty one. Each row is a document, rows that repeat an id too. A source
    without kept terms has rows of part ``pair`` all the same; where a language keeps no term, their value is 0. A
    language's only source has no ``pair`` rows. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession

    def plain(name: str) -> Column:
        return F.coalesce(docs[name].cast("string"), F.lit(""))

    source = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    runs = source.mapInArrow(_block_runs, _RUNS).groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = ["lang", "term", "source"]
    kept = saved(runs.repartition(n_parts, "lang", "term").sortWithinPartitions(*sort).mapInArrow(_common_terms(least), "lang string, term string, source string, n bigint, new bigint"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("new").alias("new"))
    groups = source.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    in_lang = Window.partitionBy("lang")
    groups = saved(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.sum("new").over(in_lang), F.lit(0)).alias("new")))
    slots = 2 * n_parts
    heads = groups.where("new > 0").select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "lang", F.lit(0).alias("mark"), F.lit("").alias("term"), "source", "n", "new")
    body = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(slots)).cast("int").alias("slot"), "lang", F.lit(1).alias("mark"), "term", "source", "n", "new")
    order = ["slot", "lang", "mark", "term", "source"]
    both = heads.unionByName(body).repartition(n_parts, "slot").sortWithinPartitions(*order)
    found = saved(both.mapInArrow(_partials(smooth, scale), "lang string, part string, source string, item string, value bigint"))
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", "value", turned).select("lang", "source", "item", "value")
    bare = groups.where("new = 0").select("lang", "source")
    zero = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
    terms = _ranked(found.where("part = 'term'").select("lang", "source", "item", "value"), "term").where(F.col("rank") <= top)
    return _ranked(pairs.unionByName(zero), "pair").unionByName(terms)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_audit`` of all documents."""
    return source_audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
    SELECT DISTINCT lang, source FROM d
), w AS (
    SELECT id, lang, source, unnest(w) AS term FROM d
), k AS (
    SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30
), c AS (
    SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL
), v AS (
    SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang
), a AS (
    SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), s AS (
    SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (total + 5 * v) AS p,
           1 + 1000000000 * (sum(n) OVER (PARTITION BY lang, term) + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM a
), f AS (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), r AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value
    FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM s WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR rank <= 50
"""
