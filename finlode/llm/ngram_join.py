"""Documents linked by the Jaccard similarity of their n-grams: a blocked sparse matrix product of documents by n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrow import whole_runs
from . import words as W
from .common import blocks, documents, released, saved, table
from .components import components
from .near_dedup import _links, _own_text, _rest, _verified, named_sets, shingle_sets

#: Percent of a document's n-grams that must be shared among those looked at first, besides those that may all differ.
FIRST = 5
#: Rows left, at about 50 bytes each, that are sent to all tasks; more are joined by a shuffle.
FEW = 400_000
#: Documents in a slab of the product; cells of a dense slice of columns; pairs that a sparse slice adds at a time.
SLAB, DENSE, SPARSE = 512, 4 << 20, 2 << 20


def least(n: np.ndarray, percent: int) -> np.ndarray:
    """The n-grams that a set of n has in common with any similar one: ``percent`` of n, rounded up."""
    return -(-percent * n // 100)


def overlaps(sets: list[np.ndarray], ones: np.ndarray, others: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of ones, of others) of similar enough sets; ones and others are numbers of sets, a set is sorted hashes.

    The incidence matrix has a row for each set and a column for each n-gram of two sets or more. A row with fewer columns
    than its size asks for is left out. The rest go by size: a slab of ones is multiplied only with the others whose sizes
    are near enough. Columns that few rows have are added pair by pair, the others as slices of dense products; between
    slices a slab stops once no count can reach its bound any more.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # whole numbers up to there
    grams, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    kept = shared[inverse]
    held = np.bincount(owner[kept], minlength=len(sets))
    alive = (held >= least(sizes, percent)) & (sizes > 0)
    kept &= alive[owner]
    owner, column = owner[kept], (np.cumsum(shared) - 1)[inverse[kept]]
    del grams, inverse, counts
    by_row = np.argsort(owner, kind="stable")
    column, bounds = column[by_row], np.searchsorted(owner[by_row], np.arange(len(sets) + 1))
    ones, others = (side[alive[side]] for side in (ones, others))
    ones, others = ones[np.argsort(sizes[ones], kind="stable")], others[np.argsort(sizes[others], kind="stable")]

    def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in rows, column) of all entries, by column."""
        n = bounds[rows + 1] - bounds[rows]
        total = np.cumsum(n)
        at = np.repeat(bounds[rows] - total + n, n) + np.arange(total[-1] if len(total) else 0)
        place, own = np.repeat(np.arange(len(rows)), n), column[at]
        order = np.argsort(own, kind="stable")
        return place[order], own[order]

    for low in range(0, len(ones), SLAB):
        slab = ones[low : low + SLAB]
        first = np.searchsorted(sizes[others], least(sizes[slab[0]], percent))
        last = np.searchsorted(sizes[others], 100 * sizes[slab[-1]] // percent, "right")
        near = others[first:last]
        if not len(near):
            continue
        x, left = entries(slab)
        y, right = entries(near)
        both = np.zeros((len(slab), len(near)), kind)
        known, start, n = np.unique(left, return_index=True, return_counts=True)
        begin, end = np.searchsorted(right, known), np.searchsorted(right, known, "right")
        m = end - begin
        some = m > 0
        dense = n * m * 64 > both.size
        # few rows: one addition for each pair of rows
        few = np.flatnonzero(some & ~dense)
        work = np.cumsum(n[few] * m[few])
        for a, b in zip(*_slices(work, SPARSE), strict=True):
            at = few[a:b]
            pairs = n[at] * m[at]
            total = np.cumsum(pairs)
            own = np.repeat(np.arange(len(at)), pairs)
            step = np.arange(total[-1]) - np.repeat(total - pairs, pairs)
            i, j = x[start[at][own] + step // m[at][own]], y[begin[at][own] + step % m[at][own]]
            both += np.bincount(i * len(near) + j, minlength=both.size).reshape(both.shape)
        # many rows: a dense slice of columns at a time
        many = np.flatnonzero(some & dense)
        width = max(1, DENSE // (len(slab) + len(near)))
        bound = least(np.maximum(sizes[slab][:, None], sizes[near]), percent)
        for a in range(0, len(many), width):
            at = many[a : a + width]
            if (both + (len(many) - a) < bound).all():
                break
            one, other = np.zeros((len(slab), len(at)), kind), np.zeros((len(at), len(near)), kind)
            one[x[_within(start[at], n[at])], np.repeat(np.arange(len(at)), n[at])] = 1
            other[np.repeat(np.arange(len(at)), m[at]), y[_within(begin[at], m[at])]] = 1
            both += one @ other
        same = both.astype(np.int64)
        i, j = np.nonzero((same >= bound) & (100 * same >= percent * (sizes[slab][:, None] + sizes[near] - same)))
        yield slab[i], near[j]


def _within(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of ranges (start, length)."""
    total = np.cumsum(n)
    return np.repeat(start - total + n, n) + np.arange(total[-1] if len(total) else 0)


def _slices(work: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """Cuts running sums into slices of about ``limit``, or one entry."""
    cuts = [0]
    while cuts[-1] < len(work):
        done = work[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(work, done + limit, "right"))))
    return cuts[:-1], cuts[1:]


def _incidence(k: int, inside: np.ndarray, percent: int):
    """Each document's set: size, name, and the smallest of its hashes, of which any similar one has FIRST percent too."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch):
                sets, names = named_sets(data, offsets, k, inside)
                keys = [s[: len(s) - int(least(len(s), percent)) + int(least(len(s), FIRST))].view(np.int64) if len(s) else None for s in sets]
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "keys"])

    return scan


def _whole_sets(k: int, inside: np.ndarray):
    """All hashes of rows (id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch):
                keys = [s.view(np.int64) for s in shingle_sets(data, offsets, k, inside)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["id", "keys"])

    return scan


def _columns(rows: DataFrame) -> DataFrame:
    """(key, id, n) of rows (id, keys): the entries in columns of two rows or more, with the rows of their column."""
    hits = rows.select("id", F.explode("keys").alias("key"))
    return hits.join(hits.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def _bound(n, percent: int):
    return F.ceil(n * percent / 100)


def _compared(k: int, inside: np.ndarray, percent: int):
    """Links of blocks' nodes; rows (home, row, column, one, node, component, text) come sorted by block.

    Of a node's links into one component, one is enough.
    """

    def links(group: pa.Table) -> pa.RecordBatch:
        names, sets, number = group.column("node").combine_chunks(), [], {}
        for part, data, offsets in (x for b in group.combine_chunks().to_batches() for x in blocks(b)):
            for name, own in zip(part.column("node").to_pylist(), shingle_sets(data, offsets, k, inside), strict=True):
                if name not in number:
                    number[name] = len(sets)
                    sets.append(own)
        row = np.array([number[name] for name in names.to_pylist()])
        one = group.column("one").to_numpy()
        kind = np.empty(len(sets), np.int64)
        kind[row] = group.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        name = list(number)
        left, right = [], []
        if one.any() and not one.all():
            for x, y in overlaps(sets, np.unique(row[one]), np.unique(row[~one]), percent):
                apart = kind[x] != kind[y]
                x, y = x[apart], y[apart]
                _, at = np.unique(x * len(sets) + kind[y], return_index=True)
                left += [name[i] for i in y[at].tolist()]
                right += [name[i] for i in x[at].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["leader", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_runs(batches, "home", "row", "column"):
            for a, b in zip(starts, np.append(starts[1:], rows.num_rows), strict=True):
                yield links(rows.slice(int(a), int(b - a)))

    return compare


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, inside: np.ndarray = W.SOLID) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs of bytes of the class ``inside`` (by default all but ASCII white space) after lower-casing A-Z; a
    document's set is its distinct k-word shingles, or its whole sequence if it has fewer words. Documents are linked if
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable.

    The product of the incidence matrix, documents by n-grams, with its transpose has the overlap of any two documents.
    Equal sets are one row of the matrix. What a set's size asks of any similar one bounds what must be multiplied: first,
    of each row only its smallest hashes count, as many as must hold FIRST percent of it in common with any similar one,
    and rows with fewer than that in columns of two rows are left out. Of the rows left all columns are taken and rows
    left out again; then a row keeps its rarest columns, so many that any similar one has one of them. Rows that meet in
    a column are compared with one leader; those still apart are multiplied in blocks by ``overlaps``. No pair is a row,
    no column is cut short, and no bound is a guess: no link is lost.

    A null or empty text, or one of white space, has an empty set and is linked with nothing. Null ids count as larger
    than all others. Rows that repeat an id get a row each. Other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    source = documents(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = saved(source.mapInArrow(_incidence(k, inside, percent), f"doc_id {kind}, n_shingles bigint, node binary, keys array<bigint>"))
    members = saved(signed.select("doc_id", "n_shingles", "node"))
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("size"), F.first("keys").alias("keys"))
    nodes = saved(nodes.withColumn("id", F.monotonically_increasing_id()))
    released(signed)
    names = saved(nodes.select("id", "node", "first_id", "size"))
    counts = _columns(nodes.select("id", "keys")).groupBy("id").agg(F.count("*").alias("n")).join(names.select("id", "size"), "id")
    alive = saved(counts.where(F.col("n") >= _bound(_bound(F.col("size"), percent), FIRST)).select("id"))
    released(nodes)
    # the text of each row left, by the first document of the set; one of a repeated id may be another text. Few enough
    # rows are sent to all tasks, so that the other texts are not shuffled
    wanted = alive.join(names, "id").select("id", "node", "first_id")
    wanted = F.broadcast(wanted) if alive.count() <= FEW else wanted
    texts = saved(
        source.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")))
        .select("node", "text", "id")
        .mapInArrow(_own_text(k, inside), "node binary, text string, id bigint")
        .dropDuplicates(["node"])
    )
    released(alive)
    left = names.select("id", "node", "size")
    entries = _columns(texts.select("id", "text").mapInArrow(_whole_sets(k, inside), "id bigint, keys array<bigint>"))
    texts = texts.select("node", "text")
    need = _bound(F.col("size"), percent)
    row = Window.partitionBy("id")
    ordered = entries.join(left.select("id", "size"), "id").select("id", "size", "key", F.row_number().over(row.orderBy("n", "key")).alias("place"), F.count("*").over(row).alias("own"))
    rare = ordered.where(F.col("place") <= F.col("own") - need + 1)
    hits = saved(rare.select("id", "key").join(left, "id").select("node", "size", "key"))
    met = hits.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = hits.join(met, "key")
    # a column's leader is the row that meets most others in all its columns: of edited copies, that nearest to their source
    weight = buckets.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = buckets.join(weight, "node").groupBy("key").agg(F.max_by(F.struct("node", "size"), F.struct("met", "node")).alias("leader"))
    columns = saved(hits.join(leaders, "key").select("key", "node", "size", F.col("leader.node").alias("leader"), F.col("leader.size").alias("leader_size")))
    released(hits)
    fits = F.greatest("size", "leader_size") * percent <= F.least("size", "leader_size") * 100
    stars = columns.where(F.col("leader") != F.col("node")).where(fits).groupBy("leader", "node").agg(F.count("*").alias("n"))
    best = stars.groupBy("node").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader")).select("leader", "node")
    links = saved(_links(best, texts, _verified(k, inside, percent)))
    member, more = _rest(columns.select("key", "node", "leader"), components(links), texts, _compared(k, inside, percent))
    done = components(links.unionByName(more))
    released(columns, texts, member, links)
    placed = names.join(done, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = placed.join(ids, "component").select("node", "component_id")
    found = members.join(named, "node", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ngram_links`` of all documents on 5-word shingles."""
    return ngram_links(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), u AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS grams FROM t
), g AS (
    SELECT md5(array_to_string(list_sort(grams), chr(10))) AS node, min(doc_id) AS first_id, any_value(grams) AS grams FROM u WHERE len(grams) > 0 GROUP BY ALL
), n AS (
    SELECT node, min(first_id) AS first_id, any_value(grams) AS grams, any_value(len(grams)) AS size FROM g GROUP BY node
), f AS (
    SELECT first_id, size, unnest(grams) AS gram FROM n
), c AS (
    SELECT gram, count(*) AS many FROM f GROUP BY gram
), o AS (
    SELECT f.*, many, row_number() OVER (PARTITION BY first_id ORDER BY many, gram) AS place FROM f JOIN c USING (gram)
), h AS (
    SELECT * FROM o WHERE many > 1 AND place <= size - ceil(0.8 * size) + 1
), p AS (
    SELECT DISTINCT a.first_id AS one, b.first_id AS two FROM h a JOIN h b USING (gram)
    WHERE a.first_id < b.first_id AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size)
), l AS (
    SELECT one, two FROM p JOIN n a ON a.first_id = one JOIN n b ON b.first_id = two
    WHERE 180 * len(list_intersect(a.grams, b.grams)) >= 80 * (a.size + b.size)
), e AS (
    SELECT one, two FROM l UNION ALL SELECT two, one FROM l
), r AS (
    SELECT first_id AS one, first_id AS two FROM n
    UNION
    SELECT r.one, e.two FROM r JOIN e ON r.two = e.one
), m AS (
    SELECT one, min(two) AS component_id FROM r GROUP BY one
)
SELECT u.doc_id, len(u.grams)::BIGINT AS n_shingles, coalesce(m.component_id, u.doc_id) AS component_id
FROM u LEFT JOIN n ON len(u.grams) > 0 AND n.node = md5(array_to_string(list_sort(u.grams), chr(10))) LEFT JOIN m ON m.one = n.first_id
"""
