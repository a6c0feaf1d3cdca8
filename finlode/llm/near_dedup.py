"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import blocks, documents, released, saved, table
from .components import components

#: Bands and rows of a signature. At a similarity of 0.8 a link is missed with a chance of (1 - 0.8**5)**40 = 1e-7.
BANDS, ROWS = 40, 5
#: Members that meet one copy of their leader's text in the verifying join.
MEMBERS = 256
#: Bytes of text, and nodes, in a block that is compared with another block.
BLOCK_TEXT, BLOCK_NODES = 4 << 20, 4096
#: Sets of up to so many shingles are named by their words themselves, larger ones by their shingles' hashes.
SMALL = 16

_ONE, _TWO = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)


def named_sets(data: np.ndarray, offsets: np.ndarray, k: int, inside: np.ndarray) -> tuple[list[np.ndarray], list[bytes | None]]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes, and the set's name of 128 bits; None for an empty set.

    Equal sets have equal names. The name of a small set is a digest of its words, so that no two hashes that happen to
    be equal make one of two different texts; larger sets with but one such pair would be near duplicates all the same.
    """
    found = W.find(data, offsets, inside)
    hashes, heads = W.shingles(found, k)
    at = np.searchsorted(heads, found.first)
    sets = [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    names: list[bytes | None] = []
    for row, own in enumerate(sets):
        if len(own) > SMALL:
            names.append(set_name(own))
        elif len(own):
            a, b = found.first[row], found.first[row + 1]
            words = [W.LOWER[data[x:y]].tobytes() for x, y in zip(found.start[a:b].tolist(), found.end[a:b].tolist(), strict=True)]
            runs = {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
            names.append(hashlib.blake2b(b"\n".join(sorted(runs)), digest_size=16).digest())
        else:
            names.append(None)
    return sets, names


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, inside: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes."""
    found = W.find(data, offsets, inside)
    hashes, heads = W.shingles(found, k)
    at = np.searchsorted(heads, found.first)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def set_name(shingles: np.ndarray) -> bytes:
    """A large set's name of 128 bits."""
    one = int(np.add.reduce(W.mix(shingles ^ _ONE), dtype=np.uint64))
    two = int(np.add.reduce(W.mix(shingles ^ _TWO), dtype=np.uint64))
    return one.to_bytes(8, "big") + two.to_bytes(8, "big")


def super_minhash(shingles: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signature of a set: m values.

    Each element shuffles the m places by its own random numbers and offers to its j-th place j plus a random
    fraction; a place keeps its smallest offer. Elements are taken together level by level in j, and once every
    place has an offer below j + 1 the later levels cannot change anything.
    """
    best = np.full(m, np.inf)
    n = len(shingles)
    dense = n <= 256
    order = np.tile(np.arange(m), (n, 1)) if dense else None
    rows = np.arange(n)
    swaps: list[tuple[np.ndarray, np.ndarray]] = []
    state = shingles
    for j in range(m):
        state = W.mix(state + _ONE)
        fraction = (state >> np.uint64(11)) * 2.0**-53
        draw = W.mix(state ^ _TWO)
        k = j + ((draw >> np.uint64(11)) * 2.0**-53 * (m - j)).astype(np.int64)
        if dense:
            place = order[rows, k]
            order[rows, k] = order[:, j]
        else:
            moved, place = np.full(n, j), k.copy()
            for other, value in swaps:
                moved = np.where(other == j, value, moved)
                place = np.where(other == k, value, place)
            swaps.append((k, moved))
        np.minimum.at(best, place, fraction + j)
        if best.max() < j + 1:
            break
    return best


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    acc = W.mix(np.arange(1, bands + 1, dtype=np.uint64))
    for column in signature.reshape(bands, rows).T:
        acc = W.mix(acc * _ONE + np.ascontiguousarray(column).view(np.uint64))
    return acc.view(np.int64)


def _signed(k: int, inside: np.ndarray, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch):
                sets, names = named_sets(data, offsets, k, inside)
                sizes = [len(s) for s in sets]
                keys = [band_keys(super_minhash(s, bands * rows), bands, rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "node", "keys"],
                )

    return sign


def _verified(k: int, inside: np.ndarray, percent: int):
    """Keeps the pairs of rows (leader, node, leader_text, text) whose full shingle sets are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            for part, data, offsets in blocks(batch):
                keep = []
                for i, (s, leader) in enumerate(zip(shingle_sets(data, offsets, k, inside), part.column("leader_text").to_pylist(), strict=True)):
                    if last[0] != leader:
                        raw = leader.encode()
                        last = (leader, shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), k, inside)[0])
                    other = last[1]
                    small, large = sorted((len(s), len(other)))
                    if 100 * small < percent * large:
                        continue
                    both = small + large - len(np.unique(np.concatenate([s, other])))
                    if 100 * both >= percent * (small + large - both):
                        keep.append(i)
                rows = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column("leader"), rows.column("node")], names=["leader", "node"])

    return verify


def _links(pairs: DataFrame, texts: DataFrame, verify) -> DataFrame:
    """Pairs (leader, node) that hold. A leader's text is copied once for each MEMBERS of its nodes, so no task gets them all."""
    share = pairs.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("shares"))
    salted = pairs.join(share, "leader").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    leaders = share.join(texts.withColumnRenamed("node", "leader"), "leader")
    leaders = leaders.select("leader", F.col("text").alias("leader_text"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"))
    joined = salted.select("leader", "node", "salt").join(texts, "node").join(leaders, ["leader", "salt"])
    return joined.select("leader", "node", "leader_text", "text").mapInArrow(verify, "leader binary, node binary")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    inside: np.ndarray = W.SOLID,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes of the class ``inside`` (by default all but ASCII white space) after lower-casing A-Z; a
    document's set is its distinct k-word shingles, or its whole sequence if it has fewer words. Documents are linked
    if 100 * intersection >= percent * union; component_id is the smallest doc_id reachable, and the document that
    has it is kept.

    Equal sets are one node from the start, so copies cost nothing further. Nodes with an equal band meet. Each is
    first compared with one leader of its buckets; then, only where a bucket still holds several components, the nodes
    outside of its leader's component are compared with all of its nodes, block by block. Pairs of nodes are never
    rows, and no bucket is cut short. Every link is confirmed on the full sets of whole texts.

    A null or empty text, or one of white space, has an empty set, is linked with nothing and is kept. Null ids
    count as larger than all others; a row with a null id is kept if it reaches no other id. Rows that repeat an id
    get a row each. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    source = documents(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = saved(
        source.mapInArrow(_signed(k, inside, bands, rows), f"doc_id {kind}, n_shingles bigint, node binary, keys array<bigint>")
    )
    nodes = saved(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys")))
    hits = nodes.select("node", F.explode("keys").alias("key"))
    shared = hits.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = saved(hits.join(shared, "key"))
    # a bucket's leader is the node that meets most others in all its buckets: of edited copies, that nearest to their source
    met = buckets.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = buckets.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("leader"))
    buckets = saved(buckets.select("key", "node").join(leaders, "key"))
    stars = buckets.where("leader != node").groupBy("leader", "node").agg(F.count("*").alias("n"))
    wanted = buckets.select("node").distinct().join(nodes.select("node", "first_id"), "node")
    # the text of each node that may have links, by the first document of the set; one of a repeated id may be another text
    texts = saved(
        source.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")))
        .select("node", "text")
        .mapInArrow(_own_text(k, inside), "node binary, text string")
        .dropDuplicates(["node"])
    )
    # first each node against the leader it shares most bands with
    best = stars.groupBy("node").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader")).select("leader", "node")
    links = saved(_links(best, texts, _verified(k, inside, percent)))
    # then, where a bucket still holds several components, its nodes outside of the leader's against all of its nodes
    member, more = _rest(buckets, components(links), texts, _compared(k, inside, percent))
    done = components(links.unionByName(more))
    released(buckets, texts, member, links)
    members = nodes.select("node", "first_id").join(done, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = members.join(ids, "component").select("node", "component_id")
    found = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    group = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept"))


def _own_text(k: int, inside: np.ndarray):
    """Keeps rows whose text has the set that the node names."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch):
                names = named_sets(data, offsets, k, inside)[1]
                keep = [i for i, (own, name) in enumerate(zip(names, part.column(0).to_pylist(), strict=True)) if own == name]
                yield part.take(pa.array(keep, pa.int64()))

    return check


def _rest(buckets: DataFrame, done: DataFrame, texts: DataFrame, compare) -> tuple[DataFrame, DataFrame]:
    """Links (leader, node) across the components that buckets still hold, and the table of nodes that they come from.

    Buckets whose leaders are in one component make a group. Its nodes outside that component are compared with all
    its nodes. Both sides are cut into blocks of about BLOCK_TEXT bytes or BLOCK_NODES nodes, and a task takes a pair of
    blocks at a time: no pair of nodes is ever a row, and a node's text is copied once for each block of the other side.
    """
    placed = buckets.join(done, "node", "left").withColumn("component", F.coalesce("component", "node"))
    homes = done.select(F.col("node").alias("leader"), F.col("component").alias("home"))
    placed = placed.join(homes, "leader", "left").withColumn("home", F.coalesce("home", "leader"))
    mixed = placed.where("component != home").select("key").distinct()
    member = placed.join(mixed, "key").select("home", "node", "component").distinct().join(texts, "node")
    member = saved(member.withColumn("outside", F.col("component") != F.col("home")).withColumn("size", F.length("text") + 64))

    def parts(size: Column, n: Column) -> Column:
        return F.greatest(F.ceil(size / BLOCK_TEXT), F.ceil(n / BLOCK_NODES)).cast("int")

    # only of groups with more than one block: there are at most as many as there are blocks
    large = member.groupBy("home").agg(
        parts(F.sum(F.when(F.col("outside"), F.col("size"))), F.count_if("outside")).alias("rows"), parts(F.sum("size"), F.count("*")).alias("columns")
    ).where("columns > 1")
    placed = member.join(saved(large), "home", "left").withColumn("rows", F.coalesce("rows", F.lit(1))).withColumn("columns", F.coalesce("columns", F.lit(1)))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = placed.where("outside").select("home", own("rows").alias("row"), every("columns").alias("column"), F.lit(True).alias("one"), "node", "component", "text")
    other = placed.select("home", every("rows").alias("row"), own("columns").alias("column"), F.lit(False).alias("one"), "node", "component", "text")
    block = ["home", "row", "column"]
    both = one.unionByName(other)
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return member, both.repartition(n, *block).sortWithinPartitions(*block).mapInArrow(compare, "leader binary, node binary")


def similar(sets: list[np.ndarray], ones: np.ndarray, others: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of ones, of others) of similar enough sets, some rows at a time; ones and others are numbers of sets.

    All intersections are a product of two matrices, over the hashes that at least two sets have, a slice of these at a
    time. Besides the sets, memory is that of one table of counts, 4 bytes for each pair.
    """
    sizes = np.array([len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[inverse] > 1
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[keep]
    place = (np.cumsum(counts > 1, dtype=np.int32) - 1)[inverse[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    shared = int((counts > 1).sum())
    del inverse, counts, keep, order
    width = max(1, min(shared, (16 << 20) // (4 * len(sets))))
    both = np.zeros((len(ones), len(others)), np.float32)
    step = max(1, (4 << 20) // (4 * len(others)))
    for low in range(0, shared, width):
        a, b = np.searchsorted(place, [low, low + width])
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[owner[a:b], place[a:b] - low] = 1
        right = matrix[others].T
        for i in range(0, len(ones), step):
            both[i : i + step] += matrix[ones[i : i + step]] @ right
    for i in range(0, len(ones), step):
        some = both[i : i + step].astype(np.int64)
        x, y = np.nonzero(100 * some >= percent * (sizes[ones[i : i + step], None] + sizes[others] - some))
        yield ones[x + i], others[y]


def _compared(k: int, inside: np.ndarray, percent: int):
    """Links of blocks' nodes; rows (home, row, column, one, node, component, text) come sorted by block.

    Of a node's links into one component, one is enough.
    """

    def links(group: list[tuple]) -> tuple[list, list]:
        nodes: dict[bytes, int] = {}
        sets, kinds = [], []
        for _, node, component, text in group:
            if node not in nodes:
                raw = text.encode()
                nodes[node] = len(sets)
                kinds.append(component)
                sets.append(shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), k, inside)[0])
        ones, others = (np.unique([nodes[node] for one, node, _, _ in group if one == side]).astype(np.int64) for side in (True, False))
        if not len(ones) or not len(others):
            return [], []
        names, number = list(nodes), {c: i for i, c in enumerate(sorted(set(kinds)))}
        kind = np.array([number[c] for c in kinds])
        left, right = [], []
        for x, y in similar(sets, ones, others, percent):
            apart = kind[x] != kind[y]
            x, y = x[apart], y[apart]
            _, first = np.unique(x * len(number) + kind[y], return_index=True)
            left += [names[j] for j in y[first].tolist()]
            right += [names[i] for i in x[first].tolist()]
        return left, right

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            left, right = [], []
            for *block, one, node, component, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != key:
                    found = links(group) if group else ([], [])
                    left += found[0]
                    right += found[1]
                    key, group = block, []
                group.append((one, node, component, text))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["leader", "node"])
        left, right = links(group) if group else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["leader", "node"])

    return compare


def near_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns, of each group of near duplicates the rows with the smallest doc_id.

    Rows that repeat that id all stay, as do documents without words, which are linked with nothing.
    """
    stays = near_groups(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias("id that stays")).distinct()
    return docs.join(stays, docs[id_col].eqNullSafe(F.col("id that stays")), "left_semi")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_groups`` of all documents on 2-word shingles."""
    return near_groups(table(spark, sf_dir, "documents"), k=2, percent=80)


OP9_SQL = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), u AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS grams FROM t
), g AS (
    SELECT md5(array_to_string(list_sort(grams), chr(10))) AS node, min(doc_id) AS first_id, any_value(grams) AS grams FROM u WHERE len(grams) > 0 GROUP BY ALL
), n AS (
    SELECT node, min(first_id) AS first_id, any_value(grams) AS grams, any_value(len(grams)) AS size FROM g GROUP BY node
), f AS (
    SELECT first_id, size, unnest(grams) AS gram FROM n
), c AS (
    SELECT gram, count(*) AS many FROM f GROUP BY gram
), o AS (
    SELECT f.*, row_number() OVER (PARTITION BY first_id ORDER BY many, gram) AS place FROM f JOIN c USING (gram)
), p AS (
    SELECT DISTINCT a.first_id AS one, b.first_id AS two FROM o a JOIN o b USING (gram)
    WHERE a.first_id < b.first_id AND a.place <= a.size - ceil(0.8 * a.size) + 1 AND b.place <= b.size - ceil(0.8 * b.size) + 1
    AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size)
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
SELECT u.doc_id, len(u.grams)::BIGINT AS n_shingles, coalesce(m.component_id, u.doc_id) AS component_id, coalesce(m.component_id, u.doc_id) = u.doc_id AS kept
FROM u LEFT JOIN n ON len(u.grams) > 0 AND n.node = md5(array_to_string(list_sort(u.grams), chr(10))) LEFT JOIN m ON m.one = n.first_id
"""
