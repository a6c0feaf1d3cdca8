"""The trie of conversations' shared prefixes, from chained digests, with sums over subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Conversation ids that are joined into one text before the digest of a node's ids is taken.
ID_RANGE = 1 << 16
#: A conversation takes fewer turns than this of its family's first one.
HEADS = 9
#: Paths that are handed on at a time.
BATCH = 10_000

_ROOT = hashlib.sha256(b"").digest()
_PATHS = "conv_id bigint, depth bigint, digest binary, parent binary, size bigint, ends boolean"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every prefix of every rebuilt conversation: its depth, chained digest, parent's digest, bytes of the last text, and if it is all.

    Rows (family, own, conv_id, h, turn digest, size) come sorted by family, with its first conversation's turns before the
    others', and by turn. Held are at most HEADS turns of that one and one prefix.
    """
    family = conv = None
    head: list[tuple] = []
    seen = take = 0
    now: tuple = ()
    out: list[tuple] = []

    def step(turn: bytes, size: int) -> None:
        nonlocal now
        out.append((*now, False))
        _, depth, digest, _, _ = now
        now = (conv, depth + 1, hashlib.sha256(digest + turn).digest(), digest, size)

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        names = ["conv_id", "depth", "digest", "parent", "size", "ends"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for of, first, c, h, turn, size in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if of != family:
                family, head = of, []
            if c != conv:
                if conv is not None:
                    out.append((*now, True))
                conv, seen, take = c, 0, 0 if first else h
                now = (c, 0, _ROOT, None, 0)
                for one in head[:take]:
                    step(*one)
            seen += 1
            if first and seen < HEADS:
                head.append((turn, size))
            if seen > take:
                step(turn, size)
        if len(out) >= BATCH:
            yield batch_of()
            out.clear()
    if conv is not None:
        out.append((*now, True))
    if out:
        yield batch_of()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, whose texts come in order of their ranges; a range's text is all that is held."""
    at, sha = None, None
    for batch in batches:
        nodes, sums = [], []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if node != at:
                if at is not None:
                    nodes.append(at)
                    sums.append(sha.hexdigest())
                at, sha = node, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sums, pa.string())], names=["digest", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()])], names=["digest", "ends_sha256"])


def prefix_paths(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 1) -> DataFrame:
    """(conv_id, depth, digest, parent, size, ends): each prefix of each conversation, from the empty one on.

    A turn's digest is the SHA-256 of its role's length, role and text, so only digests and lengths are shuffled, never
    texts; a prefix's is that of its parent's digest and its last turn's. Turns go by ``turn``, null first, ties by that
    digest. With a ``family`` above 1, conversation c takes the first h turns of conversation c - c % family in place of
    its own first h, with h the CRC-32 of its decimal id modulo 9; all if there are fewer, none if that conversation is
    absent. A conversation may be left without turns. Rows with a null id belong to no conversation.
    """
    c = conversations
    role, text = (F.coalesce(c[name].cast("string"), F.lit("")) for name in (role_col, text_col))
    conv = c[conv_col].cast("bigint")
    turn = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = c.select(conv.alias("conv_id"), c[turn_col].alias("turn"), turn.alias("digest"), F.octet_length(text).cast("bigint").alias("size")).where("conv_id IS NOT NULL")
    rows = rows.withColumn("family", F.col("conv_id") - F.col("conv_id") % family).withColumn("own", F.col("family") == F.col("conv_id"))
    rows = rows.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int"))
    order = ["family", F.desc("own"), "conv_id", F.asc_nulls_first("turn"), "digest"]
    n = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "family").sortWithinPartitions(*order).select("family", "own", "conv_id", "h", "digest", "size").mapInArrow(_chained, _PATHS)


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 1) -> DataFrame:
    """One row for each distinct sequence of first turns (role, text): a node of the trie that the conversations share.

    conv_id, the smallest conversation that begins with it; depth, its turns; parent_conv_id, that of the node without
    its last turn, null for the root; n_convs, the conversations that begin with it; n_children; n_leaves, the nodes
    without children in its subtree; saved_tokens, over its subtree, the bytes of each node's last text for each of its
    conversations but one; ends_sha256, over the decimal ids, ascending and joined by commas, of the conversations that
    end there. A subtree includes its top.

    ``prefix_paths`` gives every prefix with its digest; those of equal depth and digest are a node. A node's ancestors
    are the shorter prefixes of its smallest conversation. So what the nodes of one such conversation add to an ancestor
    is first summed along the conversation and then added once for each of its prefixes: rows stay as many as there are
    prefixes, however deep the trie. Nodes that many conversations have, and nodes with many children, are counted
    before the shuffle; ids that end at one node are joined by ranges and then streamed through the digest.

    Null roles and texts count as empty; a null id is no conversation; repeated rows are turns of their own. Without
    conversations there is no root and the result is empty. Other columns are ignored, whatever their names.
    """
    paths = saved(prefix_paths(conversations, conv_col, turn_col, role_col, text_col, family))
    nodes = saved(
        paths.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("size").alias("size"))
    )
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    tree = saved(nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # by conversation: its prefixes, and what the nodes that it is the smallest of add to them and to all shorter ones
    own = tree.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaves"))
    zero = F.lit(0).cast("bigint")
    longer = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    along = paths.select("conv_id", "depth", "digest", zero.alias("saved"), zero.alias("leaves")).unionByName(own)
    along = along.select("digest", F.sum("saved").over(longer).alias("saved"), F.sum("leaves").over(longer).alias("leaves")).where("digest IS NOT NULL AND (saved > 0 OR leaves > 0)")
    sums = along.groupBy("digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ranges = paths.where("ends").groupBy("digest", F.floor(F.col("conv_id") / ID_RANGE).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = ranges.repartition(n, "digest").sortWithinPartitions("digest", "part").mapInArrow(_digested, "digest binary, ends_sha256 string")
    # the root's own children, of which there are most, need no join: its smallest conversation is one value
    root = F.broadcast(tree.where("depth = 0").select(F.col("conv_id").alias("root_conv_id")))
    names = tree.where("depth > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = tree.where("depth > 1").join(names, "parent")
    shallow = tree.where("depth <= 1").crossJoin(root).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_conv_id"))).drop("root_conv_id")
    found = deep.unionByName(shallow).join(sums, "digest").join(ends, "digest", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prefix_trie`` of all conversations, rebuilt in families of five."""
    return prefix_trie(table(spark, sf_dir, "conversations"), family=5)


#: CRC-32 bit by bit, over the characters of a decimal number.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), "
    "lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
)
OP12_SQL = f"""
WITH RECURSIVE t AS (
    SELECT conv_id, strlen(coalesce(text, '')) AS size, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_sha, turn
    FROM conversations WHERE conv_id IS NOT NULL
), o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_sha) AS pos FROM t
), c AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), b AS (
    SELECT c.conv_id, pos, size, turn_sha FROM c JOIN o ON o.conv_id = c.base WHERE pos <= h
    UNION ALL
    SELECT c.conv_id, CASE WHEN c.conv_id = base THEN 0 ELSE 100000 END + pos, size, turn_sha FROM c JOIN o USING (conv_id) WHERE pos > h
), r AS (
    SELECT conv_id, size, turn_sha, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM b
), p AS (
    SELECT conv_id, 0::BIGINT AS depth, '' AS node, NULL::VARCHAR AS parent, 0::BIGINT AS size FROM c
    UNION ALL
    SELECT p.conv_id, r.depth, md5(p.node || r.turn_sha), p.node, r.size FROM p JOIN r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1
), l AS (
    SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id
), n AS (
    SELECT depth, node, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(size) AS size,
           sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (depth = len), '')) AS ends_sha256
    FROM p JOIN l USING (conv_id) GROUP BY ALL
), k AS (
    SELECT n.*, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND m.parent = n.node) AS n_children FROM n
), s AS (
    SELECT a.depth, a.node, sum((k.n_convs - 1) * k.size)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves
    FROM k JOIN p a ON a.conv_id = k.conv_id AND a.depth <= k.depth GROUP BY ALL
)
SELECT k.conv_id, k.depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k JOIN s USING (depth, node) LEFT JOIN n q ON q.depth = k.depth - 1 AND q.node = k.parent
"""
