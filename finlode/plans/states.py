"""Nested states and batches that count once, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..sources import commits, tables
from ..sources.scratch import scratch
from ..streaming.ingest import committed_once
from .retrieval import table


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, state): every customer with its orders as nested JSON."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
    orders = orders.agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("orders"))
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    stats = F.struct(F.col("c_mktsegment").alias("segment"), F.coalesce("orders", F.array().cast("array<struct<key:bigint,status:string>>")).alias("orders"))
    return rows.select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.col("c_name").alias("name"), stats.alias("stats"))).alias("state"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, path, value): a new segment for every second customer, a note below a new parent, an order that goes, a name that becomes an object."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    k = F.col("id")

    def change(seq: int, every: int, dotted: str, value) -> DataFrame:
        return rows.where(k % every == 0).select("id", F.lit(seq).alias("seq"), state.step_path(F.lit(dotted)).alias("path"), value.cast("string").alias("value"))

    parts = [
        change(1, 2, "stats.segment", F.lit('"OLD"')), change(2, 2, "stats.segment", F.lit('"NEW"')), change(3, 3, "note.text", F.concat(F.lit('{"by":['), k.cast("string"), F.lit("]}"))),
        change(4, 5, "stats.orders[0]", F.lit(None)), change(5, 7, "name.first", F.lit('"x"')),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def state_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of the customers' states."""
    return state.flattened(_states(spark, sf_dir)).select("id", state.dotted(F.col("path")).alias("path"), "kind", "value")


def state_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states, taken apart and put together again."""
    return state.rebuilt(state.flattened(_states(spark, sf_dir)))


def state_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves after all changes."""
    return state.patched(state.flattened(_states(spark, sf_dir)), _changes(spark, sf_dir)).select("id", state.dotted(F.col("path")).alias("path"), "kind", "value")


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the changes did, by kind of change and top key."""
    before = state.flattened(_states(spark, sf_dir))
    found = state.changed(before, state.patched(before, _changes(spark, sf_dir)))
    return found.groupBy("change", F.col("path")[0].alias("top")).agg(F.count("*").alias("n"))


def ingest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in three batches into two tables, one batch tried twice, one that first fails half way, then compacted to the last version of each."""
    root, docs = scratch(spark), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    schemas = {"docs": "doc_id bigint, lang string, version int", "sizes": "doc_id bigint, n_chars bigint, version int"}

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        return {"docs": batch.select("doc_id", "lang", "version"), "sizes": batch.select("doc_id", "n_chars", "version")}

    def part(number: int) -> DataFrame:
        return docs.where(F.pmod("doc_id", F.lit(3)) <= number).withColumn("version", F.lit(number))

    for number in (0, 1, 1):
        committed_once(part(number), root, f"b-{number}", split)
    half = split(part(2))["docs"]
    half.write.parquet(f"{root}/docs/batch=b-2")  # a batch that wrote one table and no commit
    seen = commits.opened(spark, root, "docs", schemas["docs"]).agg(F.count("*").alias("n")).first()["n"]
    committed_once(part(2), root, "b-2", split)
    commits.compacted(spark, root, schemas, "c-0", lambda name, rows: tables.latest(rows, "doc_id", "version"))
    commits.cleaned(spark, root, tuple(schemas))
    committed_once(part(0), root, "b-0", split)  # replayed long after
    whole = commits.opened(spark, root, "docs", schemas["docs"]).join(commits.opened(spark, root, "sizes", schemas["sizes"]), ["doc_id", "version"])
    return whole.groupBy("lang", "version").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars")).withColumn("seen", F.lit(seen).cast("bigint"))


QUERIES = {f.__name__: f for f in (state_leaves, state_rebuilt, state_patched, state_changes, ingest_once)}

_ORDERS = "o AS (SELECT o_custkey AS id, o_orderkey AS key, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)"
_LEAVES = f"""
    {_ORDERS}, l AS (
    SELECT c_custkey AS id, 'name' AS path, 'string' AS kind, to_json(c_name)::VARCHAR AS value FROM customer
    UNION ALL SELECT c_custkey, 'stats.segment', 'string', to_json(c_mktsegment)::VARCHAR FROM customer
    UNION ALL SELECT id, 'stats.orders[' || i || '].key', 'number', key::VARCHAR FROM o
    UNION ALL SELECT id, 'stats.orders[' || i || '].status', 'string', to_json(status)::VARCHAR FROM o
    UNION ALL SELECT c_custkey, 'stats.orders', 'array', '[]' FROM customer WHERE c_custkey NOT IN (SELECT id FROM o))"""
_PATCHED = f"""{_LEAVES}, p AS (
    SELECT id, path, kind, CASE WHEN path = 'stats.segment' AND id % 2 = 0 THEN '"NEW"' ELSE value END AS value FROM l
    WHERE NOT (path = 'name' AND id % 7 = 0) AND NOT (starts_with(path, 'stats.orders[0]') AND id % 5 = 0)
    UNION ALL SELECT c_custkey, 'note.text.by[0]', 'number', c_custkey::VARCHAR FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'name.first', 'string', '"x"' FROM customer WHERE c_custkey % 7 = 0)"""

ORACLE_SQL = {
    "state_leaves": f"WITH {_LEAVES} SELECT * FROM l",
    "state_rebuilt": f"""WITH {_ORDERS}, a AS (SELECT id, list({{'key': key, 'status': status}} ORDER BY key) AS orders FROM o GROUP BY id)
        SELECT c_custkey AS id, to_json({{'name': c_name, 'stats': {{'segment': c_mktsegment, 'orders': coalesce(orders, [])}}}})::VARCHAR AS state FROM customer LEFT JOIN a ON a.id = c_custkey""",
    "state_patched": f"WITH {_PATCHED} SELECT * FROM p",
    "state_changes": f"""WITH {_PATCHED} SELECT CASE WHEN l.value IS NULL THEN 'added' WHEN p.value IS NULL THEN 'removed' ELSE 'changed' END AS change, regexp_extract(coalesce(l.path, p.path), '^[a-z]+') AS top, count(*) AS n
        FROM l FULL JOIN p ON l.id = p.id AND l.path = p.path WHERE l.value IS DISTINCT FROM p.value GROUP BY ALL""",
    "ingest_once": """SELECT lang, 2::INTEGER AS version, count(*) AS n, sum(n_chars)::BIGINT AS n_chars,
        (SELECT count(*) FILTER (doc_id % 3 <= 0) + count(*) FILTER (doc_id % 3 <= 1) FROM documents) AS seen FROM documents GROUP BY lang""",
}
