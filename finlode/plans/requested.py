"""Requests by the table: every conversation turn through router, tree and hybrid search, with SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import SECTION_TYPES, STRUCTURED_TYPES, TABLE_PHRASES
from ..operators import postings, requests, search, vectors
from ..sources.scratch import scratch
from .indexed import _SCORE, _TOKENS, _keyword_index
from .retrieval import table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of reports: a company, a year and a section type for each."""
    kind = F.array(*(F.lit(t) for t in SECTION_TYPES))[(F.col("doc_id") % 16).cast("int")]
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "doc_id", F.col("source").alias("company_id"), (2018 + F.col("doc_id") % 5).alias("fiscal_year"), kind.alias("section_type"), "text"
    )


@cache
def _vector_root(_: str, sf_dir: str) -> str:
    """The folder of the chunks' vector index, built once a session."""
    root = scratch(spark := SparkSession.active())
    rows = _chunks(spark, sf_dir).join(table(spark, sf_dir, "embeddings"), F.col("vec_id") == F.col("id") % 500)
    model = vectors.fitted(rows, bits=8)
    vectors.stored(spark, model, root)
    vectors.built(rows, root, "all", model, facets=requests.FACETS)
    return root


def _library(spark: SparkSession, sf_dir: str) -> requests.Library:
    chunks = _chunks(spark, sf_dir)
    docs = chunks.select("doc_id", "company_id", "fiscal_year", F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("completed").alias("ingestion_status"))
    nodes = chunks.select((F.col("id") + 1_000_000_000).alias("id"), "doc_id", "section_type", "text")
    near = vectors.opened(spark, _vector_root(spark.sparkContext.applicationId, sf_dir), facets=requests.FACETS)
    return requests.Library(docs, nodes, chunks, _keyword_index(spark, sf_dir), near)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a request: two of its words, with phrases, years, companies, sections and tiers by its number."""
    turns = table(spark, sf_dir, "conversations").withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    words = postings.asked(turns, "query_id", "text").select("query_id", F.array_join(F.slice(F.array_sort("terms"), 1, 2), " ").alias("two"))
    conv, turn = F.col("conv_id"), F.col("turn")
    more = F.when(turn % 4 == 1, " 2019 and 2021").when((turn % 4 == 2) & (conv % 2 == 0), " see Note 5").when(turn % 4 == 3, " net profit path").otherwise("")
    vector = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
    return turns.join(words, "query_id").join(vector, (conv * 8 + turn) % 500 == F.col("vec_id")).select(
        "query_id", F.concat("two", more).alias("question"), "vector",
        F.when(conv % 3 == 0, F.concat(F.lit("SRC"), (conv % 20).cast("string"))).when(conv % 3 == 2, F.concat(F.lit("src "), (conv % 10).cast("string"))).alias("company_id"),
        F.when(turn % 3 == 0, (2018 + conv % 5).cast("int")).alias("fiscal_year"),
        F.when(conv % 4 < 2, F.array(F.lit("balance_sheet"), F.lit("cash_flow"), F.lit("mda"))).when(conv % 4 == 2, F.array(F.lit("mda"))).alias("section_types"),
        F.when(conv % 10 == 0, "T1").alias("tier"),
    )


def retrieval_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best nodes or chunks of every request, with its tier and where they come from."""
    found = requests.retrieved(_library(spark, sf_dir), _requests(spark, sf_dir), 5, 20, exact=True)
    return found.select("query_id", "tier", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 9).alias("score"), "score_source")


def context_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every request's five best, those within 300 tokens, with running totals."""
    library = _library(spark, sf_dir)
    found = requests.retrieved(library, _requests(spark, sf_dir), 5, 20, exact=True)
    texts = library.nodes.select("id", "text").unionByName(library.chunks.select("id", "text"))
    kept = requests.contexts(found, texts, F.size(search.tokens(F.col("text"))).cast("long"), 300)
    return kept.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "tokens", "total")


def requests_understood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules read from every request."""
    rows = requests.understood(_requests(spark, sf_dir), _chunks(spark, sf_dir))
    joined = [F.array_join(F.array_sort(c), ",").alias(c) for c in requests.FACETS]
    return rows.select("query_id", "tier", *joined, "tree")


QUERIES = {f.__name__: f for f in (retrieval_batch, context_batch, requests_understood)}

_KINDS = ", ".join(f"'{t}'" for t in SECTION_TYPES)
_TABLES = ", ".join(f"'{t}'" for t in STRUCTURED_TYPES)
_PHRASES = ", ".join(f"'{t}'" for t in TABLE_PHRASES)
#: Requests and what is read from them, as u (query_id, question, tier, companies, years, kinds, tree).
_UNDERSTOOD = rf"""
    WITH ch AS (SELECT doc_id AS id, source AS company_id, 2018 + doc_id % 5 AS year, [{_KINDS}][doc_id % 16 + 1] AS kind, text FROM documents),
    rq AS (SELECT conv_id * 1000 + turn AS query_id, e.embedding AS vector,
           array_to_string(list_sort(list_distinct(list_filter(string_split(lower(text), ' '), lambda x: regexp_full_match(x, '[\p{{L}}\p{{N}}]+'))))[1:2], ' ')
               || CASE WHEN turn % 4 = 1 THEN ' 2019 and 2021' WHEN turn % 4 = 2 AND conv_id % 2 = 0 THEN ' see Note 5' WHEN turn % 4 = 3 THEN ' net profit path' ELSE '' END AS question,
           CASE conv_id % 3 WHEN 0 THEN 'SRC' || conv_id % 20 WHEN 2 THEN 'src ' || conv_id % 10 END AS company, CASE WHEN turn % 3 = 0 THEN 2018 + conv_id % 5 END AS year,
           CASE WHEN conv_id % 4 < 2 THEN ['balance_sheet', 'cash_flow', 'mda'] WHEN conv_id % 4 = 2 THEN ['mda'] END AS kinds, CASE WHEN conv_id % 10 = 0 THEN 'T1' END AS forced
           FROM conversations JOIN embeddings e ON e.vec_id = (conv_id * 8 + turn) % 500),
    rt AS (SELECT *, list_transform(list_distinct(regexp_extract_all(question, '\b(20\d\d)\b', 1)), lambda y: y::BIGINT) AS named,
           len(list_filter([{_PHRASES}], lambda x: contains(lower(question), x))) > 0 AS phrase FROM rq),
    rg AS (SELECT *, coalesce(forced, CASE WHEN regexp_matches(question, '(?i)\bnote\s+\d+|\bschedule\s+[ivxlcdm]+\b') THEN 'T3' WHEN len(named) > 1 THEN 'T4' WHEN phrase THEN 'T1' ELSE 'T2' END) AS tier,
           CASE WHEN company IS NOT NULL THEN (SELECT coalesce(list(DISTINCT company_id), []) FROM ch WHERE company_id ILIKE replace(company, ' ', '_')) END AS companies,
           CASE WHEN year IS NOT NULL THEN [year] WHEN len(named) > 0 THEN named END AS years FROM rt),
    u AS (SELECT query_id, question, vector, tier, companies, years, kinds,
          (tier = 'T1' OR coalesce(len(list_intersect(kinds, [{_TABLES}])) > 0, false) OR (tier = 'T3' AND kinds IS NULL)) AND companies IS NOT NULL AND years IS NOT NULL AND kinds IS NOT NULL AS tree FROM rg)"""
#: The five best of each request, as f (query_id, tier, rank, id, score, score_source).
_FOUND = rf"""{_UNDERSTOOD}, {_TOKENS},
    p AS (SELECT id, term, count(*) AS tf, n FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM t) GROUP BY ALL),
    a AS (SELECT count(*) AS docs, sum(len(w)) / count(*) AS mean FROM t),
    d AS (SELECT term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, a GROUP BY term, docs),
    q AS (SELECT query_id, unnest(terms) AS term, len(terms) AS m, companies, years, kinds FROM (
          SELECT *, list_distinct(list_filter(string_split(lower(question), ' '), lambda x: regexp_full_match(x, '[\p{{L}}\p{{N}}]+'))) AS terms FROM u WHERE NOT tree)),
    s AS (SELECT query_id, p.id, {_SCORE} AS units FROM q JOIN p USING (term) JOIN d USING (term) JOIN ch ON ch.id = p.id, a
          WHERE (companies IS NULL OR company_id IN companies) AND (years IS NULL OR year IN years) AND (kinds IS NULL OR kind IN kinds) GROUP BY query_id, p.id, m HAVING count(*) = m),
    k AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, id) AS rk FROM s),
    v AS (SELECT query_id, ch.id, round(list_cosine_similarity(e.embedding::DOUBLE[], vector::DOUBLE[]), 12) AS score FROM u, ch JOIN embeddings e ON e.vec_id = ch.id % 500
          WHERE NOT tree AND (companies IS NULL OR company_id IN companies) AND (years IS NULL OR year IN years) AND (kinds IS NULL OR kind IN kinds)),
    n AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM v),
    h AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rk)), 12) AS score FROM (SELECT * FROM k WHERE rk <= 20 UNION ALL SELECT * FROM n WHERE rk <= 20) GROUP BY ALL),
    x AS (SELECT query_id, ch.id + 1000000000 AS id, 1.0::DOUBLE AS score FROM u JOIN ch ON company_id IN companies AND year IN years AND kind IN kinds WHERE tree AND ch.id % 7 <> 0),
    f AS (SELECT query_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score, source AS score_source
          FROM (SELECT *, 'tree' AS source FROM x UNION ALL SELECT *, 'hybrid' FROM h) JOIN u USING (query_id) QUALIFY rank <= 5)"""

ORACLE_SQL = {
    "requests_understood": f"{_UNDERSTOOD} SELECT query_id, tier, array_to_string(list_sort(companies), ',') AS company_id, array_to_string(list_sort(years), ',') AS fiscal_year, array_to_string(list_sort(kinds), ',') AS section_type, tree FROM u",
    "retrieval_batch": f"{_FOUND} SELECT query_id, tier, rank, id, round(score, 9) AS score, score_source FROM f",
    "context_batch": f"""{_FOUND},
    z AS (SELECT f.query_id, rank, f.id, len(t.w)::BIGINT AS tokens FROM f JOIN t ON t.id = f.id % 1000000000),
    y AS (SELECT *, (sum(tokens) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS total FROM z) SELECT * FROM y WHERE total <= 300""",
}
