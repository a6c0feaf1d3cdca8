"""Retrieval queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import MetadataFilter, any_keyword, company_like, file_has, file_starts
from ..operators import chunking, retrieve, routing, search
from ..sources.tables import newest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TERMS = ("the", "in")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of id 0, as a question's."""
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0])


def _dense(spark: SparkSession, sf_dir: str, k: int = 50, where=None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return search.dense_top_k(rows, _query_vector(spark, sf_dir), k, where)


def _keyword(spark: SparkSession, sf_dir: str, every: bool, k: int = 50) -> DataFrame:
    return search.keyword_top_k(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), TERMS, k, every)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_dense(spark, sf_dir))


def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_dense(spark, sf_dir, 20, F.col("label").isin(1, 2, 3)))


def dense_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors to each whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = search.dense_batch(rows.select(F.col("vec_id").alias("id"), "embedding"), queries, 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


def sparse_bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_keyword(spark, sf_dir, True))


def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and keyword candidates, fused."""
    found = search.fused(_dense(spark, sf_dir), _keyword(spark, sf_dir, False))
    return found.select("id", F.round("score", 9).alias("score"))


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of the fused candidates, by an offline scorer: the share of a text's characters that are vowels."""
    found = search.fused(_dense(spark, sf_dir), _keyword(spark, sf_dir, False))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    joined = texts.join(F.broadcast(found.select("id", "score")), "id")
    scorer = F.round(F.length(F.regexp_replace("text", "[^aeiou]", "")) / F.length("text"), 9)
    return search.reranked(joined.select("id", "text", "score"), scorer).select("id", "score")


def context_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused candidates in rank order as far as 2000 tokens go, with running totals."""
    found = search.ranked(search.fused(_dense(spark, sf_dir), _keyword(spark, sf_dir, False)))
    size = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.size(search.tokens(F.col("text"))).cast("long").alias("tokens"))
    rows = size.join(F.broadcast(found.select("id", "rank")), "id")
    return search.context(rows, 2000).select("id", F.col("rank").cast("long").alias("rank"), "tokens", "total")


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents in order of id as far as 5000 characters go."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return search.within_budget(rows, "source", "doc_id", "n_chars", 5000)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 tokens that overlap by 16, as they are cut; their texts as MD5."""
    found = chunking.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", 128, 16, tail=True, trim=False)
    whole = F.array_join(F.filter(F.split("chunk_text", r"\s+"), lambda w: w != ""), " ")
    return found.select("id", F.col("chunk_index").cast("long").alias("chunk_index"), "n_tokens", F.md5(whole).alias("chunk_md5"))


def chunk_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    quarter = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Q"), (F.col("doc_id") % 4 + 1).cast("string")))
    year = (F.lit(2020) + F.col("doc_id") % 5).cast("int")
    head = chunking.prefix(F.col("source"), F.lit("annual"), year, quarter, F.lit("risk_factors"), F.concat(F.lit("in "), F.col("lang")))
    return docs.select("doc_id", head.alias("prefix"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 37 + 1).cast("int").alias("total_pages"))
    return chunking.page_ranges(pages).select("id", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"))


def company_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return rows.where(company_like(F.col("c_name"), "customer#0000_00 1_") | company_like(F.col("c_mktsegment"), "auto%"))


def doc_find_year_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: those of two years and one quarter, newest first."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("fiscal_quarter"), F.col("o_orderstatus").alias("status")
    )
    wanted = MetadataFilter(fiscal_years=(1995, 1996), fiscal_quarter="Q2")
    return rows.where(wanted.column(year_first=True) & (F.col("status") == "F")).orderBy(F.desc("fiscal_year"), "document_id")


def filter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit conditions before inferred ones."""
    merged = MetadataFilter(fiscal_year=1995).or_else(MetadataFilter(fiscal_year=1996, fiscal_years=(1994, 1996), section_types=("F",)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderstatus").alias("section_type"))
    return rows.where(merged.column()).groupBy("fiscal_year", "section_type").agg(F.count("*").alias("n"))


def distinct_union_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"))
    return a.distinct().union(table(spark, sf_dir, "events").select("event_type").distinct()).distinct()


def router_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of conversation turns, with years and phrases added by turn so that every tier occurs."""
    text = (
        F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit(" net profit path")))
        .when(F.col("turn") % 4 == 1, F.concat("text", F.lit(" 2019 and 2021")))
        .when((F.col("turn") % 4 == 2) & (F.col("conv_id") % 2 == 0), F.concat("text", F.lit(" see Note 5")))
        .otherwise(F.col("text"))
    )
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.alias("q"))
    return routing.routed(rows, "id", "q")


def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ("licen", "password", "(375)", "Été")
    docs = table(spark, sf_dir, "documents")
    return docs.where(any_keyword(F.col("text"), words)).select("doc_id", "source")


def fuzzy_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations, every third misspelt and every fifth in lower case, matched to all known ones."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    name = F.col("n_name")
    spoilt = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.substring(name, 1, 2), F.lit("x"), F.substring(name, 4, 20))).when(F.col("c_custkey") % 5 == 0, F.concat(F.lower(name), F.lit(".ns"))).otherwise(name)
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", spoilt.alias("given"))
    return retrieve.matched_names(rows, "given", nations, "n_name").select("c_custkey", "company")


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names as file names: those that begin with one text or have another anywhere in them."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit("_AR.pdf")).alias("file_name"))
    return rows.where(file_starts(F.col("file_name"), "Supplier#00000000") | file_has(F.col("file_name"), "5_ar"))


def cover_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, quarters and kinds of reports, from the first lines of reports made of orders."""
    day = F.col("o_orderdate")
    quarter = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" for Q"), F.quarter(day).cast("string"))).otherwise("")
    text = F.concat(F.lit("Annual report"), quarter, F.lit(" of "), (F.year(day) + 20).cast("string"), F.lit(" and 2001"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.array(routing.cover_page(text))))
    return rows.select("o_orderkey", "fiscal_year", "fiscal_quarter", "report_type")


def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("created_at"))
    return newest(rows, 20)


_DENSE = """
    SELECT e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""
_BM25 = r"""
    t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
    c AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS tf0, len(list_filter(w, lambda x: x = 'in')) AS tf1 FROM t),
    a AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM c),
    s AS (SELECT id, tf0, tf1,
          ln(1 + (docs - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * n / mean))
        + ln(1 + (docs - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM c, a)"""
_FUSED = f"""
    WITH {_BM25.strip()},
    kw AS (SELECT id, score FROM s WHERE tf0 > 0 OR tf1 > 0 ORDER BY score DESC, id LIMIT 50),
    de AS (SELECT * FROM ({_DENSE}) ORDER BY score DESC, id LIMIT 50),
    r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM kw UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM de),
    f AS (SELECT id, sum(1.0::DOUBLE / (60 + rk)) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 50)"""

QUERIES = {
    f.__name__: f
    for f in (
        hybrid_rrf_topk, dense_topk_cosine, dense_topk_filtered, dense_batch, sparse_bm25_and, rerank_topk, context_assemble, context_budget, token_counts, chunk_overlap, chunk_prefix,
        page_ranges, company_ilike, doc_find_year_desc, filter_merge, distinct_union_types, router_rules, keyword_flags, fuzzy_company, file_names, cover_pages, newest_orders,
    )
}

ORACLE_SQL = {
    "file_names": "SELECT s_suppkey, s_name || '_AR.pdf' AS file_name FROM supplier WHERE starts_with(s_name, 'Supplier#00000000') OR contains(lower(s_name || '_AR.pdf'), '5_ar')",
    "cover_pages": """
        SELECT o_orderkey, year(o_orderdate)::INTEGER + 20 AS fiscal_year, CASE WHEN o_orderkey % 2 = 0 THEN 'Q' || quarter(o_orderdate) END AS fiscal_quarter,
               CASE WHEN o_orderkey % 2 = 0 THEN 'quarterly' ELSE 'annual' END AS report_type FROM orders""",
    "newest_orders": "SELECT o_orderkey AS id, o_orderdate::DATE AS created_at FROM orders ORDER BY 2 DESC, 1 LIMIT 20",
    "hybrid_rrf_topk": f"{_FUSED} SELECT id, round(score, 9) AS score FROM f",
    "dense_topk_cosine": f"SELECT id, round(score, 6) AS score FROM ({_DENSE}) ORDER BY score DESC, id LIMIT 50",
    "dense_topk_filtered": f"SELECT id, round(score, 6) AS score FROM ({_DENSE} WHERE e.label IN (1, 2, 3)) ORDER BY score DESC, id LIMIT 20",
    "dense_batch": """
        SELECT query_id, id, round(score, 6) AS score FROM (
            SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0
        ) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""",
    "sparse_bm25_and": f"WITH {_BM25.strip()} SELECT id, round(score, 6) AS score FROM s WHERE tf0 > 0 AND tf1 > 0 ORDER BY s.score DESC, id LIMIT 50",
    "rerank_topk": f"{_FUSED} SELECT f.id, round(length(regexp_replace(d.text, '[^aeiou]', '', 'g')) / length(d.text), 9) AS score FROM f JOIN documents d ON d.doc_id = f.id ORDER BY 2 DESC, 1 LIMIT 10",
    "context_assemble": f"""{_FUSED}, o AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f),
        z AS (SELECT o.id, rank, len(t.w)::BIGINT AS tokens FROM o JOIN t ON t.id = o.id),
        y AS (SELECT *, (sum(tokens) OVER (ORDER BY rank))::BIGINT AS total FROM z) SELECT id, rank, tokens, total FROM y WHERE total <= 2000""",
    "context_budget": "SELECT * FROM (SELECT source, doc_id, n_chars, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM documents) WHERE total <= 5000",
    "token_counts": r"SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)",
    "chunk_overlap": r"""
        WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE trim(text) <> ''),
        c AS (SELECT id, w, len(w) AS n, unnest(CASE WHEN len(w) <= 128 THEN [0] ELSE range(0, len(w), 112) END) AS first FROM t)
        SELECT id, (first // 112)::BIGINT AS chunk_index, least(128, n - first)::BIGINT AS n_tokens, md5(array_to_string(w[first + 1:first + 128], ' ')) AS chunk_md5 FROM c""",
    "chunk_prefix": """
        SELECT doc_id, '[' || source || ' | ' || CASE WHEN doc_id % 2 = 0 THEN 'Q' || (doc_id % 4 + 1) || ' ' || (2020 + doc_id % 5) ELSE 'Annual Report ' || (2020 + doc_id % 5) END
               || ' | Risk Factors]' || chr(10) || 'Summary: in ' || lang AS prefix FROM documents""",
    "page_ranges": """
        SELECT id, page_start, least(page_start + 9, total)::BIGINT AS page_end
        FROM (SELECT o_orderkey AS id, o_custkey % 37 + 1 AS total, unnest(range(1, o_custkey % 37 + 2, 10)) AS page_start FROM orders)""",
    "company_ilike": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE 'customer#0000_00_1_' OR c_mktsegment ILIKE 'auto%'",
    "doc_find_year_desc": "SELECT o_orderkey AS document_id, year(o_orderdate)::INTEGER AS fiscal_year, 'Q' || quarter(o_orderdate) AS fiscal_quarter, o_orderstatus AS status FROM orders WHERE year(o_orderdate) IN (1995, 1996) AND quarter(o_orderdate) = 2 AND o_orderstatus = 'F'",
    "filter_merge": "SELECT year(o_orderdate)::INTEGER AS fiscal_year, o_orderstatus AS section_type, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 AND o_orderstatus = 'F' GROUP BY ALL",
    "distinct_union_types": "SELECT lang AS kind FROM documents UNION SELECT event_type FROM events",
    "router_rules": r"""
        WITH q AS (SELECT conv_id * 1000 + turn AS id, coalesce(CASE WHEN turn % 4 = 0 THEN text || ' net profit path' WHEN turn % 4 = 1 THEN text || ' 2019 and 2021'
                   WHEN turn % 4 = 2 AND conv_id % 2 = 0 THEN text || ' see Note 5' ELSE text END, '') AS q FROM conversations),
        p AS (SELECT id, q, list_sort(list_filter(['balance sheet', 'profit and loss', 'p&l', 'eps', 'earnings per share', 'cash flow statement', 'total assets', 'total liabilities', 'net worth',
                   'shareholders equity', 'revenue from operations', 'ebitda', 'net profit', 'pat', 'gross block', 'depreciation', 'retained earnings'], lambda x: contains(lower(q), x)))[1] AS phrase,
                   len(list_distinct(regexp_extract_all(q, '\b(20\d\d)\b', 1)))::BIGINT AS n_years FROM q),
        g AS (SELECT *, CASE WHEN regexp_matches(q, '(?i)\bnote\s+\d+|\bschedule\s+[ivxlcdm]+\b') THEN 'T3' WHEN n_years > 1 THEN 'T4' ELSE 'T2' END AS guess FROM p),
        r AS (SELECT *, CASE WHEN guess = 'T2' THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence, guess = 'T2' AND phrase IS NOT NULL AS fallback FROM g)
        SELECT id, CASE WHEN fallback THEN 'T1' ELSE guess END AS tier, confidence,
               CASE WHEN fallback THEN 'pageindex_tree' WHEN guess = 'T2' THEN 'hybrid' WHEN guess = 'T3' THEN 'pageindex_refs' ELSE 'vector_multi_doc' END AS strategy, phrase, n_years, fallback FROM r""",
    "keyword_flags": r"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?i)licen|password|\(375\)|Été')",
}
