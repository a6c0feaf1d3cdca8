"""A table of requests through the router, the section tree and the hybrid search, in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import CANDIDATES, CONTEXT_TOKENS, FINAL, STRUCTURED_TYPES
from . import postings, routing, search, vectors

#: What requests may restrict.
FACETS = ("company_id", "fiscal_year", "section_type")


@dataclass(frozen=True)
class Library:
    """What requests are answered from.

    documents (doc_id, company_id, fiscal_year, ingestion_status); nodes (id, doc_id, section_type, text); chunks (id,
    company_id, fiscal_year, section_type, text); the chunks' keyword index and their vector index with FACETS.
    """

    documents: DataFrame
    nodes: DataFrame
    chunks: DataFrame
    words: postings.Index
    vectors: vectors.Index


def companies(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(asked, company_id) of distinct names: the known ones that match, without regard to case, a blank for any one character.

    A name without % is as long as what it matches, so names meet by their lengths.
    """
    names = known.select("company_id").where("company_id IS NOT NULL").distinct()
    given = asked.select(F.col("company_id").alias("asked")).where("asked IS NOT NULL").distinct()
    test = F.expr("lower(company_id) LIKE lower(replace(asked, ' ', '_'))")
    long = given.withColumn("size", F.length("asked")).join(names.withColumn("size", F.length("company_id")), "size").where(test).drop("size")
    return long.where(~F.col("asked").contains("%")).unionByName(given.where(F.col("asked").contains("%")).join(names, test))


def understood(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests (query_id, question, company_id, fiscal_year, section_types, tier) with what the rules read from them.

    ``tier`` is the given one or the router's; ``company_id``, ``fiscal_year`` and ``section_type`` become the values
    allowed, as arrays of texts, null for all: the year that is given, else those that the question names. ``tree`` says
    that the section tree answers: facts, references without section types, or sections that hold tables, if company,
    year and section types are known.
    """
    rows = requests.withColumn("question", F.coalesce("question", F.lit("")))
    routes = routing.routed(rows, "query_id", "question").select(F.col("id").alias("query_id"), F.col("tier").alias("guess"))
    names = companies(rows, known).groupBy("asked").agg(F.array_sort(F.collect_set("company_id")).alias("names"))
    rows = rows.join(routes, "query_id").join(names, F.col("company_id") == F.col("asked"), "left")
    tier = F.coalesce("tier", "guess")
    found = routing.years(F.col("question"))
    year = F.when(F.col("fiscal_year").isNotNull(), F.array("fiscal_year")).when(F.size(found) > 0, found)
    kinds = F.when(F.size("section_types") > 0, F.col("section_types"))
    structured = F.coalesce(F.exists(kinds, lambda s: s.isin(*STRUCTURED_TYPES)), F.lit(False))
    company = F.when(F.length("company_id") > 0, F.coalesce("names", F.array().cast("array<string>")))
    tree = ((tier == "T1") | structured | ((tier == "T3") & kinds.isNull())) & company.isNotNull() & year.isNotNull() & kinds.isNotNull()
    return rows.select("query_id", "question", tier.alias("tier"), company.alias("company_id"), year.cast("array<string>").alias("fiscal_year"), kinds.alias("section_type"), tree.alias("tree"))


def by_tree(library: Library, rows: DataFrame, k: int) -> DataFrame:
    """Nodes of completed documents that fit, at score 1, by id.

    Requests meet only the k first nodes of each company, year and section type: the first of several of these are among
    the first of each. So no request meets all that fit it.
    """
    docs = library.documents.where("ingestion_status = 'completed'").select("doc_id", "company_id", F.col("fiscal_year").cast("string").alias("fiscal_year")).distinct()
    group = ["company_id", "fiscal_year", "section_type"]
    nodes = library.nodes.select("id", "doc_id", "section_type").join(docs, "doc_id")
    nodes = nodes.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("id"))).where(F.col("place") <= k).drop("place", "doc_id")
    wanted = rows.select("query_id", F.explode("company_id").alias("company_id"), "fiscal_year", "section_type")
    wanted = wanted.select("query_id", "company_id", F.explode("fiscal_year").alias("fiscal_year"), "section_type")
    wanted = wanted.select("query_id", "company_id", "fiscal_year", F.explode("section_type").alias("section_type")).distinct()
    found = wanted.join(nodes, group).select("query_id", "id").distinct()
    first = Window.partitionBy("query_id").orderBy("id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.lit(1.0).alias("score"), F.lit("tree").alias("score_source"))


def by_hybrid(library: Library, rows: DataFrame, k: int, candidates: int, exact: bool) -> DataFrame:
    """The best chunks of those that fit, by words and by vectors, fused."""
    dense = vectors.nearest(library.vectors, rows, candidates, exact=exact)
    words = postings.asked(rows, "query_id", "question").join(rows.select("query_id", *FACETS), "query_id")
    sparse = postings.answered(library.words, words, candidates, facts=library.chunks.select("id", *FACETS))
    found = search.fused_batch(dense, sparse.select("query_id", "id", "score"), k=k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "id", "score", F.lit("hybrid").alias("score_source"))


def retrieved(library: Library, requests: DataFrame, k: int = FINAL, candidates: int = CANDIDATES, exact: bool = False) -> DataFrame:
    """(query_id, tier, rank, id, score, score_source): the k best nodes or chunks of every request of a table.

    Requests have query_id, question and vector, and company_id, fiscal_year, section_types and tier where these are known.
    The whole table goes through one plan: nothing is asked of the driver, whatever the number of requests.
    """
    rows = understood(requests, library.chunks)
    tree = by_tree(library, rows.where("tree"), k)
    hybrid = by_hybrid(library, rows.where("NOT tree").join(requests.select("query_id", "vector"), "query_id"), k, candidates, exact)
    return tree.unionByName(hybrid).join(rows.select("query_id", "tier"), "query_id").select("query_id", "tier", "rank", "id", "score", "score_source")


def contexts(found: DataFrame, texts: DataFrame, size: Column, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """The first rows of each request by rank as far as a budget of tokens goes, with their sizes and running totals; it stops at the first that does not fit."""
    sized = found.join(texts.select("id", size.alias("tokens")), "id")
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sized.withColumn("total", F.sum("tokens").over(before)).where(F.col("total") <= budget)
