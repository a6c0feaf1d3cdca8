"""Answering a question: route, retrieve, rerank, assemble; and the named tools on top."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import MetadataFilter
from ..functions.providers import Embedder, hash_embedder
from ..functions.scalars import likeness
from ..functions.vocab import CANDIDATES, CONTEXT_TOKENS, FINAL, STRUCTURED_TYPES
from . import references, routing, search


@dataclass(frozen=True)
class Store:
    """The tables that retrieval reads.

    documents (doc_id, company_id, report_type, fiscal_year, fiscal_quarter, ingestion_status); nodes and chunks
    (id, doc_id, section, section_type, text, and the documents' columns; chunks also embedding); tables (table_id,
    doc_id, section); links (table_id, ref_code, resolved_text).
    """

    documents: DataFrame
    nodes: DataFrame
    chunks: DataFrame
    tables: DataFrame
    links: DataFrame
    embed: Embedder = hash_embedder()


def infer(store: Store, question: str) -> tuple[str, MetadataFilter]:
    """The tier and conditions that the rules read from a question."""
    row = routing.routed(store.documents.sparkSession.createDataFrame([(question,)], "q string"), "q", "q").first()
    found = store.documents.sparkSession.createDataFrame([(question,)], "q string").select(routing.years(F.col("q"))).first()[0]
    return row["tier"], MetadataFilter(fiscal_year=found[0] if len(found) == 1 else None, fiscal_years=tuple(found) if len(found) > 1 else ())


def sections_found(store: Store, wanted: MetadataFilter) -> DataFrame:
    """Section types that a company's and years' nodes and chunks have: the menu of a router."""
    base = replace(wanted, section_types=())
    parts = [t.where(base.column()).select("section_type") for t in (store.nodes, store.chunks)]
    return parts[0].unionByName(parts[1]).distinct()


def use_tree(tier: str, wanted: MetadataFilter) -> bool:
    """Facts always go to the tree, references unless they name narrative sections, others if they name structured ones."""
    structured = any(s in STRUCTURED_TYPES for s in wanted.section_types)
    return tier == "T1" or structured or (tier == "T3" and not wanted.section_types)


def by_tree(store: Store, wanted: MetadataFilter) -> DataFrame:
    """Nodes of completed documents that fit, score 1; the newest documents first."""
    docs = store.documents.where("ingestion_status = 'completed'").where(replace(wanted, section_types=()).column(year_first=True)).select("doc_id", "fiscal_year")
    nodes = store.nodes.where(F.col("section_type").isin(*wanted.section_types)) if wanted.section_types else store.nodes
    return nodes.drop("fiscal_year").join(docs, "doc_id").select("id", "doc_id", "section", "section_type", "text", F.lit(1.0).alias("score"), F.lit("tree").alias("score_source"))


def by_hybrid(store: Store, question: str, wanted: MetadataFilter, k: int = CANDIDATES) -> DataFrame:
    """Dense and keyword candidates of chunks that fit, fused."""
    chunks = store.chunks.where(wanted.column())
    vector = store.embed([question])[0]
    terms = store.documents.sparkSession.createDataFrame([(question,)], "q string").select(search.query_terms(F.col("q"))).first()[0]
    found = search.fused(search.dense_top_k(chunks, vector, k), search.keyword_top_k(chunks, tuple(terms), k), k=k)
    return F.broadcast(found).join(chunks, "id").select("id", "doc_id", "section", "section_type", "text", "score", F.lit("hybrid").alias("score_source"))


def retrieved(store: Store, question: str, explicit: MetadataFilter = MetadataFilter(), tier: str | None = None, k: int = FINAL) -> DataFrame:
    """The best chunks for a question, ranked; a forced tier skips the router.

    The tree needs a company, a year and section types; without them, as for everything else, the search is hybrid.
    """
    guess, inferred = infer(store, question)
    wanted = explicit.or_else(inferred)
    enough = wanted.company_id and (wanted.fiscal_year or wanted.fiscal_years) and wanted.section_types
    if use_tree(tier or guess, wanted) and enough:
        rows = by_tree(store, wanted)
    else:
        rows = by_hybrid(store, question, wanted)
    best = search.reranked(rows, None, k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def assembled(store: Store, rows: DataFrame, budget: int = CONTEXT_TOKENS) -> tuple[DataFrame, DataFrame, int]:
    """Chunks within the token budget, the references of their tables, and the tokens of both."""
    kept = search.context(rows.withColumn("tokens", F.size(search.tokens(F.col("text"))).cast("long")), budget)
    refs = references.looked_up(kept, store.tables, store.links)
    own = kept.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    more = refs.agg(F.coalesce(F.sum(F.size(search.tokens(F.concat_ws(": ", "ref_code", "resolved_text")))), F.lit(0))).first()[0]
    return kept, refs, own + more


def rendered(rows: DataFrame, nothing: str) -> str:
    """Ranked chunks as text, each under a header; a message if there are none."""
    parts = [f"--- Section: {r['section_type']} ---\n{r['text']}" for r in rows.orderBy("rank").select("section_type", "text").collect()]
    return "\n\n".join(parts) or nothing


# Tools by name, with their forced tier and section types; and what they say when nothing is found.
TOOLS = {
    "financial_statements": ("T1", ("balance_sheet", "profit_loss", "cash_flow"), "no statements found"),
    "cross_references": ("T2", (), "no references found"),
    "trends": ("T4", (), "no history found"),
    "narrative": ("T2", ("mda", "directors_report", "vision_mission", "management_profile"), "no passages found"),
    "risk": ("T2", ("risk_factors", "corporate_governance", "auditors_report"), "no risk passages found"),
}


def tool(store: Store, name: str, question: str, explicit: MetadataFilter) -> str:
    """A tool's answer: at most FINAL chunks, so what comes to the driver is bounded."""
    tier, types, nothing = TOOLS[name]
    wanted = replace(explicit, section_types=explicit.section_types or types)
    kept, _, _ = assembled(store, retrieved(store, question, wanted, tier))
    return rendered(kept, nothing)


def _pairs(text: Column) -> Column:
    """A text's distinct pairs of neighbouring characters, with a blank at both ends."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def matched_names(rows: DataFrame, given: str, known: DataFrame, name: str, cutoff: float = 0.3) -> DataFrame:
    """``rows`` with ``company``: the known name that a given one means.

    That is the name itself or its upper case, if known; else the most similar of the known names that share a pair of
    neighbouring characters with it, by difflib's ratio of lower-case names, if that is ``cutoff`` or more, ties to the
    later in order; else the name as it is given. An exchange's suffix is left aside. Only distinct names are compared,
    and names without a common pair never meet. Null names stay null.
    """
    names = known.select(F.col(name).alias("known")).where("known IS NOT NULL").distinct()
    asked = rows.select(F.col(given).alias("asked")).where("asked IS NOT NULL").distinct()
    exact = asked.join(names, F.col("asked") == F.col("known")).select("asked", F.col("known").alias("same"))
    upper = asked.join(names, F.upper("asked") == F.col("known")).select("asked", F.col("known").alias("upper"))
    slugs = asked.withColumn("slug", F.trim(F.regexp_replace(F.lower("asked"), r"\.(ns|bo)", "")))
    lowered = names.groupBy(F.lower("known").alias("low")).agg(F.max("known").alias("known"))
    pairs = slugs.select("slug", F.explode(_pairs(F.col("slug"))).alias("pair")).join(lowered.select("low", F.explode(_pairs(F.col("low"))).alias("pair")), "pair").select("slug", "low").distinct()
    scored = pairs.withColumn("ratio", likeness("low", "slug")).where(F.col("ratio") >= cutoff)
    best = scored.groupBy("slug").agg(F.max(F.struct("ratio", "low"))["low"].alias("low")).join(lowered, "low").select("slug", F.col("known").alias("near"))
    found = slugs.join(exact, "asked", "left").join(upper, "asked", "left").join(best, "slug", "left")
    found = found.select("asked", F.coalesce("same", "upper", "near", "asked").alias("company"))
    return rows.join(found, F.col(given) == F.col("asked"), "left").drop("asked")
