"""Heading trees of web pages and the references in them, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve
from .retrieval import table

_HEADING = r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, level, title): the headings of every page, in order."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit(_HEADING), 0)).alias("pos", "h"))
    title = F.trim(F.regexp_replace(F.regexp_replace("h", "<[^>]+>", " "), r"\s+", " "))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.regexp_extract("h", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), title.alias("title"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings of all pages of a site as one document, so that a document is long; every third page's headings one level down."""
    rows = _headings(spark, sf_dir)
    return rows.select(
        (F.col("doc_id") % 3).alias("doc_id"), (F.col("doc_id") * 1000 + F.col("pos")).alias("pos"), F.least(F.lit(6), F.col("level") + (F.col("doc_id") % 3 == 0).cast("int") + (F.col("pos") % 4).cast("int")).alias("level"), "title"
    )


def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every heading with its parent, its depth and the end of its subtree."""
    found = resolve.heading_tree(_sites(spark, sf_dir), width=4096)
    return found.select("doc_id", "pos", F.col("level").cast("long").alias("level"), "parent", F.col("depth").cast("long").alias("depth"), "end")


def heading_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of the subtree of every heading of level 3 or less, by ranges of places."""
    tree = resolve.heading_tree(_sites(spark, sf_dir), width=4096)
    return resolve.subtrees(tree, tree.where("level <= 3")).groupBy("doc_id", "top").agg(F.count("*").alias("n"))


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every document's first words, looked for in the texts of all documents of its source, by language as types."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "note_to_accounts").when(F.col("lang") == "de", "schedule").otherwise("other")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), 0)
    marks = docs.select(F.col("source").alias("doc_id"), F.inline(F.array(F.struct(F.concat(F.lit("Note "), (F.col("doc_id") % 50).cast("string")).alias("ref_code")), F.struct(F.try_element_at(words, F.lit(2)).alias("ref_code")))))
    text = F.concat("text", F.lit(" note "), (F.col("doc_id") % 60).cast("string"))
    path = F.when(F.col("doc_id") % 10 == 0, F.slice(words, 1, 3)).otherwise(F.array().cast("array<string>"))
    heading = F.when(F.col("doc_id") % 10 == 1, F.slice(words, 4, 2)).otherwise(F.array().cast("array<string>"))
    sections = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("section"), kind.alias("section_type"), path.alias("section_path"), heading.alias("headings"), text.alias("content_markdown"))
    found = resolve.resolved(marks, sections)
    return found.select("doc_id", "ref_code", "section", F.col("strategy").cast("long").alias("strategy"), F.md5("resolved_text").alias("text_md5"))


QUERIES = {f.__name__: f for f in (heading_tree, heading_subtrees, page_references)}

_HEADINGS = r"""
    WITH a AS (SELECT page_id, unnest(h) AS h, unnest(range(len(h))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS h FROM pages)),
    x AS (SELECT page_id % 3 AS doc_id, page_id * 1000 + pos AS pos, least(6, regexp_extract(h, '(?i)^<h([1-6])', 1)::BIGINT + (page_id % 3 = 0)::BIGINT + pos % 4) AS level FROM a),
    y AS (SELECT x.*, (SELECT max(p.pos) FROM x p WHERE p.doc_id = x.doc_id AND p.pos < x.pos AND p.level < x.level) AS parent,
          (SELECT min(p.pos) FROM x p WHERE p.doc_id = x.doc_id AND p.pos > x.pos AND p.level <= x.level) AS "end" FROM x)"""

ORACLE_SQL = {
    "heading_tree": f"""{_HEADINGS.replace("WITH", "WITH RECURSIVE", 1)},
    r AS (SELECT doc_id, pos, parent AS up, 0::BIGINT AS depth FROM y UNION ALL SELECT r.doc_id, r.pos, y.parent, r.depth + 1 FROM r JOIN y ON y.doc_id = r.doc_id AND y.pos = r.up)
    SELECT doc_id, pos, level, parent, (SELECT max(depth) FROM r WHERE r.doc_id = y.doc_id AND r.pos = y.pos) AS depth, "end" FROM y""",
    "heading_subtrees": f"""{_HEADINGS}
    SELECT a.doc_id, a.pos AS top, count(*) AS n FROM y a JOIN y b ON b.doc_id = a.doc_id AND b.pos >= a.pos AND (a."end" IS NULL OR b.pos < a."end") WHERE a.level <= 3 GROUP BY ALL""",
    "page_references": r"""
    WITH w AS (SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
    c AS (SELECT source AS doc_id, unnest(['Note ' || doc_id % 50, w[2]]) AS ref_code FROM w),
    k AS (SELECT DISTINCT doc_id, ref_code FROM c WHERE ref_code IS NOT NULL),
    s AS (SELECT source AS doc_id, doc_id AS section, CASE lang WHEN 'en' THEN 'note_to_accounts' WHEN 'de' THEN 'schedule' ELSE 'other' END AS kind, CASE WHEN doc_id % 10 = 0 THEN w[1:3] ELSE [] END AS path,
          CASE WHEN doc_id % 10 = 1 THEN w[4:5] ELSE [] END AS headings, text || ' note ' || doc_id % 60 AS text FROM w),
    h AS (SELECT k.doc_id, ref_code, section, text, CASE WHEN len(list_filter(path, lambda p: contains(p, lower(ref_code)))) > 0 THEN 1 WHEN len(list_filter(headings, lambda p: contains(p, lower(ref_code)))) > 0 THEN 2
          WHEN kind = 'note_to_accounts' AND regexp_matches(lower(ref_code), '^note\s+\d+') AND contains(lower(text), 'note ' || regexp_extract(ref_code, '\d+')) THEN 3 END AS strategy FROM k JOIN s ON s.doc_id = k.doc_id)
    SELECT doc_id, ref_code, section, strategy::BIGINT AS strategy, md5(trim(CASE WHEN len(text) > 500 THEN left(text, 500) || '...' ELSE text END)) AS text_md5 FROM h WHERE strategy IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY doc_id, ref_code ORDER BY strategy, section) = 1""",
}
