"""Small functions of the engine over whole tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import sentence_trim, summary
from ..operators import search
from ..sources.readers import page_number
from .retrieval import table


def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that every turn has as a question: what blanks part, if it is all letters or digits."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.md5(F.array_join(search.query_terms(F.col("text")), " ")).alias("terms_md5"))


def sentence_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its last 20 characters, cut at a sentence end in its second half."""
    text = F.expr("substring(text, 1, greatest(length(text) - 20, 0))")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(sentence_trim(text)).alias("text_md5"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in for a summary of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", summary(F.col("text")).alias("summary"))


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers of files named after orders in five ways."""
    k = F.col("o_orderkey").cast("string")
    names = F.array(F.concat(F.lit("Page_"), k, F.lit("_7.json")), F.concat(F.lit("x9 p-"), k, F.lit(".html")), F.concat(F.lit("0"), k, F.lit(".md")), F.lit("none.json"), F.concat(F.lit("scan "), k, F.lit("-3.htm")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("name")).select("o_orderkey", page_number(F.col("name")).cast("long").alias("page_number"))


QUERIES = {f.__name__: f for f in (question_terms, sentence_trims, summaries, page_numbers)}

ORACLE_SQL = {
    "question_terms": r"""
        SELECT conv_id, turn, md5(array_to_string(list_reduce(list_prepend([], list_transform(list_filter(string_split(lower(text), ' '), lambda x: regexp_full_match(x, '[\p{L}\p{N}]+')), lambda x: [x])),
               lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE a || x END), ' ')) AS terms_md5 FROM conversations""",
    "sentence_trims": r"""
        WITH t AS (SELECT doc_id, left(text, greatest(length(text) - 20, 0)) AS t FROM documents), h AS (SELECT *, regexp_extract(t, '(?s)^(.*[.!?\n])(?:[ \n\t].*)?$', 1) AS h FROM t)
        SELECT doc_id, md5(CASE WHEN length(h) - 1 > length(t) // 2 THEN h ELSE t END) AS text_md5 FROM h""",
    "summaries": "SELECT doc_id, trim(left(text, 200)) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS summary FROM documents",
    "page_numbers": r"""
        SELECT o_orderkey, coalesce(try_cast(nullif(regexp_extract(name, '(?i)(?:page|p)[_\- ]*(\d+)', 1), '') AS INTEGER), try_cast(nullif(regexp_extract(name, '(\d+)', 1), '') AS INTEGER), 1)::BIGINT AS page_number FROM (
            SELECT o_orderkey, ['Page_' || o_orderkey || '_7.json', 'x9 p-' || o_orderkey || '.html', '0' || o_orderkey || '.md', 'none.json', 'scan ' || o_orderkey || '-3.htm'][o_orderkey % 5 + 1] AS name FROM orders)""",
}
