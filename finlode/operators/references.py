"""Cross-references in tables, their targets, and section trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a task joins and sorts at a time where tables are dealt into parts by their number of rows.
ROWS = 1 << 19

# Reference patterns in the order in which they are tried.
PATTERNS = (
    ("note_ref", r"(?i)note\s+\d+"),
    ("see_note", r"(?i)see\s+note\s+\d+"),
    ("refer_schedule", r"(?i)refer\s+schedule\s+(?:[IVXLCDM]+|[A-Z])"),
    ("schedule_ref", r"(?i)schedule\s+(?:[IVXLCDM]+|[A-Z])\b"),
    ("numeric_parens", r"\(\d{1,3}\)"),
    ("alpha_parens", r"\([a-z]\)"),
    ("asterisks", r"\*{1,3}(?!\*)"),
    ("hash_ref", r"#\d{1,3}\b"),
    ("as_per_note", r"(?i)as\s+per\s+note\s+\d+"),
)


def ref_code(raw: Column, pattern: Column) -> Column:
    """The canonical code: Note n, Schedule X, or the mark itself."""
    note = F.concat(F.lit("Note "), F.regexp_extract(raw, r"(\d+)", 1))
    schedule = F.concat(F.lit("Schedule "), F.upper(F.regexp_extract(raw, r"(?i)([IVXLCDM]+|[A-Z])\s*$", 1)))
    return F.when(pattern.isin("note_ref", "see_note", "as_per_note"), note).when(pattern.isin("refer_schedule", "schedule_ref"), schedule).otherwise(F.trim(raw))


def extracted(cells: DataFrame) -> DataFrame:
    """(table_id, ref_code, cell_pos): the first place of each code in a table, from (table_id, cell_pos, cell)."""
    tries = F.array(*(F.struct(F.lit(i).alias("p"), F.lit(n).alias("pattern"), F.regexp_extract_all("cell", F.lit(r), 0).alias("found")) for i, (n, r) in enumerate(PATTERNS)))
    rows = cells.select("table_id", "cell_pos", F.explode(tries).alias("t")).select("table_id", "cell_pos", "t.p", "t.pattern", F.posexplode("t.found").alias("m", "raw"))
    coded = rows.withColumn("ref_code", ref_code(F.col("raw"), F.col("pattern")))
    return coded.groupBy("table_id", "ref_code").agg(F.min(F.struct("cell_pos", "p", "m")).alias("at")).select("table_id", "ref_code", "at.cell_pos")


def parts_of(rows: DataFrame) -> int:
    """Into how many parts a table is dealt so that a task gets about ROWS of it, and no core is left out."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))


def looked_up(chunks: DataFrame, tables: DataFrame, links: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, ref_code, resolved_text): references of the tables in chunks' sections, each code of a document once.

    With ``partitions``, every step is dealt into so many parts: narrow rows are so well compressed that parts of equal
    bytes, as Spark makes them by itself, hold millions of rows for one task to sort.
    """
    dealt = lambda df, *by: df if partitions is None else df.repartition(partitions, *by)
    own = dealt(chunks.select("rank", "doc_id", "section"), "doc_id", "section").join(dealt(tables.select("doc_id", "section", "table_id"), "doc_id", "section"), ["doc_id", "section"])
    rows = dealt(own, "table_id").join(dealt(links, "table_id"), "table_id")
    first = F.row_number().over(Window.partitionBy("doc_id", "ref_code").orderBy("rank", "table_id"))
    return dealt(rows, "doc_id", "ref_code").withColumn("first", first).where("first = 1").select("doc_id", "ref_code", "resolved_text")


def of_codes(links: DataFrame, doc_id, codes: tuple[str, ...]) -> DataFrame:
    """A document's references (doc_id, ref_code, ...) with one of the codes."""
    return links.where((F.col("doc_id") == doc_id) & F.col("ref_code").isin(*codes))


def section_tree(sections: DataFrame) -> DataFrame:
    """(node_id, parent_id, title, depth, path): a root for each document and its sections below."""
    roots = sections.select("doc_id").distinct()
    top = roots.select(F.concat(F.col("doc_id").cast("string"), F.lit("/")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("title"), F.lit(0).alias("depth"))
    leaf = sections.select(
        F.concat_ws("/", F.col("doc_id").cast("string"), F.col("section").cast("string")).alias("node_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit("/")).alias("parent_id"),
        F.coalesce(F.try_element_at("headings", F.lit(1)), F.col("section_type")).alias("title"),
        F.lit(1).alias("depth"),
    )
    return top.unionByName(leaf)


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(id, depth, path) from (id, parent_id, title): paths of titles from the roots; nodes that no root reaches are left out."""
    spark: SparkSession = nodes.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE walk (id, depth, path) AS (
            SELECT id, 0, title FROM {nodes} WHERE parent_id IS NULL
            UNION ALL
            SELECT n.id, w.depth + 1, concat(w.path, ' > ', n.title) FROM {nodes} n JOIN walk w ON n.parent_id = w.id
        )
        SELECT id, depth, path FROM walk
        """,
        nodes=nodes,
    )


def tree_chunks(documents: DataFrame, nodes: DataFrame, section_types: tuple[str, ...]) -> DataFrame:
    """Nodes of the wanted types in the found documents as chunks of score 1."""
    return documents.join(nodes.where(F.col("section_type").isin(*section_types)), "doc_id").select("doc_id", "node_id", F.lit(1.0).alias("score"), F.lit("tree").alias("score_source"))


def without_documents(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Tables with a doc_id without the rows of deleted documents: a cascading delete as rewrites."""
    ids = gone.select("doc_id").distinct()
    return [t.join(ids, "doc_id", "left_anti") for t in tables]


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is missing: what a foreign key would refuse."""
    return children.where(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")
