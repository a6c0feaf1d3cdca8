"""Tables of the engine: their schemas, and sinks that append, upsert by key, or rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "id string, company_id string, report_type string, fiscal_year int, fiscal_quarter string, file_hash string, file_name string, total_pages int, ingestion_status string, error_message string, created_at timestamp, updated_at timestamp",
    "sections": "id string, document_id string, section_type string, section_path array<string>, content_markdown string, content_json string, contextual_summary string, page_start int, page_end int, content_type string",
    "tables": "id string, section_id string, table_markdown string, table_json string, table_html string, footnote_refs array<string>, contextual_summary string, table_index int",
    "chunks": "id string, section_id string, chunk_text string, metadata_prefix string, chunk_index int, metadata struct<document_id:string,section_id:string,company_id:string,report_type:string,fiscal_year:int,fiscal_quarter:string,section_type:string,content_type:string>, embedding array<float>",
    "ref_links": "id string, document_id string, ref_code string, source_table_id string, target_section_id string, resolved_text string",
    "nodes": "id string, document_id string, section_id string, node_title string, parent_id string, node_path array<string>, node_depth int, tree_json string",
    "router_log": "query_text string, assigned_tier string, confidence int, fallback_applied boolean, fallback_reason string, company_id string, fiscal_year int, section_types array<string>, explanation string, routing_error string, created_at timestamp",
    "reports": "id string, ticker string, company_name string, sector string, industry string, investment_verdict string, confidence_level string, report_markdown string, shared_state_json string, created_at timestamp",
    "sessions": "id string, ticker string, company_name string, has_dashboard boolean, shared_state_json string, last_query string, analysis_report_id string, created_at timestamp, updated_at timestamp",
}


def initialised(spark: SparkSession, root: str) -> None:
    """Empty tables for those that are not there yet; running it again changes nothing."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def opened(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def appended(rows: DataFrame, root: str, name: str) -> None:
    """Appends rows in the table's own columns; missing ones are null."""
    columns = opened(rows.sparkSession, root, name).schema
    rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns)).write.mode("append").parquet(f"{root}/{name}")


def latest(rows: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """The last version of each key of a table that upserts append to."""
    order = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("its place", F.row_number().over(order)).where("`its place` = 1").drop("its place")


def newest(rows: DataFrame, n: int, at: str = "created_at", key: str = "id") -> DataFrame:
    """The n newest rows, ties by key."""
    return rows.orderBy(F.desc(at), key).limit(n)


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose hash is not known yet, one of each hash; failed documents do not block another try."""
    done = known.where("ingestion_status != 'failed'").select("file_hash")
    return files.dropDuplicates(["file_hash"]).join(done, "file_hash", "left_anti")
