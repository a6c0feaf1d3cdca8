"""Sources: files of reports, page extracts, feeds and series, read by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import feed_date, headline, parse_date


def report_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, file_hash, length): report files with the SHA-256 of their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("file_hash"), "length")


def page_number(name: Column, default: int = 1) -> Column:
    """A page's number by its file name: after page or p, else its first digits."""
    found = [F.nullif(F.regexp_extract(name, r, 1), F.lit("")).try_cast("int") for r in (r"(?i)(?:page|p)[_\- ]*(\d+)", r"(\d+)")]
    return F.coalesce(*found, F.lit(default))


def page_extracts(spark: SparkSession, path: str) -> DataFrame:
    """(folder, page_number, json, html, markdown): a job's files side by side by page, whichever kinds there are."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    file = F.col("_metadata.file_name")
    rows = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1).alias("folder"), page_number(file).alias("page_number"), F.lower(F.regexp_extract(file, r"\.([A-Za-z]+)$", 1)).alias("kind"), "value")
    kind = lambda *names: F.max(F.when(F.col("kind").isin(*names), F.col("value")))
    wide = rows.groupBy("folder", "page_number").agg(kind("json").alias("json"), kind("htm", "html").alias("html"), kind("md").alias("markdown"))
    return wide.where("json IS NOT NULL OR html IS NOT NULL OR markdown IS NOT NULL")


def absolute_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages of a batch as pages of the document: the batch's first page plus the page in it, less one."""
    return pages.join(ranges, ["id", "batch"]).withColumn("page_number", F.col("page_start") + F.col("page_number") - 1)


def flat_pages(raw: DataFrame) -> DataFrame:
    """(id, page_number, page variant): a page JSON's pages, whether a list, below pages, results or data, by number, or itself."""
    v = F.try_parse_json("json")
    listed = F.coalesce(v.try_cast("array<variant>"), *(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("pages", "results", "data")))
    numbered = F.map_entries(F.map_filter(v.try_cast("map<string,variant>"), lambda k, _: k.rlike(r"^\d+$")))
    by_number = F.transform(numbered, lambda e: F.struct(e["key"].cast("int").alias("page_number"), e["value"].alias("page")))
    by_place = F.transform(listed, lambda p, i: F.struct((i + 1).alias("page_number"), p.alias("page")))
    single = F.array(F.struct(F.lit(1).alias("page_number"), v.alias("page")))
    pages = F.when(listed.isNotNull(), by_place).when(F.size(by_number) > 0, by_number).otherwise(single)
    return raw.where(v.isNotNull()).select("id", F.explode(pages).alias("x")).select("id", "x.page_number", "x.page")


def feed_items(feeds: DataFrame) -> DataFrame:
    """(feed, pos, headline, source, link, published) from (feed, url, xml): the items of RSS documents, in order.

    A title's part after the last dash is the source; without one, the feed's host is.
    """
    item = r"(?s)<item[\s>].*?</item>"
    rows = feeds.select("feed", "url", F.posexplode(F.regexp_extract_all("xml", F.lit(item), 0)).alias("pos", "item"))
    text = lambda tag: F.nullif(F.trim(F.xpath_string("item", F.lit(f"item/{tag}"))), F.lit(""))
    # a generator, so that each text of an item is read once, however often it is used after
    rows = rows.select("feed", "url", "pos", F.inline(F.array(F.struct(text("title").alias("title"), text("link").alias("link"), text("pubDate").alias("day")))))
    parts = headline(F.col("title"))
    return rows.select("feed", "pos", parts[0].alias("headline"), F.coalesce(parts[1], F.parse_url("url", F.lit("HOST"))).alias("source"), "link", feed_date(F.col("day")).alias("published"))


def announcements(raw: DataFrame) -> DataFrame:
    """(id, pos, text, at) from (id, json): a list, or one below announcements or data."""
    v = F.try_parse_json("json")
    rows = F.coalesce(v.try_cast("array<variant>"), F.try_variant_get(v, "$.announcements", "array<variant>"), F.try_variant_get(v, "$.data", "array<variant>"))
    flat = raw.select("id", F.posexplode(rows).alias("pos", "x"))
    get = lambda k: F.try_variant_get("x", f"$.{k}", "string")
    return flat.select("id", "pos", F.coalesce(get("desc"), get("subject"), get("text")).alias("text"), parse_date(F.coalesce(get("an_dt"), get("date"))).alias("at"))


def macro_series(raw: DataFrame) -> DataFrame:
    """(indicator, period, value) from (indicator, json), where the JSON is a pair of a header and rows."""
    rows = F.try_variant_get(F.try_parse_json("json"), "$[1]", "array<variant>")
    flat = raw.select("indicator", F.explode(rows).alias("x"))
    return flat.select("indicator", F.try_variant_get("x", "$.date", "string").alias("period"), F.try_variant_get("x", "$.value", "double").alias("value"))


def ratio_rows(raw: DataFrame) -> DataFrame:
    """(ticker, pos, ratios map) from (ticker, json): one map of ratios for each period, newest first as delivered."""
    rows = F.try_parse_json("json").try_cast("array<variant>")
    return raw.select("ticker", F.posexplode(rows).alias("pos", "x")).select("ticker", "pos", F.col("x").try_cast("map<string,string>").alias("ratios"))
