"""Landed feeds: JSON, XML and HTML payloads as notice rows.

Payloads are fetched by an ingest step and land as files; reading them is a
Spark scan, so a large backlog is read in parallel and again after a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import dates, keys, text

STANDARD = ("source", "title", "organization", "category", "bid_no", "start_date", "end_date", "status", "url", "content")


def json_items(spark: SparkSession, path: str, items: str, item: str) -> DataFrame:
    """One row an item; items is the path of the array (a.b.c), item the DDL of an element."""
    ddl = f"array<struct<{item}>>"
    for name in reversed(items.split(".")):
        ddl = f"struct<{name}: {ddl}>"
    raw = spark.read.schema("value string").option("wholetext", True).text(path)
    parsed = raw.select(F.from_json("value", ddl).alias("j"))
    return parsed.select(F.explode(F.col(f"j.{items}")).alias("i")).select("i.*")


def xml_items(spark: SparkSession, path: str, item: str, tag: str = "item") -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(item).load(path)


def notices(items: DataFrame, source: str, columns: dict[str, Column], as_of: Column, keep_undated: bool = True, since_days: int | None = None) -> DataFrame:
    """Items as standard notices: dates normalised, status set, rows older than the cut-off dropped.

    keep_undated says what becomes of a start date that cannot be read.
    """
    rows = items.select(*[columns.get(c, F.lit("")).cast("string").alias(c) for c in STANDARD if c not in ("source", "status")], *[v.alias(k) for k, v in columns.items() if k not in STANDARD])
    rows = rows.withColumns({"source": F.lit(source), "start_date": dates.normalise_date(F.col("start_date")), "end_date": dates.normalise_date(F.col("end_date"))})
    rows = rows.withColumn("status", dates.status(F.col("end_date"), as_of)).where(F.trim(F.coalesce("title", F.lit(""))) != "")
    if since_days is None:
        return rows
    day = dates.as_date(F.col("start_date"))
    fresh = day >= F.date_sub(as_of.cast("date"), since_days)
    return rows.where(F.coalesce(fresh, F.lit(keep_undated)))


def zipped_files(names: Column, urls: Column) -> Column:
    """array<struct<name, url>>: files by position, generated names where there are too few."""
    pairs = F.arrays_zip(names.alias("name"), urls.alias("url"))
    named = F.transform(pairs, lambda p, i: F.struct(F.coalesce(F.nullif(p["name"], F.lit("")), F.concat(F.lit("file "), (i + 1).cast("string"))).alias("name"), p["url"].alias("url")))
    return F.filter(named, lambda p: F.coalesce(p["url"], F.lit("")) != "")


SITE = """name string, source_key string, list_url string, pagination string, max_pages int, encoding string, row_pattern string,
title_pattern string, link_pattern string, date_pattern string, link_base string, require_date boolean"""


def site_configs(spark: SparkSession, path: str) -> DataFrame:
    """Site configurations from one JSON array, absent keys as defaults."""
    rows = spark.read.schema(SITE).option("multiLine", True).json(path)
    return rows.fillna({"pagination": "", "max_pages": 1, "encoding": "utf-8", "link_base": "", "require_date": False}).where("source_key is not null")


def list_pages(sites: DataFrame) -> DataFrame:
    """source_key, page and url of every list page: {page} in pagination is its number; without it there is one page."""
    last = F.when(F.contains("pagination", F.lit("{page}")), F.greatest("max_pages", F.lit(1))).otherwise(F.lit(1))
    rows = sites.select("*", F.explode(F.sequence(F.lit(1), last)).alias("page"))
    return rows.select("source_key", "page", F.concat("list_url", F.replace("pagination", F.lit("{page}"), F.col("page").cast("string"))).alias("url"))


def html_list(pages: DataFrame, sites: DataFrame, as_of: Column) -> DataFrame:
    """List rows of landed HTML by site configuration.

    pages: source_key, page, html; sites: source_key, list_url, row_pattern (one
    group: a row), title_pattern, link_pattern, date_pattern (one group each),
    link_base, require_date.  Title tags are stripped, links made absolute, the
    id is a hash of both and the first row of an id wins.
    """
    rows = pages.join(F.broadcast(sites), "source_key").select("*", F.posexplode(F.expr("regexp_extract_all(html, row_pattern, 1)")).alias("n", "row"))
    get = lambda p: F.expr(f"regexp_extract(row, {p}, 1)")
    title = text.html_to_text(get("title_pattern"))
    link = text.absolute_url(F.coalesce(F.nullif("link_base", F.lit("")), F.col("list_url")), text.unescape(get("link_pattern")))
    day = dates.find_date(get("date_pattern"))
    rows = rows.withColumns({"title": title, "url": link, "start_date": F.coalesce(day, F.lit(""))}).where((F.col("title") != "") & (~F.col("require_date") | (F.col("start_date") != "")))
    rows = rows.withColumn("bid_no", keys.content_id(F.col("title"), F.col("url")))
    first = rows.groupBy("source_key", "bid_no").agg(F.min_by(F.struct("page", "n", "title", "url", "start_date"), F.struct("page", "n")).alias("r"))
    return first.select(F.col("source_key").alias("source"), "bid_no", "r.page", "r.title", "r.url", "r.start_date", dates.status(F.lit(""), as_of).alias("status"))


def files(spark: SparkSession, path: str, glob: str = "*.{pdf,hwpx,docx,hwp,zip}", least_bytes: int = 500) -> DataFrame:
    """Attachment files: path, name, length, content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return rows.where(F.col("length") > least_bytes).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def unpivoted_keywords(sheet: DataFrame) -> DataFrame:
    """A wide keyword sheet (a column a group) as rows; a blank header is named by its place."""
    named = [F.struct(F.lit(c if c.strip() and not c.startswith("_c") else f"group{i}").alias("keyword_group"), F.col(f"`{c}`").cast("string").alias("keyword")) for i, c in enumerate(sheet.columns, 1)]
    return sheet.select(F.inline(F.array(*named))).where(F.trim(F.coalesce("keyword", F.lit(""))) != "")


def key_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A settings table as one map."""
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))).alias("settings"))
