"""List pages of configured sites: what to request, and notices from the pages that landed.

A site is a row of 21 settings (:data:`SITE`): selectors of rows, titles and dates, how
pages are asked for, how links are made.  Fetching is an ingest step's; its requests
come from :func:`requests` and the pages that it lands are read by :func:`scraped`, in
parallel and again after a failure.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import dates, keys, markup, text
from quarrykit.functions.batches import pieces

SITE = """name string, source_key string, list_url string, list_selector string, title_selector string, date_selector string, link_attr string, link_base string,
pagination string, encoding string, max_pages int, link_js_regex string, link_template string, post_data map<string,string>, page_param_key string, parser string,
offset_size int, session_init_url string, grid_selector string, post_json boolean, skip_no_date boolean"""
# What a site has where it says nothing.
DEFAULTS = {
    "list_selector": "table tbody tr", "title_selector": "td.title a, td a", "date_selector": "td.date, td:last-child", "link_attr": "href", "link_base": "", "pagination": "", "encoding": "utf-8",
    "max_pages": 3, "link_js_regex": "", "link_template": "", "page_param_key": "", "parser": "html.parser", "offset_size": 0, "session_init_url": "", "grid_selector": "", "post_json": False, "skip_no_date": True,
}


def configs(spark: SparkSession, path: str) -> DataFrame:
    """Sites from JSON arrays, absent settings as defaults."""
    return with_defaults(spark.read.schema(SITE).option("multiLine", True).json(path))


def with_defaults(sites: DataFrame) -> DataFrame:
    """Sites with all settings; the source key is the name where it is absent, and pages are asked for by POST where post_data is there, empty or not."""
    missing = [f.split() for f in re.split(r",\s*(?![^<]*>)", SITE.replace("\n", " ")) if f.split()[0] not in sites.columns]
    rows = sites.withColumns({name: F.lit(None).cast(kind) for name, kind in missing})
    return rows.fillna(DEFAULTS).withColumn("source_key", F.coalesce("source_key", "name")).where("source_key is not null")


def requests(sites: DataFrame) -> DataFrame:
    """source_key, page, method, url, body and content_type of every list page, with the page that sets cookies first and the encoding to read by."""
    post = F.col("post_data").isNotNull()
    paged = post | (F.col("pagination") != "")
    rows = sites.select("*", F.explode(F.sequence(F.lit(1), F.when(paged, F.greatest("max_pages", F.lit(1))).otherwise(F.lit(1)))).alias("page"))
    number = F.when(F.col("offset_size") > 0, (F.col("page") - 1) * F.col("offset_size")).otherwise(F.col("page")).cast("string")
    more = F.replace(F.replace("pagination", F.lit("{page}"), number), F.lit("{offset}"), number)
    form = F.when(F.col("page_param_key") != "", F.map_concat(F.map_filter("post_data", lambda k, v: k != F.col("page_param_key")), F.create_map("page_param_key", F.col("page").cast("string")))).otherwise(F.col("post_data"))
    fields = F.array_sort(F.map_entries(form))
    encoded = F.array_join(F.transform(fields, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")
    return rows.select(
        "source_key", "page", F.when(post, "POST").otherwise("GET").alias("method"), F.when(post | (F.col("page") == 1), F.col("list_url")).otherwise(F.concat("list_url", more)).alias("url"),
        F.when(post & F.col("post_json"), F.to_json(F.map_from_entries(fields))).when(post, encoded).alias("body"),
        F.when(post & F.col("post_json"), "application/json;charset=UTF-8").when(post, "application/x-www-form-urlencoded").alias("content_type"),
        F.nullif("session_init_url", F.lit("")).alias("session_init_url"), "encoding",
    )


_ROW = "source_key string, page long, n int, title string, link string, day string, failure string"


def _link(value: str, pattern: str, template: str) -> str:
    """A script link's groups in the site's template ({id} is the first); the link itself where it does not match."""
    found = re.search(pattern, value) if pattern and template and value else None
    if found is None:
        return value
    out = template.replace("{id}", found[1])
    for i, group in enumerate(found.groups(), 1):
        out = out.replace(f"{{{i}}}", group or "")
    return out


def _listed(site: dict, page: str) -> list[tuple[str, str, str]]:
    """(title, link, text of the date) of each row, the title empty where the row has none."""
    root = markup.parsed(page)
    if site["grid_selector"]:
        root = markup.select_one(root, site["grid_selector"]) or root
    out = []
    for row in markup.select(root, site["list_selector"]):
        title = markup.select_one(row, site["title_selector"])
        day = markup.select_one(row, site["date_selector"])
        link = _link(title.attrs.get(site["link_attr"], ""), site["link_js_regex"], site["link_template"]) if title is not None else ""
        out.append(("".join(title.strings()) if title is not None else "", link, "".join(day.strings()) if day is not None else ""))
    return out


def rows_of(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of landed pages (source_key, page, html); a page without rows has one with n -1, a page or site that fails one with its failure."""
    needed = ["list_selector", "title_selector", "date_selector", "link_attr", "grid_selector", "link_js_regex", "link_template"]
    joined = pages.select("source_key", F.col("page").cast("long").alias("page"), "html").join(sites.select("source_key", *needed), "source_key")

    kinds = pa.schema([("source_key", pa.string()), ("page", pa.int64()), ("n", pa.int32()), ("title", pa.string()), ("link", pa.string()), ("day", pa.string()), ("failure", pa.string())])

    def scrape(batches):
        for part in pieces(batches):
            out = []
            for r in part.to_pylist():
                try:
                    rows = _listed(r, r["html"] if isinstance(r["html"], str) else "")
                    out += [(r["source_key"], r["page"], n, *row, None) for n, row in enumerate(rows)] or [(r["source_key"], r["page"], -1, "", "", "", None)]
                except (ValueError, re.error) as error:
                    out.append((r["source_key"], r["page"], -1, "", "", "", f"{type(error).__name__}: {error}"))
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kind.type) for i, kind in enumerate(kinds)], schema=kinds)

    return joined.mapInArrow(scrape, _ROW)


def scraped(pages: DataFrame, sites: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Notices of landed pages (source_key, page, html and, where known, status).

    As a visitor turns pages: a site's pages count up to the first that failed, has no
    rows or has a row older than days (that page's newer rows still count).  Rows
    without a title go, those without a date where the site says so, else they are
    dated as_of.  The id is a hash of title and link; the first row of an id stays.
    """
    ok = F.col("status") == 200 if "status" in pages.columns else F.lit(True)
    rows = rows_of(pages.where(ok), sites)
    failed = pages.where(~ok).select("source_key", F.col("page").cast("long").alias("_stop"))
    own = sites.select("source_key", "name", "list_url", "link_base", "skip_no_date")
    rows = rows.join(own, "source_key").withColumn("start_date", dates.find_date(F.col("day")))
    rows = rows.withColumn("_day", dates.as_date(F.col("start_date"))).withColumn("_old", F.coalesce(F.col("_day") < F.date_sub(as_of.cast("date"), days), F.lit(False)))
    titled = F.col("title") != ""
    ends = rows.groupBy("source_key").agg(F.min(F.when(F.col("n") < 0, F.col("page"))).alias("_empty"), F.min(F.when(F.col("_old") & titled, F.col("page") + 1)).alias("_past"))
    ends = ends.join(failed.groupBy("source_key").agg(F.min("_stop").alias("_stop")), "source_key", "left")
    stop = F.least("_empty", "_past", "_stop")
    rows = rows.join(ends, "source_key").where((F.col("page") < stop) | stop.isNull()).where(titled & ~F.col("_old") & (F.col("start_date").isNotNull() | ~F.col("skip_no_date")))
    absolute = text.absolute_url(F.coalesce(F.nullif("link_base", F.lit("")), F.col("list_url")), F.col("link"))
    url = F.when((F.col("link") == "") | F.startswith("link", F.lit("http")) | F.startswith("link", F.lit("javascript:")), F.col("link")).otherwise(absolute)
    rows = rows.withColumn("url", url).withColumn("bid_no", F.concat(F.lit("SCR-"), "source_key", F.lit("-"), keys.content_id(F.col("title"), F.col("url"))))
    rows = rows.withColumn("start_date", F.coalesce("start_date", F.date_format(as_of.cast("date"), "yyyy-MM-dd")))
    first = rows.groupBy("source_key", "bid_no").agg(F.min_by(F.struct("name", "page", "n", "title", "url", "start_date"), F.struct("page", "n")).alias("r"))
    return first.select(F.col("r.name").alias("source"), "source_key", "bid_no", "r.page", "r.title", F.col("r.name").alias("organization"), "r.start_date", dates.status(F.lit(""), as_of).alias("status"), "r.url")
