"""Search, paging, statistics and purge over notices joined with user tags.

A notice table has at least id, source, title, organization, keywords, status,
start_date and end_date (yyyy-MM-dd text, '' for missing); a tag table notice_id
(unique), tag, tagged_by, memo, updated_at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import dates, text

EXCLUDED = "excluded"


def contains_any(needle: str, columns: list[str]) -> Column:
    """Case-insensitive LIKE %needle% on any column; % and _ in the needle stay wildcards."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{needle}%") for c in columns])


def predicate(q: str = "", source: str = "all", status: str = "all", window_days: int | None = None, as_of: Column | None = None, columns: tuple[str, ...] = ("title", "organization", "keywords")) -> Column:
    """Conjunction of the filters that are set; 'all' and '' switch one off."""
    parts = [F.lit(True)]
    if status != "all":
        parts.append(F.col("status") == status)
    if source != "all":
        parts.append(F.col("source") == source)
    if window_days is not None:
        parts.append(dates.in_last_days(F.col("start_date"), as_of, window_days))
    if q:
        parts.append(contains_any(q, list(columns)))
    return reduce(lambda a, b: a & b, parts)


def not_tagged(notices: DataFrame, tags: DataFrame, tag: str | None = EXCLUDED) -> DataFrame:
    """Notices without that tag (None: without any)."""
    own = tags if tag is None else tags.where(F.col("tag") == tag)
    return notices.join(own.select(F.col("notice_id").alias("id")), "id", "left_anti")


def order_by_deadline() -> list[Column]:
    blank = F.when(F.coalesce("end_date", F.lit("")) == "", 1).otherwise(0)
    return [blank, F.col("end_date").asc(), text.list_length(F.col("keywords")).desc(), F.col("id")]


def order_by_latest() -> list[Column]:
    blank = F.when(F.coalesce("start_date", F.lit("")) == "", 1).otherwise(0)
    return [blank, F.col("start_date").desc(), text.list_length(F.col("keywords")).desc(), F.col("id")]


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page: a top-k per task, never a global sort."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("pages"))


def search(notices: DataFrame, tags: DataFrame, number: int = 1, size: int = 20, sort: str = "latest", **filters) -> DataFrame:
    rows = not_tagged(notices.where(predicate(**filters)), tags)
    return page(rows, order_by_deadline() if sort == "deadline" else order_by_latest(), number, size)


def tagged(notices: DataFrame, tags: DataFrame, users: DataFrame, tag: str | None = None) -> DataFrame:
    """Tagged notices with who tagged them (kept where the user is gone)."""
    own = tags if tag is None else tags.where(F.col("tag") == tag)
    named = users.select(F.col("id").alias("tagged_by"), F.col("name").alias("tagged_by_name"))
    return notices.join(own, notices["id"] == own["notice_id"]).join(named, "tagged_by", "left")


def detail(notices: DataFrame, tags: DataFrame, fetched: DataFrame) -> DataFrame:
    """Notices with their tag, blank fields filled from a detail fetch (id, content, target)."""
    more = fetched.select("id", F.col("content").alias("_content"), F.col("target").alias("_target"))
    out = notices.join(tags.select(F.col("notice_id").alias("id"), "tag", "memo"), "id", "left").join(more, "id", "left")
    return out.withColumns({"content": text.first_filled(F.col("content"), F.col("_content")), "target": text.first_filled(F.col("target"), F.col("_target"))}).drop("_content", "_target")


def source_counts(notices: DataFrame, tags: DataFrame) -> DataFrame:
    return not_tagged(notices, tags).groupBy("source").agg(F.count("*").alias("count"))


def status_stats(notices: DataFrame) -> DataFrame:
    """Per source: rows, ongoing, closed, latest collection."""
    return notices.groupBy("source").agg(F.count("*").alias("count"), F.count_if(F.col("status") == "ongoing").alias("ongoing"), F.count_if(F.col("status") == "closed").alias("closed"), F.max("collected_at").alias("last_collected"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("count"))


def purge(notices: DataFrame, tags: DataFrame, before: str) -> tuple[DataFrame, DataFrame]:
    """What stays and what goes when untagged notices that end before a day are deleted."""
    old = (F.coalesce("end_date", F.lit("")) != "") & (F.col("end_date") < before)
    untagged = tags.select(F.col("notice_id").alias("id"))
    gone = notices.where(old).join(untagged, "id", "left_anti")
    keep = notices.where(~old).unionByName(notices.where(old).join(untagged, "id", "left_semi"))
    return keep, gone


def interested(notices: DataFrame, classes: DataFrame) -> DataFrame:
    """Notices whose procurement class's last part is a class of interest.

    A blank class passes; a class without '>' has a blank last part and fails; an
    empty list of interests passes all.
    """
    mid = text.last_of_path(F.col("procure_class"))
    wanted = classes.select(F.col("mid_class").alias("_mid")).distinct()
    some = wanted.agg((F.count("*") > 0).alias("_some"), F.lit(1).alias("_one"))
    rows = notices.withColumn("_mid", mid).join(wanted.withColumn("_hit", F.lit(True)), "_mid", "left").withColumn("_one", F.lit(1)).join(F.broadcast(some), "_one")
    return rows.where((F.coalesce("procure_class", F.lit("")) == "") | F.col("_hit") | ~F.col("_some")).drop("_mid", "_hit", "_some", "_one")


def with_default_url(sources: DataFrame, urls: DataFrame) -> DataFrame:
    """Sources with the URL of their name, '' where none is known."""
    return sources.join(urls.select("name", F.col("url").alias("_url")), "name", "left").withColumn("url", F.coalesce("_url", F.lit(""))).drop("_url")


def permitted(users: DataFrame, flag: str) -> DataFrame:
    return users.where((F.col("role") == "admin") | (F.col(flag) == 1))


def sessions(session: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    return session.where(F.col("expires_at") > as_of).join(users, session["user_id"] == users["id"])


def fetch_wanted(notices: DataFrame, tags: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Notices whose attachments are to be fetched: a wanted tag, none stored yet, an address known."""
    has_none = F.coalesce("attachments", F.lit("")).isin("", "[]")
    rows = notices.join(tags.where(F.col("tag").isin(*wanted)).select(F.col("notice_id").alias("id")), "id", "left_semi")
    return rows.where(has_none & (F.coalesce("url", F.lit("")) != ""))


def page_numbers(current: int | Column, last: int | Column, around: int = 4) -> Column:
    current, last = F.lit(current), F.lit(last)
    return F.sequence(F.greatest(F.lit(1), current - around), F.least(last, current + around))
