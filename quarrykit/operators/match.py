"""Keyword matching.

A keyword list is small reference data; it goes into the plan as one array and
every text is tested against it in place.  A list beyond ``MOST_KEYWORDS`` is
instead joined by its keywords' first letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_KEYWORDS = 2000


def active_keywords(keywords: DataFrame, source_id: int | None = None) -> DataFrame:
    """Distinct active keywords: common ones and, where given, the source's own."""
    own = F.col("source_id").isNull()
    if source_id is not None:
        own = own | (F.col("source_id") == source_id)
    return keywords.where((F.col("is_active") == 1) & own).select("keyword").distinct()


def hits(text: Column, keywords: list[str]) -> Column:
    """Keywords (in list order) that lower-cased text contains."""
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(text), F.lower(k)))


def matched(rows: DataFrame, text: Column, keywords: DataFrame) -> DataFrame:
    """Rows with at least one keyword, with the hits in keywords and their number in n_keywords."""
    listed = [r[0] for r in keywords.select("keyword").where("keyword <> ''").distinct().orderBy("keyword").limit(MOST_KEYWORDS + 1).collect()]
    if len(listed) > MOST_KEYWORDS:
        return _joined(rows, text, keywords)
    if not listed:
        return rows.withColumn("keywords", F.lit("")).withColumn("n_keywords", F.lit(0)).where(F.lit(False))
    return rows.withColumn("_hits", hits(text, listed)).where(F.size("_hits") > 0).withColumns({"keywords": F.array_join("_hits", ","), "n_keywords": F.size("_hits")}).drop("_hits")


def _joined(rows: DataFrame, text: Column, keywords: DataFrame, gram: int = 3) -> DataFrame:
    """Long lists: an equi-join on the keywords' first letters (all of a shorter one's), then the containment test.

    Only a hash of the text travels with its grams; rows of one text share their candidates.
    """
    rows = rows.withColumn("_text", F.lower(text)).withColumn("_key", F.sha2("_text", 256))
    at = F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1)))
    of = lambda n: F.transform(at, lambda i: F.substring(F.col("_text"), i, F.lit(n)))
    grams = F.array_distinct(F.concat(*[of(n) for n in range(1, gram + 1)]))
    words = keywords.select("keyword").where("keyword <> ''").distinct().withColumn("_gram", F.substring(F.lower("keyword"), 1, gram))
    cells = rows.select("_key", F.explode(grams).alias("_gram"))
    candidates = cells.join(words, "_gram").select("_key", "keyword").distinct().groupBy("_key").agg(F.collect_list("keyword").alias("_words"))
    hit = F.array_sort(F.filter("_words", lambda k: F.contains(F.col("_text"), F.lower(k))))
    found = rows.join(candidates, "_key").withColumn("_hits", hit).where(F.size("_hits") > 0)
    return found.withColumns({"keywords": F.array_join("_hits", ","), "n_keywords": F.size("_hits")}).drop("_key", "_text", "_words", "_hits")


def pairs(rows: DataFrame, key: str, text: Column, keywords: list[str]) -> DataFrame:
    """key and keyword of every hit (the theta join, as an exploded array)."""
    return rows.select(key, F.explode(hits(text, keywords)).alias("keyword"))


def without_contained(keywords: DataFrame) -> DataFrame:
    """Keywords that contain no other keyword of the list (those find all that they find)."""
    k = keywords.select("keyword").where("keyword <> ''").distinct()
    parts = k.select("keyword", F.explode(_substrings(F.col("keyword"))).alias("part"))
    longer = parts.join(k.select(F.col("keyword").alias("part")), "part").select("keyword").distinct()
    return k.join(longer, "keyword", "left_anti")


def _substrings(word: Column) -> Column:
    """All proper substrings of a (short) word."""
    n = F.length(word)
    at = lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda size: F.substring(word, i, size))
    return F.filter(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), at))), lambda s: s != word)


def merged_by_key(rows: DataFrame, key: str, order: str, keywords: str) -> DataFrame:
    """One row a key: the first by order gives all columns, keywords are the sorted union."""
    rest = [c for c in rows.columns if c not in (key, keywords)]
    first = F.min_by(F.struct(*rest), F.col(order))
    return rows.groupBy(key).agg(first.alias("_first"), F.array_join(F.array_sort(F.collect_set(keywords)), ",").alias(keywords)).select(key, "_first.*", keywords)
