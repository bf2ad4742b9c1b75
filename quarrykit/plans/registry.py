"""Registry of driver queries, and the stand-in tables they read.

The engine's tables are played by the generic test tables: documents are
notices (language as organization), labels their tags, orders dated notices,
events a ledger.  Derived columns (dates from ids) are the same in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEYWORDS = ["apache", "thanon", "licensed", "ción", "ung", "eau", "der", "worthless", "token"]
AS_OF = "2026-04-01"


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")), "yyyy-MM-dd")
    end = F.date_format(F.date_add(F.lit("2026-02-01").cast("date"), (F.col("doc_id") % 120).cast("int")), "yyyy-MM-dd")
    return d.select(
        F.col("doc_id").alias("id"), "source", F.substring_index("text", "\n", 1).alias("title"), F.col("lang").alias("organization"), "text",
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(day).alias("start_date"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(end).alias("end_date"),
        F.when(F.col("doc_id") % 3 == 0, "a, b,,c").when(F.col("doc_id") % 3 == 1, "a").otherwise("").alias("keywords"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 1, "review").otherwise("lost")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("notice_id"), tag.alias("tag"), (F.col("doc_id") % 150 + 1).alias("tagged_by"), F.when(F.col("doc_id") % 2 == 0, "old").otherwise("").alias("memo"))


NOTICES_SQL = """notices AS (SELECT doc_id AS id, source, string_split(text, chr(10))[1] AS title, lang AS organization, text,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE strftime(DATE '2026-01-01' + (doc_id % 90)::INT, '%Y-%m-%d') END AS start_date,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE strftime(DATE '2026-02-01' + (doc_id % 120)::INT, '%Y-%m-%d') END AS end_date,
  CASE doc_id % 3 WHEN 0 THEN 'a, b,,c' WHEN 1 THEN 'a' ELSE '' END AS keywords, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS n_keywords FROM documents),
tags AS (SELECT doc_id AS notice_id, CASE WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'review' ELSE 'lost' END AS tag, doc_id % 150 + 1 AS tagged_by, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE '' END AS memo FROM labels)"""
