"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.storage import discard, saved


def components(links: DataFrame) -> DataFrame:
    """id and component (least id reachable) of every id in links (a, b) that is not its own component.

    Alternating large-star and small-star rounds; a hub's links are aggregated
    and joined, never gathered in a group.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, edges = edges, saved(small.where("u <> v").distinct(), "links")
        discard(before)
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")


def _stars(edges: DataFrame) -> bool:
    """Each node has one smaller neighbour or is one, never both: components are read off."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.agg(F.max(F.col("up") + F.when(F.col("up") > 0, F.col("down")).otherwise(0))).first()[0] in (None, 0, 1)
