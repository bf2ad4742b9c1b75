"""Streaming forms of collection: late rows dropped, re-deliveries merged, counts by window."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrykit.operators import merge
from quarrykit.tables import Table


def distinct_within(rows: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """First delivery of a key; state is dropped once the watermark has passed it."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, at: str, keys: list[str], size: str, late: str | None = None) -> DataFrame:
    """Rows and sums by tumbling window and key, on a stream or a table."""
    rows = rows.withWatermark(at, late) if late else rows
    out = rows.groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def upsert_stream(rows: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keep a current-state table: each micro-batch's last row of a key is merged in.

    A batch that runs again after a failure merges to the same state.
    """

    def merge_batch(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        changes = merge.latest(batch, keys, order)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            changes = merge.upsert(spark.read.parquet(path), changes, keys).drop("_action")
        merge.replace_table(changes, path)

    return rows.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def commit_stream(rows: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """As upsert_stream into a :class:`quarrykit.tables.Table`: a micro-batch rewrites the partitions that it touches.

    A batch that runs again after a failure is known by its mark and commits nothing.
    """
    mark = hashlib.md5(checkpoint.encode()).hexdigest()

    def merge_batch(batch: DataFrame, number: int) -> None:
        Table(batch.sparkSession, path, keys, buckets).upsert(batch, f"{mark}-{number}", order)

    return rows.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
