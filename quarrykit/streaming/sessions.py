"""Sessions that end by themselves: state by key with timers on event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

_OUT = StructType([StructField("key", StringType()), StructField("what", StringType()), StructField("at", LongType()), StructField("seen", LongType())])


class Sessions(StatefulProcessor):
    """Of each key when it ends and how often it was seen; a later sight puts the end off, a sign-out ends it at once."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", StructType([StructField("ends", LongType()), StructField("seen", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends, seen = self.state.get() if self.state.exists() else (None, 0)
        pdf = pd.concat(list(rows)).sort_values("at_ms")
        out = []
        for at, signed_out in zip(pdf["at_ms"].tolist(), pdf["signed_out"].tolist()):
            if ends is not None and at >= ends:  # ended before this row came
                out.append((key[0], "expired", ends, seen))
                ends, seen = None, 0
            if signed_out:
                if ends is not None:
                    out.append((key[0], "signed out", at, seen))
                ends, seen = None, 0
            else:
                ends, seen = max(at + self.ttl, ends or 0), seen + 1
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if ends is None:
            self.state.clear()
        else:
            self.state.update((ends, seen))
            self.handle.registerTimer(ends)
        yield pd.DataFrame(out, columns=["key", "what", "at", "seen"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            ends, seen = self.state.get()
            self.state.clear()
            yield pd.DataFrame([(key[0], "expired", ends, seen)], columns=["key", "what", "at", "seen"])

    def close(self) -> None:
        pass


def ended(rows: DataFrame, key: str, at: str, ttl_seconds: int, late: str, signed_out=None) -> DataFrame:
    """A row for each session of a stream as it ends: key, what (expired or signed out), at and how often it was seen.

    Expiry is by event time: a session ends once the watermark has passed its end, so
    all rows that may still put it off have come. State lives in the RocksDB store.
    """
    sign = F.lit(False) if signed_out is None else F.coalesce(signed_out, F.lit(False))
    stream = rows.withColumns({"at_ms": F.unix_millis(F.col(at).cast("timestamp_ltz")), "signed_out": sign}).withWatermark(at, late)
    stream = stream.select(F.col(key).cast("string").alias("key"), F.col(at), "at_ms", "signed_out")
    out = stream.groupBy("key").transformWithStateInPandas(Sessions(ttl_seconds * 1000), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
    return out.withColumn("at", F.timestamp_millis("at"))
