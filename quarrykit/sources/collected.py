"""Collectors as a stream: what each source has published since it was last asked.

An offset is the marker of every source: the day up to which it has been asked.  A
micro-batch asks each source from its marker less a look-back to the latest day, one
partition for each source and stretch of days; Spark stores the offsets before it reads
and again as committed, so a run that stops half-way asks for the same days again.
Rows that come again, by that or by the look-back, are for an upsert to merge
(:func:`quarrykit.streaming.feeds.commit_stream`).

``fetch(source, lo, hi)`` and ``clock()`` (the latest day) are importable callables, named
as ``module:function``.  A source that fails has one row with its error and holds up no
other; the look-back of the batches after it asks for its days again.
"""

from __future__ import annotations

import importlib
import json
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def named(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class Days(InputPartition):
    def __init__(self, source: str, lo: str, hi: str):
        super().__init__((source, lo, hi))
        self.source, self.lo, self.hi = source, lo, hi


class CollectedSource(DataSource):
    """Options: fetch, clock, sources (JSON list of names), start (yyyy-MM-dd), lookback (days, 3), days (of a partition, 7)."""

    @classmethod
    def name(cls) -> str:
        return "collected"

    def schema(self) -> str:
        return "source string, day string, item string, error string"

    def streamReader(self, schema) -> CollectedReader:
        return CollectedReader(dict(self.options))


class CollectedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.sources = json.loads(options["sources"])

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.sources, self.options["start"])

    def latestOffset(self, *_) -> dict:
        today = named(self.options["clock"])()
        return dict.fromkeys(self.sources, max(today, self.options["start"]))

    def partitions(self, start: dict, end: dict) -> list[Days]:
        """start and end are the markers before and after the batch; a source that is new begins at the option's start."""
        out, step = [], timedelta(days=int(self.options.get("days", 7)))
        for source, marker in end.items():
            before = start.get(source, self.options["start"])
            if marker == before and source in start:
                continue
            back = 0 if before == self.options["start"] else int(self.options.get("lookback", 3))
            lo, hi = date.fromisoformat(before) - timedelta(days=back), date.fromisoformat(marker)
            lo = max(lo, date.fromisoformat(self.options["start"]))
            while lo <= hi:
                out.append(Days(source, lo.isoformat(), min(lo + step - timedelta(days=1), hi).isoformat()))
                lo += step
        return out

    def read(self, partition: Days):
        try:
            for day, item in named(self.options["fetch"])(partition.source, partition.lo, partition.hi):
                yield partition.source, day, json.dumps(item, ensure_ascii=False, sort_keys=True), None
        except Exception as error:  # this source's, on these days; the others go on
            yield partition.source, partition.hi, None, f"{type(error).__name__}: {error}"[:500]

    def commit(self, end: dict) -> None:
        """Nothing to give back to a source."""


def markers(progress) -> dict[str, str]:
    """Marker of each source after the last batch, from a query's progress."""
    return json.loads(progress.json)["sources"][0]["endOffset"]
