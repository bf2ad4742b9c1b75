"""A paged JSON API as a Spark data source: one partition a keyword and date range.

``fetch(keyword, lo, hi, page, size)`` is any importable callable that returns
(items, total); it is named as ``module:function`` in the options, so that
executors import it.  Failures are tried again with growing waits; a page that
still fails ends its own loop with a row that holds the error, and what was read
before it, like all other loops, stays.  A source that says which statuses are
worth a wait (too many requests, 429) has other failures end the loop at once; a
failure's status is its ``code`` or ``status``.  A source with several kinds of
notices has a loop for each, and fetch takes the kind last.
"""

from __future__ import annotations

import json
import time
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from quarrykit.sources.collected import named


class Request(InputPartition):
    def __init__(self, keyword: str, lo: str, hi: str, kind: str | None = None):
        super().__init__((keyword, lo, hi, kind))
        self.keyword, self.lo, self.hi, self.kind = keyword, lo, hi, kind


class PagedSource(DataSource):
    """Options: fetch, keywords (JSON list), start, end (yyyy-MM-dd), days (7), size (100), wait (3, seconds), push (false).

    And for a source's own rules: kinds (JSON list), statuses (JSON list of those to wait for; unset: any failure),
    pause (seconds after a page), pages (most of a loop), stop (a callable as fetch; whether a page's items are the last
    that are wanted).

    With push, filters on keyword decide what is asked for at all; Spark wants
    spark.sql.python.filterPushdown.enabled for that.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        kind = "kind string, " if "kinds" in self.options else ""
        return f"{kind}keyword string, page int, item string, error string"

    def reader(self, schema) -> PagedReader:
        options = dict(self.options)
        return PushedReader(options) if options.get("push", "false").lower() == "true" else PagedReader(options)


class PagedReader(DataSourceReader):
    TRIES, WAIT = 3, 3.0

    def __init__(self, options: dict):
        self.options = options
        self.keywords = json.loads(options["keywords"])
        self.kinds = json.loads(options["kinds"]) if "kinds" in options else [None]
        self.statuses = json.loads(options["statuses"]) if "statuses" in options else None

    def partitions(self) -> list[Request]:
        lo, end = (date.fromisoformat(self.options[k]) for k in ("start", "end"))
        step = timedelta(days=int(self.options.get("days", 7)))
        spans = []
        while lo <= end:
            spans.append((lo.isoformat(), min(lo + step - timedelta(days=1), end).isoformat()))
            lo += step
        return [Request(k, a, b, kind) for kind in self.kinds for k in self.keywords for a, b in spans]

    def read(self, partition: Request):
        fetch, stop = named(self.options["fetch"]), named(self.options["stop"]) if "stop" in self.options else None
        size, page, most = int(self.options.get("size", 100)), 1, int(self.options.get("pages", 0))
        own = () if partition.kind is None else (partition.kind,)
        while True:
            try:
                items, total = self._again(fetch, partition.keyword, partition.lo, partition.hi, page, size, *own)
            except OSError as error:
                yield *own, partition.keyword, page, None, f"{type(error).__name__}: {error}"[:500]
                return
            for item in items:
                yield *own, partition.keyword, page, json.dumps(item, ensure_ascii=False), None
            if page * size >= total or not items or page == most or (stop is not None and stop(items)):
                return
            time.sleep(float(self.options.get("pause", 0)))
            page += 1

    def _again(self, fetch, *args):
        for attempt in range(self.TRIES):
            try:
                return fetch(*args)
            except OSError as error:
                status = getattr(error, "code", getattr(error, "status", None))
                if attempt + 1 == self.TRIES or (self.statuses is not None and status not in self.statuses):
                    raise
                time.sleep(float(self.options.get("wait", self.WAIT)) * (attempt + 1))


class PushedReader(PagedReader):
    def pushFilters(self, filters):
        """Takes equality and lists of keywords, and leaves the rest to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("keyword",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keywords = [k for k in self.keywords if k in wanted]
            else:
                yield f
