"""Collectors as a stream that resumes, and sessions that end by timers."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrykit.sources.collected import CollectedReader, CollectedSource, Days, markers
from quarrykit.streaming import feeds, sessions
from quarrykit.tables import Table
from tests import published


@pytest.fixture
def state():
    def put(today, down=(), edition=1, hidden=()):
        Path(published.PATH).write_text(json.dumps({"today": today, "down": list(down), "edition": edition, "hidden": list(hidden)}))

    return put


OPTIONS = {"fetch": "tests.published:fetch", "clock": "tests.published:clock", "sources": json.dumps(["a", "b"]), "start": "2026-01-01", "days": "2"}


def test_partitions_follow_the_markers(state):
    state("2026-01-05")
    r = CollectedReader(OPTIONS | {"lookback": "2"})
    first, now = r.initialOffset(), r.latestOffset()
    assert first == {"a": "2026-01-01", "b": "2026-01-01"} and now == {"a": "2026-01-05", "b": "2026-01-05"}
    assert [(p.source, p.lo, p.hi) for p in r.partitions(first, now)][:3] == [("a", "2026-01-01", "2026-01-02"), ("a", "2026-01-03", "2026-01-04"), ("a", "2026-01-05", "2026-01-05")]
    assert r.partitions(now, now) == []
    assert [(p.source, p.lo, p.hi) for p in r.partitions({"a": "2026-01-05"}, {"a": "2026-01-06", "b": "2026-01-01"})] == [("a", "2026-01-03", "2026-01-04"), ("a", "2026-01-05", "2026-01-06"), ("b", "2026-01-01", "2026-01-01")]


def test_a_failing_source_is_a_row(state):
    state("2026-01-02", down=["b"])
    r = CollectedReader(OPTIONS)
    assert list(r.read(Days("b", "2026-01-01", "2026-01-02"))) == [("b", "2026-01-02", None, "OSError: b is down")]
    assert [x[1] for x in r.read(Days("a", "2026-01-01", "2026-01-02"))] == ["2026-01-01", "2026-01-02"]


def test_a_stream_resumes_and_merges_what_comes_again(spark, state, tmp_path):
    spark.dataSource.register(CollectedSource)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        rows = spark.readStream.format("collected").options(**OPTIONS, lookback="3").load()
        item = F.from_json("item", "id string, edition int")
        rows = rows.where("error is null").select(item["id"].alias("id"), "source", "day", item["edition"].alias("edition"))
        q = feeds.commit_stream(rows, out, ["id"], "edition", cp, 16)
        q.awaitTermination()
        return q

    state("2026-01-04", down=["b"], hidden=["2026-01-03"])
    q = run()
    t = Table(spark, out, ["id"], 16)
    assert sorted(r["id"] for r in t.read().collect()) == ["a-2026-01-01", "a-2026-01-02", "a-2026-01-04"]
    assert markers(q.lastProgress) == {"a": "2026-01-04", "b": "2026-01-04"}
    # A late item and the source that was down come with the look-back; nothing is twice.
    state("2026-01-06", edition=2)
    run()
    got = {r["id"]: r["edition"] for r in t.read().collect()}
    days = lambda s, lo, hi, n: {f"{s}-2026-01-{d:02}": n for d in range(lo, hi)}
    assert got == days("a", 1, 7, 2) | days("b", 1, 7, 2) | {"a-2026-01-01": 2}
    before = t.versions()
    run()  # nothing is new
    assert t.versions() == before


def test_sessions_end_by_timer(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out, src = str(tmp_path / "out"), str(tmp_path / "in")
        put = lambda *rows: spark.createDataFrame(rows, "k string, at string, o boolean").coalesce(1).write.mode("append").json(src)
        put(("a", "2026-01-01 00:00:00", None), ("b", "2026-01-01 00:00:10", False), ("a", "2026-01-01 00:00:30", False))
        stream = spark.readStream.schema("k string, at timestamp, o boolean").json(src)
        q = sessions.ended(stream, "k", "at", 60, "0 seconds", F.col("o")).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        assert spark.read.schema("key string").parquet(out).count() == 0
        put(("c", "2026-01-01 00:01:20", False), ("c", "2026-01-01 00:01:21", True))
        q.processAllAvailable()
        put(("d", "2026-01-01 00:05:00", False))
        q.processAllAvailable()
        q.stop()
        got = sorted((r["key"], r["what"], str(r["at"]), r["seen"]) for r in spark.read.parquet(out).collect())
        assert got == [("a", "expired", "2026-01-01 00:01:30", 2), ("b", "expired", "2026-01-01 00:01:10", 1), ("c", "signed out", "2026-01-01 00:01:21", 1)]
    finally:
        spark.conf.set(key, before)
