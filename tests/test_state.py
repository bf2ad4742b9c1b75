"""Versioned tables, credit gates, run states and observed collection."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarrykit.operators import gate, profiles, runs
from quarrykit.plans import catalog, state
from quarrykit.streaming import feeds as streams
from quarrykit.tables import CommitConflict, Table


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_commits_rewrite_the_touched_partitions(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), ["id"], 100)
    assert t.read() is None and t.versions() == []
    assert t.upsert(spark.range(1000).withColumn("v", F.lit("a"))) == 1
    before = t.manifest()[1]
    assert t.upsert(spark.createDataFrame([(5, "b"), (5, "c"), (2000, "d")], "id long, v string").withColumn("at", F.monotonically_increasing_id()), order="at") == 2
    after = t.manifest()[1]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 2
    got = {r["id"]: r["v"] for r in t.read().collect()}
    assert len(got) == 1001 and got[5] == "c" and got[2000] == "d" and got[6] == "a"
    assert {r["id"]: r["v"] for r in t.read(1).collect()} == dict.fromkeys(range(1000), "a")
    assert t.delete(spark.range(990)) == 3 and sorted(r["id"] for r in t.read().collect()) == [*range(990, 1000), 2000]
    assert t.delete(spark.createDataFrame([(i,) for i in (*range(990, 1000), 2000)], "id long")) == 4
    assert t.read() is None or t.read().count() == 0


def test_a_commit_that_fails_changes_nothing(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), ["id"], 4)
    t.upsert(spark.range(10).withColumn("v", F.lit(1)))
    with pytest.raises(Exception, match="boom"):
        t.upsert(spark.range(5).withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.lit(2)).cast("int")))
    assert t.versions() == [1] and {r["v"] for r in t.read().collect()} == {1}
    # Two writers that began from one version: the second is refused.
    base = t.manifest()[0]
    t.upsert(spark.range(2).withColumn("v", F.lit(5)))
    with pytest.raises(CommitConflict):
        t.commit(spark.range(2).withColumn("v", F.lit(6)), [0, 1, 2, 3], base)
    assert t.versions() == [1, 2] and sorted(r["v"] for r in t.read().collect()) == [1] * 8 + [5] * 2
    assert t.vacuum(1) >= 1 and t.versions() == [2] and t.read().count() == 10


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for batch in ([(i, "a", 1) for i in range(200)], [(1, "b", 2), (500, "c", 2)], [(1, "z", 1)]):
        spark.createDataFrame(batch, "id int, t string, at int").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id int, t string, at int").parquet(src)
        streams.commit_stream(stream, out, ["id"], "at", cp, 100).awaitTermination()
    t = Table(spark, out, ["id"], 100)
    assert t.versions() == [1, 2, 3] and t.read().count() == 201
    first, second = t.manifest(1)[1], t.manifest(2)[1]
    assert sum(first.get(b) != f for b, f in second.items()) <= 2
    mark = t.manifest()[2]
    assert t.upsert(spark.createDataFrame([(1, "again", 9)], "id int, t string, at int"), mark) == 3  # a batch that runs again


def test_gate_stops_at_the_least_balance(spark):
    notices = [(i, a, c) for i, (a, c) in enumerate([("x", 30.0), ("y", 60.0), ("x", 30.0), ("x", 30.0), ("y", 1.0), (None, 1.0), ("x", 1.0), ("z", None)])]
    df = spark.createDataFrame(notices, "id int, account string, price double").repartition(4)

    def model(row):
        if row["price"] is None or row["price"] != row["price"]:
            raise ValueError("no price")
        return {"answer": f"a{row['id']}", "cost": row["price"]}

    out = gate.gated(df, spark.createDataFrame([("x", 120.0), ("y", 60.0), ("z", 50.0)], "account string, balance double"), model)
    assert [(r["id"], r["state"], r["answer"], r["cost"], r["balance"]) for r in out.orderBy("id").collect()] == [
        (0, "completed", "a0", 30.0, 90.0), (1, "completed", "a1", 60.0, 0.0), (2, "completed", "a2", 30.0, 60.0), (3, "completed", "a3", 30.0, 30.0),
        (4, gate.INSUFFICIENT, None, 0.0, 0.0), (5, gate.INSUFFICIENT, None, 0.0, 0.0), (6, gate.INSUFFICIENT, None, 0.0, 30.0), (7, "failed", "ValueError: no price", 0.0, 50.0),
    ]
    assert rows(gate.usage_entries(out).select("account", "type", "amount", "balance", "id"), "id") == [("x", "usage", -30.0, 90.0, 0), ("y", "usage", -60.0, 0.0, 1), ("x", "usage", -30.0, 60.0, 2), ("x", "usage", -30.0, 30.0, 3)]


def test_analyses_number_and_route(spark):
    df = spark.createDataFrame([(1, 7, "a", "text", "pdf", 100), (2, 7, "a", "", "pdf", 1), (3, 8, "a", "text", "docx", 1)], "id int, notice_id int, account string, body string, kind string, size int")
    out = gate.gated(df, spark.createDataFrame([("a", 100.0)], "account string, balance double"), lambda r: {"answer": "ok", "cost": 1.0})
    got = gate.analyses(out, spark.createDataFrame([(7, 2)], "notice_id int, analysis_seq int"), F.col("body"), F.col("kind"), F.col("size"))
    assert rows(got.select("notice_id", "analysis_seq", "mode", "route"), "notice_id", "analysis_seq") == [(7, 3, "full", "binary"), (7, 4, "simple", "simple"), (8, 1, "full", "text")]


def test_refused_transitions_change_nothing(spark):
    steps = ["pending", "completed", "processing", "processing", "completed", "processing", None, "no such state"]
    log = spark.createDataFrame([("r", i, s, f"m{i}") for i, s in enumerate(steps)] + [("q", 0, "failed", "x")], "run string, at int, state string, message string")
    got = runs.checked(log, "run").orderBy("run", "at").select("run", "before", "error", "message").collect()
    assert [tuple(r) for r in got] == [
        ("q", "", "nothing to failed", "x"), ("r", "", None, "m0"), ("r", "pending", "pending to completed", "m1"), ("r", "pending", None, "m2"), ("r", "processing", None, "m3"), ("r", "processing", None, "m4"),
        ("r", "completed", "completed to processing", "m5"), ("r", "completed", "completed to null", "m6"), ("r", "completed", "completed to no such state", "m7"),
    ]


def test_observations_equal_the_counters(spark, tmp_path):
    made = {"a": spark.range(10), "b": spark.range(100, 103), "none": spark.range(0)}
    out, seen = runs.observed(made, F.col("id") % 2 == 0)
    out.write.parquet(str(tmp_path / "o"))
    want = {r["source"]: (r["collected"], r["matched"]) for r in runs.counters(spark.read.parquet(str(tmp_path / "o")), F.col("id") % 2 == 0, spark.range(0), "id").collect()}
    got = {name: (o.get["collected"], o.get["matched"]) for name, o in seen.items()}
    assert got == want | {"none": (0, 0)} and got["a"] == (10, 5)


def plainly(profile: dict, hints: list[dict], mode: str = "append_only") -> tuple:
    """A profile after its hints, one after another, each compared with all before it."""
    key = lambda x: re.sub(r"[\s,.·\-_()\[\]]+", "", x or "").lower()
    names, old, new, n = [p["name"] for p in profile["projects"]], profile["certificates"], [], [0, 0, 0, 0]
    for h in sorted(hints, key=lambda h: h["id"]):
        name = (h["name"] or "").strip(" ")
        if not name:
            continue
        if h["type"] == "실적":
            k = key(name)
            same = k and any(e and (e == k or (len(e) >= 6 and len(k) >= 6 and (e in k or k in e))) for e in map(key, names))
            names += [] if same else [name]
            n[1 if same else 0] += 1
        elif h["type"] in ("인증", "특허"):
            line = f"{name} ({h['year']})" if h["year"] else name
            k, lines = key(line), [key(x) for x in [*old.split("\n"), *new]]
            same = k and any(e and (e == k or SequenceMatcher(None, k, e).ratio() >= 0.85) for e in lines)
            new += [] if same else [line]
            n[3 if same else 2] += 1
    text = old if not new else "\n".join(new) if mode == "fill_empty" and not old.strip() else old + ("\n" if old and not old.endswith("\n") else "") + "\n".join(new)
    return names, text, *n


def test_applied_profiles_equal_brute_force(spark, sf):
    own, hints = (df.collect() for df in state.profile_rows(spark, sf))
    want = {p["source_id"]: plainly(p.asDict(), [h.asDict() for h in hints if h["source_id"] == p["source_id"]]) for p in own}
    got = {r["source_id"]: ([p["name"] for p in r["projects"]], r["certificates"], *list(r)[3:]) for r in catalog.QUERIES["q_profile_apply"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("mode", profiles.MODES)
def test_profiles_grow_in_order(spark, mode):
    item = "array<struct<name: string, client: string, amount: string, period: string, role: string>>"
    own = {1: {"projects": [{"name": "Harbour lights"}], "certificates": "ISO 9001 quality\n"}, 2: {"projects": [], "certificates": " "}, 3: {"projects": [], "certificates": ""}}
    rows = [(1, 1, "실적", "harbour  lights of Busan", None, None), (1, 2, "실적", "New bridge", 2020, " City "), (1, 3, "실적", "new-bridge", 2021, None), (1, 4, "인증", "ISO 9001 qualitx", None, None), (1, 5, "특허", "Patent of pumps", 2019, None),
            (1, 6, "인증", "Patent of pumps", 2018, None), (1, 7, "인증", "(", None, None), (1, 8, "인증", "(", None, None), (1, 9, "other", "x", None, None), (1, 10, "인증", "  ", None, None), (2, 1, "인증", "one", None, None), (2, 2, "인증", "one", None, None), (4, 1, "실적", "alone", None, None)]
    df = spark.createDataFrame([(k, [(p["name"], "", "", "", "") for p in v["projects"]], v["certificates"]) for k, v in own.items()], f"source_id int, projects {item}, certificates string")
    hints = spark.createDataFrame(rows, "source_id int, id int, type string, name string, year int, organization string")
    got = {r["source_id"]: ([p["name"] for p in r["projects"]], r["certificates"], *list(r)[3:]) for r in profiles.applied(df, hints, mode=mode).collect()}
    dicts = [dict(zip(("source_id", "id", "type", "name", "year", "organization"), r)) for r in rows]
    want = {k: plainly(own.get(k, {"projects": [], "certificates": ""}), [h for h in dicts if h["source_id"] == k], mode) for k in (1, 2, 3, 4)}
    assert got == want
    marked = profiles.marked(hints.withColumn("user_action", F.lit("pending")), spark.createDataFrame([(1, 2), (9, 1)], "source_id int, id int"))
    assert [r["id"] for r in marked.where("user_action = 'imported'").collect()] == [2] and marked.count() == len(rows)


@pytest.mark.parametrize("few", [0, 3, 100])
def test_profiles_in_blocks_and_rounds_equal_brute_force(spark, monkeypatch, few):
    """Chains of lines and of names that hold each other, over many blocks and rounds of links."""
    monkeypatch.setattr(profiles, "BLOCK", 4)
    monkeypatch.setattr(profiles, "GROWTH", 2)
    monkeypatch.setattr(profiles, "FEW", few)
    r = random.Random(few)
    base = ["".join(r.choice("abcdef") for _ in range(24)) for _ in range(4)]
    item = "array<struct<name: string, client: string, amount: string, period: string, role: string>>"
    own = {k: {"projects": [{"name": base[k][:9]}], "certificates": base[k][:20]} for k in range(2)}
    rows = []
    for i in range(160):
        b = r.choice(base)
        x = r.randrange(18)
        name = b[x : x + r.randrange(3, 14)] if i % 2 else "".join(r.choice("xyz") if r.random() < 0.12 else c for c in b)
        rows.append((i % 3, i, "실적" if i % 2 else "인증", name, None, None))
    df = spark.createDataFrame([(k, [(p["name"], "", "", "", "") for p in v["projects"]], v["certificates"]) for k, v in own.items()], f"source_id int, projects {item}, certificates string")
    hints = spark.createDataFrame(rows, "source_id int, id int, type string, name string, year int, organization string")
    got = {x["source_id"]: ([p["name"] for p in x["projects"]], x["certificates"], *list(x)[3:]) for x in profiles.applied(df, hints).collect()}
    dicts = [dict(zip(("source_id", "id", "type", "name", "year", "organization"), x)) for x in rows]
    assert got == {k: plainly(own.get(k, {"projects": [], "certificates": ""}), [h for h in dicts if h["source_id"] == k]) for k in range(3)}
