"""Every numbered query and the pipeline over empty tables, and over odd rows with extra, clashing columns."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from quarrykit.llm import queries
from tests.llm import brute

SHAPES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars int",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
}
CLASHING = [("id", "string"), ("block", "int"), ("bucket", "string"), ("score", "double"), ("n", "int"), ("m", "int"), ("n_words", "int"), ("kinds", "string"), ("ids", "string"), ("host", "string"), ("prior", "int"), ("bad", "int"), ("kept", "string"), ("label", "string")]
PROSE = "The river ran down to the old mill, and the miller said that it would be a dry year for all of them. "
DOCS = [
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n ", "en", None, 3), (4, "one", "en", "a", None),
    (5, PROSE * 3, "en", "a", 300), (5, PROSE * 3, "en", "a", 300), (6, PROSE * 3, "en", "b", 300), (None, PROSE * 3, "en", "b", 300), (None, None, None, None, None),
    (7, "Ask anna.lee@example.com or 192.168.1.1 on 2024-03-05, " + PROSE, "en", "b", 100), (10, PROSE + "What does the miller say of the year?\nA dry year for all of them.", "en", "c", 160), (8, PROSE * 2000, "en", "c", 200_000), (9, "é ß 漢字 \x00 end", "xx", "c", 9),
]
PAGES = [
    (1, None, None), (2, "", ""), (3, "no scheme", "<p>a"), (4, "http://h.example.org/en/1?x", "<article><p>One &amp; two</p></article>"),
    (4, "http://h.example.org/en/1?x", "<article><p>One &amp; two</p></article>"), (None, "https://COM/fr/", "</div><<<"), (6, "http://h.example.org/" + "a/" * 20_000, "<div>" * 300 + "deep " * 20_000),
]
LABELS = [(1, 1, 0), (5, 1, 0), (5, 0, 0), (None, 1, 1), (7, None, None), (8, 0, 1), (8, 0, 1)]
BENCHMARK = [(1, "What does the miller say of the year?\nA dry year for all of them."), (1, None), (2, ""), (3, "x"), (None, "What does the miller say of the year?\nA dry year for all of them.")]
ALL = {**queries.QUERIES, "pipeline": corpus_pipeline.run}


def folder(spark, tmp_path_factory, rows: dict[str, list], extra: list) -> str:
    path = tmp_path_factory.mktemp("tables")
    for name, shape in SHAPES.items():
        have = [c.split()[0] for c in shape.split(", ")]
        more = [(c, kind) for c, kind in extra if c not in have]
        values = [(*r, *[{"int": 1, "double": 0.5, "string": "clash"}[k] for _, k in more]) for r in rows.get(name, [])]
        spark.createDataFrame(values, ", ".join([shape, *[f"{c} {k}" for c, k in more]])).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory, {}, [])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory, {"documents": DOCS, "pages": PAGES, "labels": LABELS, "benchmark": BENCHMARK}, CLASHING)


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, empty, name):
    assert ALL[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op3_decontaminate", "op13_impact_search"}))
def test_odd_rows_keep_their_ids(spark, odd, name):
    key, source = ("page_id", PAGES) if name.split("_")[0] in ("op1", "op6") else ("doc_id", DOCS)
    got = Counter(r[key] for r in queries.QUERIES[name](spark, odd).collect())
    assert got == Counter(r[0] for r in source)


def test_leaks_of_odd_rows(spark, odd):
    got = queries.QUERIES["op3_decontaminate"](spark, odd)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(10, 1), (10, None)}


def test_search_over_odd_rows(spark, odd):
    got = [tuple(r) for r in queries.QUERIES["op13_impact_search"](spark, odd).select("item_id", "rank", "doc_id", "score").collect()]
    large = (1 << 63) - 1  # a null id of a document is the largest
    docs = [(large if r[0] is None else r[0], r[1]) for r in DOCS]
    want = brute.ranked(docs, [(-1 if i is None else i, t) for i, t in BENCHMARK])
    assert sorted((-1 if i is None else i, k, large if d is None else d, s) for i, k, d, s in got) == want


def test_odd_rows_drawn(spark, odd):
    got = Counter((r["doc_id"], r["n_features"]) for r in queries.QUERIES["op12_importance"](spark, odd).collect())
    assert got == Counter((r[0], sum(brute.bucket_counts(r[1])[1].values())) for r in DOCS)


def test_odd_rows_linked(spark, odd):
    want = brute.components([(r[0], r[1]) for r in DOCS if r[0] is not None], 80)
    got = queries.QUERIES["op11_group_join"](spark, odd).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(d, c) for d, (_, c) in want.items()}
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}


def test_odd_rows_through_the_pipeline(spark, odd):
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, odd).collect()]
    assert set(got) <= {r[0] for r in DOCS}
    assert sum(d in (5, 6) for d in got) <= 1 and 10 not in got
