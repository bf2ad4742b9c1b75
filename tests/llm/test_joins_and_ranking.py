"""The grouped prefix join, importance resampling and ranked search against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quarrykit.llm import group_join, impact_search, importance, minhash_odd
from quarrykit.llm import textnp as T
from tests.llm import brute
from tests.llm.test_dedup import corpus, frame


def families(seed: int, drift: int = 4) -> list[tuple[int, str]]:
    """Chains that drift from their start, templates just under the threshold, and copies with a few words changed."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    texts: list[list[str]] = []
    for _ in range(3):  # each link of a chain is near the next one, its ends are apart
        have = [word() for _ in range(120)]
        for i in range(12):
            have = have[: 8 * i] + [word() for _ in range(drift)] + have[8 * i + drift :]
            texts.append(have)
    for share in (0.75, 0.86, 0.9):
        base = [word() for _ in range(150)]
        texts += [base[: int(150 * share)] + [word() for _ in range(150 - int(150 * share))] for _ in range(15)]
    base = [word() for _ in range(200)]
    for _ in range(60):
        have = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            have[r.randrange(200)] = word()
        texts.append(have)
    texts += [[word() for _ in range(r.randrange(1, 9))] for _ in range(10)] + [base[:100], base[100:], base + base[:30]]
    out = [(i, " ".join(t)) for i, t in enumerate(texts)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("make, seed", [(families, 1), (families, 2), (corpus, 7), (corpus, 8)])
def test_links_equal_brute_force(spark, make, seed):
    docs = make(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in group_join.linked(frame(spark, docs)).collect()}
    assert got == brute.components(docs, 80)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_of_chains_equal_brute_force(spark, seed):
    docs = families(seed, drift=6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_odd.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.components(docs)


def test_links_at_another_threshold(spark):
    docs = families(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in group_join.linked(frame(spark, docs), percent=60).collect()}
    assert got == brute.components(docs, 60)


def test_classes_of_frequency_never_fall():
    x = group_join.frequency_class(np.array([1, 2, 200, 201, 250, 1000, 10**6, 10**12]))
    assert x[0] == 1 and x[1] == 2 and x[2] == 200 and (np.diff(x.astype(int)) >= 0).all() and x[-1] == 255


def test_unshared_shingles_are_no_keys(spark):
    docs = [(i, " ".join(f"x{i}y{j}" for j in range(50))) for i in range(5)] + [(9, None)]
    assert all(not r["keys"] for r in group_join.profiles(frame(spark, docs)).collect())


def test_codes_of_runs_are_crc32():
    r = random.Random(5)
    texts = ["", "one", "Two words", "é漢字 " + "z" * 64 + " " + "y" * 65 + " " + "x" * 1000, " ".join("".join(r.choice("abZ9") for _ in range(r.randrange(1, 90))) for _ in range(80))]
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    bucket, doc, words = importance.features(np.frombuffer("".join(texts).encode(), np.uint8), offs)
    for i, t in enumerate(texts):
        n, want = brute.bucket_counts(t)
        got = np.bincount(bucket[doc == i], minlength=10_000)
        assert words[i] == n and {b: c for b, c in enumerate(got) if c} == dict(want)


@pytest.mark.parametrize("slices, block", [(64, 4 << 20), (3, 2000), (10_000, 20_000)])
def test_draw_equals_brute_force(spark, monkeypatch, slices, block):
    monkeypatch.setattr(importance, "LEAST_SLICES", slices)
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    docs = corpus(11, 120) + [(500, "again " * 70_000)]
    target = [t for _, t in corpus(12, 9)]
    df = frame(spark, docs).repartition(3, "doc_id")
    got = importance.draw(importance.weigh(df, spark.createDataFrame([(t,) for t in target], "text string"))).collect()
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in got} == brute.drawn(docs, target)


def test_draw_of_half_and_of_none(spark):
    docs = corpus(13, 80)
    weighed = importance.weigh(frame(spark, docs), spark.createDataFrame([("w1 w2 w3",)], "text string"))
    want = brute.drawn(docs, ["w1 w2 w3"], 50)
    assert {r["doc_id"]: r["rank"] for r in importance.draw(weighed, 50).collect()} == {d: v[3] for d, v in want.items()}
    assert {r["rank"] for r in importance.draw(weighed, 0).collect()} == {None}
    chosen = importance.resample(frame(spark, docs), spark.createDataFrame([("w1 w2 w3",)], "text string"), percent=50)
    assert chosen.columns == ["doc_id", "text", "block", "bucket", "id"] and {r["doc_id"] for r in chosen.collect()} == {d for d, v in want.items() if v[3]}


def test_draw_without_a_target(spark):
    docs = corpus(14)
    got = importance.weigh(frame(spark, docs), spark.createDataFrame([], "text string")).collect()
    assert {r["doc_id"]: r["weight"] for r in got} == {d: v[1] for d, v in brute.drawn(docs, []).items()}


@pytest.mark.parametrize("shard, items", [(8 << 20, 32 << 20), (3000, 200)])
def test_ranking_equals_brute_force(spark, shard, items):
    docs = corpus(15, 150)
    docs += [(1000 + i, t) for i, (_, t) in enumerate(docs[:40])]  # ties
    asked = [(i, t) for i, (_, t) in enumerate(corpus(16, 12))] + [(3, "w1 w2 É!w3"), (3, "w1 w2 É!w3"), (3, "W1"), (4, "nowhere"), (5, None)]
    index = impact_search.build(frame(spark, docs), shard_bytes=shard)
    got = impact_search.search(index, spark.createDataFrame(asked, "item_id long, text string"), item_bytes=items).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == brute.ranked(docs, asked)


def test_selection_prefers_smaller_places_among_ties():
    assert impact_search.best(np.array([5, 7, 5, 0, 5, 7, 5]), 4).tolist() == [1, 5, 0, 2]
    assert impact_search.best(np.zeros(3, np.int64), 4).tolist() == []


def test_length_norm_beyond_64_bits():
    n, documents, terms = np.array([1, 10**9]), 10**11, 10**14
    assert impact_search.lengths_norm(n, documents, terms).tolist() == [10 + 90 * int(x) * documents // terms for x in n]


def test_terms_are_cut_at_ascii_marks_only():
    data = "Ab-c é漢9_x\x7fy".encode()
    s, e, _ = T.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), T.NO_TERM)
    assert [data[i:j].decode() for i, j in zip(s, e)] == ["Ab", "c", "é漢9", "x", "y"]
