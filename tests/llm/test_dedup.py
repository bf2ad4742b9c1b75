from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from quarrykit.llm import minhash_odd, suffix_dedup
from quarrykit.llm import textnp as T
from quarrykit.llm.rlz_dedup import remove_repeated_phrases
from quarrykit.llm.suffix_dedup import remove_repeated_bytes
from tests.llm import brute

SCHEMA = "doc_id long, text string, block int, bucket string, id string"


def frame(spark, docs):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, 1, "b", "i") for d, t in docs], SCHEMA)


def corpus(seed: int = 3, n: int = 60) -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, hot lines, short, empty and null texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "Zoë", "#!"]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    hot, passage = text(15), text(90)
    docs: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one"), (5, "a b c d"), (6, "A b  c D")]
    bodies = [text(r.randint(20, 200)) for _ in range(n // 3)]
    for i in range(n):
        b = r.choice(bodies).split()
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            b[r.randrange(len(b))] = r.choice(words)
        if r.random() < 0.3:
            b[r.randrange(len(b)) : 0] = [passage]
        docs.append((10 + i, " ".join(b) + ("\n" + hot if r.random() < 0.5 else "")))
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [3, 4])
def test_phrases_equal_brute_force(spark, seed):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeated_phrases(frame(spark, docs)).collect()}
    assert got == brute.phrases(docs)


def test_factors_cover_what_is_removed(spark):
    docs = corpus(5)
    for r in remove_repeated_phrases(frame(spark, docs)).collect():
        cells = {i for f in r["factors"] for i in range(f["start"], f["start"] + f["words"])}
        assert len(cells) == r["n_removed"]
        assert all(f["reference"] < r["doc_id"] and f["words"] >= 13 for f in r["factors"])


def test_factors_equal_a_parse_against_first_occurrences(spark):
    docs = corpus(6)
    words = {d: brute.WORD.findall(t or "") for d, t in docs}
    want = brute.factors(docs)
    assert any(want.values())
    for r in remove_repeated_phrases(frame(spark, docs)).collect():
        got = [(f["start"], f["words"], f["reference"], f["reference_start"]) for f in r["factors"]]
        assert got == want[r["doc_id"]]
        for start, n, ref, at in got:
            assert words[r["doc_id"]][start : start + n] == words[ref][at : at + n]


def test_factor_ends_where_its_place_in_the_reference_jumps(spark):
    a, b = ([f"{c}{i}" for i in range(20)] for c in "ab")
    docs = [(1, " ".join([*a, "gap", *b])), (2, " ".join([*b, *a])), (3, " ".join([*a[:15], "gap"])), (4, " ".join([*a, "gap", *b]))]
    got = {r["doc_id"]: [(f["start"], f["words"], f["reference"], f["reference_start"]) for f in r["factors"]] for r in remove_repeated_phrases(frame(spark, docs)).collect()}
    assert got == {1: [], 2: [(0, 20, 1, 21), (20, 20, 1, 0)], 3: [(0, 15, 1, 0)], 4: [(0, 41, 1, 0)]}


def test_phrases_with_repeated_and_null_ids(spark):
    t = " ".join(f"x{i}" for i in range(20))
    got = sorted(((r["doc_id"], r["n_removed"]) for r in remove_repeated_phrases(frame(spark, [(1, t), (1, t), (None, t), (None, t), (2, t)])).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 20), (None, 20), (None, 20)]


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_equal_brute_force(spark, seed):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeated_bytes(frame(spark, docs)).collect()}
    assert got == brute.repeated_bytes(docs)


def test_bytes_within_one_document_and_narrow_windows(spark):
    docs = [(1, "abcdefgh" * 4 + "tail"), (2, "é" * 30), (3, "nothing here repeats")]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeated_bytes(frame(spark, docs), width=12, head=8).collect()}
    assert got == brute.repeated_bytes(docs, 12)


def test_levels_merge_geometrically():
    r = np.random.default_rng(1)
    levels, found, arrays = [], [], []
    for _ in range(7):
        a = np.unique(r.integers(0, 500, 80).astype(np.uint64))
        arrays.append(a)
        levels, hit = suffix_dedup.add_batch(levels, a)
        found += hit
    assert [x.rank for x in levels] == [2, 1, 0]
    assert set(np.concatenate([x.heads for x in levels]).tolist()) == set(np.concatenate(arrays).tolist())
    values, counts = np.unique(np.concatenate(arrays), return_counts=True)
    assert set(np.concatenate(found).tolist()) == set(values[counts > 1].tolist())


@pytest.mark.parametrize("seed", [3, 4])
def test_components_equal_brute_force(spark, seed):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_odd.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.components(docs)


def test_chain_beyond_the_star(spark):
    """Links between members of a bucket that are not near its head."""
    base = [f"t{i}" for i in range(300)]
    docs = []
    for i in range(12):
        b = list(base)
        for j in range(0, 5 * i, 5):
            b[(17 * j) % 300] = f"edit{j}"
        docs.append((i, " ".join(b)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_odd.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.components(docs)


def test_tiles_return_a_forest():
    text = [" ".join(f"k{j}" for j in range(i, i + 60)) for i in range(8)]
    codes, offs = minhash_odd.shingle_sets(*T.raw(pa.array(text)))
    _, sketch, _ = minhash_odd.signatures(codes, offs)
    t = pa.table({"id": list(range(8)), "component": list(range(8)), "sketch": [list(map(int, s.view(np.int64))) for s in sketch], "major": [False] * 8, "cluster": [0] * 8, "tile": [0] * 8, "x": [0] * 8, "y": [0] * 8, "k": [1] * 8, "text": text})
    assert minhash_odd._tile_links(t).num_rows == 7


def test_one_of_each_keeps_columns_and_null_ids(spark):
    t = "a b c d e f g"
    out = minhash_odd.one_of_each(frame(spark, [(2, t), (1, t), (None, t), (5, "other words entirely here now")]))
    assert out.columns == ["doc_id", "text", "block", "bucket", "id"]
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 5, None]


@pytest.mark.parametrize("op", [remove_repeated_phrases, remove_repeated_bytes, minhash_odd.near_duplicates])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketch_estimates_high_similarity():
    r = np.random.default_rng(5)
    for share in (0.75, 0.9):
        worst = 0
        for _ in range(50):
            n = 400
            both = int(n * 2 * share / (1 + share))
            common, a, b = r.integers(1, 1 << 62, both), r.integers(1, 1 << 62, n - both), r.integers(1, 1 << 62, n - both)
            codes = np.concatenate([np.unique(np.concatenate([common, x])) for x in (a, b)]).astype(np.uint64)
            _, sk, _ = minhash_odd.signatures(codes, np.array([0, n, 2 * n]))
            worst = max(worst, int(np.bitwise_count(sk[0] ^ sk[1]).sum()))
        assert worst <= minhash_odd.MOST_BITS


def test_long_single_document(spark):
    t = " ".join(f"n{i}" for i in range(200_000))
    got = remove_repeated_phrases(frame(spark, [(1, t), (2, t)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, 200_000)]
