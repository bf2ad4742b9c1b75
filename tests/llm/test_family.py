"""The suffix family: levels as tables, and report widths."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quarrykit.llm import suffix_dedup as S
from tests.llm import brute
from tests.llm.test_dedup import corpus, frame


def entries(family) -> set[tuple[int, bytes]]:
    out = set()
    for r in family.levels().collect():
        out |= {(r["bucket"], r["body"][i : i + 12]) for i in range(0, len(r["body"]), 12)}
    return out


def test_batches_one_by_one_equal_one_batch(spark, tmp_path):
    docs = [(i, t) for i, (_, t) in enumerate(corpus(7, 80))]
    one, many = (S.Family(spark, str(tmp_path / f), 8) for f in ("one", "many"))
    whole = {r["doc_id"]: r["longest"] for r in one.add(frame(spark, docs)).collect()}
    parts = [docs[i::5] for i in range(5)]
    seen: dict[int, int] = {}
    for p in parts:
        seen |= {r["doc_id"]: r["longest"] for r in many.add(frame(spark, p)).collect()}
    assert [rank for rank, _ in many.live] == [2, 0]
    assert entries(one) == entries(many)
    # A later batch meets all earlier ones: the last one knows as much as one batch does.
    assert all(seen[d] == whole[d] for d, _ in parts[-1]) and all(seen[d] <= whole[d] for d, _ in docs)


def test_longest_equals_brute_force():
    r = np.random.default_rng(2)
    rows = np.unique(np.ascontiguousarray(r.integers(0, 4, (200, S.SYMBOLS)).astype(">u4")).view(S._ENTRY).ravel())
    table = rows.view(">u4").reshape(-1, S.SYMBOLS).tolist()

    def common(a, b):
        k = 0
        while k < len(a) and a[k] == b[k] != 0:
            k += 1
        return k

    want = [max(common(a, b) for b in table if b is not a) for a in table]
    assert S.longest(rows, rows).tolist() == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_passages_below_the_width(spark, seed):
    """Random cuts of a few long texts: overlaps of every length, shared bytes counted at 60, removed at 150."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcde fgh") for _ in range(900)) for _ in range(3)]
    docs = []
    for i in range(40):
        b, x, y = r.choice(base), r.randrange(900), r.randrange(900)
        docs.append((i, "".join(r.choice("xyz ") for _ in range(r.randrange(80))) + b[min(x, y) : max(x, y)] + "é" * r.randrange(3)))
    got = {x["doc_id"]: x for x in S.remove_repeated_bytes(frame(spark, docs), width=150, head=20, report=60).collect()}
    want, shared = brute.repeated_bytes(docs, 150), brute.repeated_bytes(docs, 60)
    assert {d: (g["n_bytes"], g["n_removed"], g["n_spans"], bytes(g["kept"])) for d, g in got.items()} == want
    assert {d: g["n_shared"] for d, g in got.items()} == {d: x[1] for d, x in shared.items()}


def test_many_rows_of_one_or_no_id(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))
    rows = [(None, long)] * 3 + [(1, long)] * 2 + [(None, f"{i} short") for i in range(50)]
    got = S.remove_repeated_bytes(frame(spark, rows)).collect()
    assert len(got) == 55 and sorted({(r["n_bytes"], r["n_removed"]) for r in got if r["n_bytes"] > 100}) == [(900, 900)]
