"""Fuzzy pairs, lines and merges against plain Python."""

from __future__ import annotations

import os
import random
import uuid
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.operators import claims, resemblance
from quarrykit.operators import greedy as greedy_module
from quarrykit.plans import catalog

T = claims.THRESHOLD


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def best_pairs(rows: list[tuple[int, str, str]], limit: int) -> list[tuple]:
    out = []
    for a, ca, sa in rows:
        for b, cb, sb in rows:
            if a < b and ca == cb and sa is not None and sb is not None:
                r = 1.0 if sa == sb else ratio(sa, sb)
                if r >= T:
                    out.append((-r, a, b, ca))
    return [(c, a, b, -r) for r, a, b, c in sorted(out)[:limit]]


def near_copies(seed: int, n: int = 120) -> list[tuple[int, str, str]]:
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 60))) for _ in range(12)]
    out = []
    for i in range(n):
        s = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            if s:
                s[r.randrange(len(s))] = r.choice("xyz")
        out.append((i * 7 % n, r.choice("AB"), "".join(s)))
    return [*out, (500, "A", None)]


@pytest.mark.parametrize("limit", [5, 50, 2000])
def test_pairs_equal_brute_force(spark, limit):
    rows = near_copies(limit)
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, category string, statement string, step string")
    assert [tuple(r) for r in claims.similar_pairs(df, T, limit).collect()] == best_pairs(rows, limit)


def test_the_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat_ws("/", "source", "lang"), F.substring_index("text", "\n", 1)).collect()
    assert [tuple(r) for r in catalog.QUERIES["q_near_dup_pairs"](spark, sf).collect()] == best_pairs([tuple(r) for r in docs], 50)


def test_pairs_of_different_statements_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat_ws("/", "source", "lang"), F.substring_index("text", "\n", 1)).collect()
    first: dict[tuple, int] = {}
    for d, c, s in sorted(tuple(r) for r in docs):
        first.setdefault((c, s), d)
    assert [tuple(r) for r in catalog.QUERIES["q_near_dup_distinct_pairs"](spark, sf).collect()] == best_pairs([(d, c, s) for (c, s), d in first.items()], 50)


def test_known_lines_equal_brute_force(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    key = lambda s: "".join(c for c in s.lower() if c not in " ,.·_()[]-\t\n")
    old: dict[int, str] = {}
    for i, t in items:
        old[i % 5] = min(old.get(i % 5, t), t)
    want = []
    for i, t in items:
        lines = [key(x) for x in old[i % 5].split("\n")]
        want.append((i % 5, t, key(t) != "" and any(o and (key(t) == o or ratio(key(t), o) >= T) for o in lines)))
    got = [(r["key"], r["line"], r["duplicate"]) for r in catalog.QUERIES["q_fuzzy_line_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_the_merge_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", F.coalesce(F.substring_index("text", "\n", 1), F.lit("")).alias("s")).orderBy("doc_id").collect()
    kept: dict[str, list[dict]] = {}
    for r in docs:
        have = kept.setdefault(f"{r['source']}/{r['lang']}", [])
        for k in have:
            if ratio(k["statement"], r["s"]) >= T:
                k["n"] += 1
                k["statement"] = max(k["statement"], r["s"], key=len) if len(r["s"]) > len(k["statement"]) else k["statement"]
                break
        else:
            have.append({"id": r["doc_id"], "statement": r["s"], "n": 1})
    want = sorted((c, k["id"], k["statement"], k["n"]) for c, v in kept.items() for k in v)
    got = sorted((r["category"], r["id"], r["statement"], r["recurrence"]) for r in catalog.QUERIES["q_greedy_dedup"](spark, sf).collect())
    assert got == want


def texts_of(seed: int, n: int = 70) -> list[str]:
    """Short and long texts, edited in place, cut, doubled and with parts moved; long ones have rare characters."""
    r = random.Random(seed)
    base = ["".join(r.choice("eeeeeaaaaiiionnrstlu dh") for _ in range(k)) for k in (5, 30, 120, 199, 200, 260, 700)]
    out = ["", "x", "e" * 300]
    for _ in range(n):
        s = list(r.choice(base))
        for _ in range(r.choice([0, 1, 3, len(s) // 14, len(s) // 8])):
            k = r.randrange(len(s) + 1)
            s[k : k + r.choice([0, 0, 1, 2])] = r.choice(["", "Q", "e", "z!", "an"])
        if r.random() < 0.2:
            k = r.randrange(len(s) + 1)
            s = s[k:] + s[:k]
        out.append("".join(s))
    return sorted(set(out))


@pytest.mark.parametrize("seed", range(6))
def test_bounds_never_rule_out_a_resembling_pair(seed):
    texts = texts_of(seed)
    of = resemblance.Texts(texts)
    alike = ruled = 0
    for i, a in enumerate(texts):
        for t in (T, 0.6):
            near = set(resemblance.possible(of, i, of, np.arange(len(texts)), t).tolist())
            for j, b in enumerate(texts):
                if max(ratio(a, b), ratio(b, a)) >= t:
                    alike += 1
                    assert j in near and resemblance.alike(a, b, t), (a, b)
                else:
                    ruled += j not in near or not resemblance.alike(a, b, t)
    assert alike > len(texts) and ruled > alike


def test_common_subsequence():
    r = random.Random(4)
    for _ in range(40):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        assert resemblance.common_subsequence(a, b) == row[-1]


def greedy(rows: list[tuple]) -> list[tuple]:
    kept: dict[str, list[dict]] = {}
    for id_, c, s, tag in sorted(rows):
        have = kept.setdefault(c, [])
        for k in have:
            if ratio(k["s"], s) >= T:
                k["n"], k["tags"] = k["n"] + 1, list(dict.fromkeys([*k["tags"], tag]))
                k["s"] = s if len(s) > len(k["s"]) else k["s"]
                break
        else:
            have.append({"id": id_, "s": s, "n": 1, "tags": [tag]})
    return sorted((c, k["id"], k["s"], k["n"], tuple(k["tags"])) for c, v in kept.items() for k in v)


@pytest.mark.parametrize("seed, rows_of_a_chunk", [(1, 4096), (2, 7), (3, 4096)])
def test_growing_representatives_equal_brute_force(spark, monkeypatch, seed, rows_of_a_chunk):
    """Chains of ever longer statements, met again and again, so that later claims do otherwise than earlier ones."""
    monkeypatch.setattr(resemblance, "ROWS", rows_of_a_chunk)
    r = random.Random(seed)
    base = "".join(r.choice("abcdefgh ") for _ in range(60))
    family = [base[:k] for k in range(8, 60, 3)] + [base[k:] for k in range(0, 50, 4)] + texts_of(seed, 20)
    rows = [(i, r.choice("AAB"), r.choice(family), f"t{r.randrange(9)}") for i in range(400)]
    df = spark.createDataFrame([(i, c, s, [t]) for i, c, s, t in rows], "id long, category string, statement string, tags array<string>")
    got = claims.greedy_merge(df.repartition(3)).collect()
    assert sorted((r["category"], r["id"], r["statement"], r["recurrence"], tuple(r["tags"])) for r in got) == greedy(rows)


def test_tags_by_kind_and_null_statements(spark):
    tags = lambda d, a: ([d], a, None)
    rows = [(1, "k", "abcdefghij", tags("x", ["p", "p"])), (2, "k", "abcdefghijk", tags("y", ["q"])), (3, None, None, tags("z", None)), (4, None, "", tags("w", ["p"]))]
    df = spark.createDataFrame(rows, "id int, category string, statement string, tags struct<domain: array<string>, audience: array<string>, method: array<string>>")
    got = sorted((r["id"], r["statement"], r["recurrence"], tuple(map(tuple, r["tags"]))) for r in claims.greedy_merge(df).collect())
    assert got == [(1, "abcdefghijk", 2, (("x", "y"), ("p", "q"), ())), (3, "", 2, (("z", "w"), ("p",), ()))]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    r = random.Random(seed)
    texts = [t for t in texts_of(seed, 60) if "\n" not in t]
    new = [(r.choice([1, 2, None]), t) for t in texts]
    old = {k: "\n".join(r.sample(texts, 12)) for k in (1, 2)}
    key = lambda s: "".join(c for c in s.lower() if c not in " ,.·_()[]-\t\n")
    want = []
    for k, t in new:
        lines = [key(x) for x in old.get(k, "").split("\n")]
        want.append((str(k), t, key(t) != "" and any(o and (key(t) == o or ratio(key(t), o) >= T) for o in lines)))
    lines = spark.createDataFrame(new, "k int, line string")
    got = claims.known_lines(lines, spark.createDataFrame(list(old.items()), "k int, existing string"), "k").collect()
    assert sorted((str(r["k"]), r["line"], r["duplicate"]) for r in got) == sorted(want)


def test_reaching_a_threshold_equals_the_ratio():
    """Blocks are looked for only until the answer is clear, and from few places in long texts: same answer as difflib's."""
    r, match = random.Random(5), SequenceMatcher(None)
    for _ in range(400):
        base = "".join(r.choice("abcdefghijklmnopqrstuvwxyz     eeettaaon") for _ in range(r.choice((0, 3, 30, 150, 199, 200, 260, 600))))
        a, b = ("".join(r.choice("xyz eta") if r.random() < noise else c for c in base if r.random() > noise / 2) for noise in (r.choice((0, 0.02, 0.1, 0.2)), r.choice((0, 0.05, 0.3))))
        for t in (0.3, 0.6, 0.85, 1.0, round(SequenceMatcher(None, a, b).ratio(), 3), SequenceMatcher(None, a, b).ratio()):
            assert resemblance._reaches(match, a, b, t) == (SequenceMatcher(None, a, b).ratio() >= t), (a, b, t)
        hits = list(range(len(a)))
        match.set_seqs(a, b)
        assert resemblance._longest(a, b, [i for i in hits if a[i] in match.b2j], match.b2j, 0, len(a), 0, len(b)) == tuple(match.find_longest_match(0, len(a), 0, len(b)))


def syllables(r: random.Random, length: int) -> str:
    return "".join(r.choice(("th", "er", "on", "an", "tion", "he", "in", "re", "ed", "nd", " ", " ", "of ", ". ")) for _ in range(length))[:length]


@pytest.mark.parametrize("t", [T, 0.6])
def test_pairs_near_each_other_around_the_limits_of_lengths(t):
    """Every pair whose ratio reaches the threshold, each once, whichever bounds its lengths call for; of one table and of two."""
    r = random.Random(7)
    texts = {""}
    for n in (1, 8, 39, 40, 41, 72, 100, 149, 150, 175, 198, 199, 200, 201, 230, 270, 271, 272, 321, 400, 700):
        base = syllables(r, n)
        for noise in (0, 0.02, 0.03, 0.05, 0.08, 0.12):
            texts.add("".join(r.choice(("", "e", "xy", "Q")) if r.random() < noise else c for c in base))
    texts = sorted(texts)
    r.shuffle(texts)
    of = resemblance.Texts(texts)
    everything = lambda i, j: np.ones(len(i), bool)
    some = [(int(a), int(b)) for i, j in resemblance.near(of, of, True, t, everything) for a, b in zip(i, j)]
    got = {frozenset(p) for p in some}
    assert len(got) == len(some)
    x, y = resemblance.Texts(texts[::2]), resemblance.Texts(texts[1::2])
    between = {(int(a), int(b)) for i, j in resemblance.near(x, y, False, t, everything) for a, b in zip(i, j)}
    linked = 0
    for i, a in enumerate(texts):
        for j in range(i):
            if max(ratio(a, texts[j]), ratio(texts[j], a)) >= t:
                linked += 1
                assert {i, j} in got, (a, texts[j])
                if i % 2 != j % 2:
                    even, odd = sorted((i, j), key=lambda k: k % 2)
                    assert (even // 2, odd // 2) in between, (a, texts[j])
    assert linked > len(texts) / 2


def test_different_texts_of_any_length_are_ruled_out_together():
    """Of unlike texts of 80 to 260 letters no more than one pair in a thousand is left to be compared one by one."""
    r = random.Random(3)
    of = resemblance.Texts([syllables(r, r.randint(80, 260)) for _ in range(300)])
    left = sum(len(i) for i, _ in resemblance.near(of, of, True, T, lambda i, j: np.ones(len(i), bool)))
    assert left < 45


def test_only_components_with_new_claims_are_folded_again(spark, monkeypatch, tmp_path):
    """A representative that grows away from a statement has its component folded again, and no other."""
    plain, folder = greedy_module._fold, str(tmp_path)

    def fold(threshold, order):
        inner = plain(threshold, order)

        def noted(pdf):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(pdf["_text"].min()[0])
            return inner(pdf)

        return noted

    monkeypatch.setattr(greedy_module, "_fold", fold)
    rows = [(0, "k", "abcdefghij", "t"), (1, "k", "abcdefghijklm", "t"), (2, "k", "abcdefghij", "t"), (3, "k", "abcdefghijklmnop", "t"), (4, "k", "abcdefghij", "t"), (5, "k", "abcdefghijklm", "t")]
    rows += [(10, "k", "0123456789", "t"), (11, "k", "01234567899", "t")]
    df = spark.createDataFrame([(i, c, s, [t]) for i, c, s, t in rows], "id long, category string, statement string, tags array<string>")
    got = claims.greedy_merge(df).collect()
    assert sorted((r["category"], r["id"], r["statement"], r["recurrence"], tuple(r["tags"])) for r in got) == greedy(rows)
    times = [open(os.path.join(folder, f)).read() for f in os.listdir(folder)]
    assert times.count("a") > 1 and times.count("0") == 1
