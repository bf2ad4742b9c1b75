from __future__ import annotations

import itertools
import random
import zlib
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import decontaminate, html_wrapper, pii_feistel, quality_knn, quality_rules, queries, sentencepiece_ac, url_reputation
from quarrykit.llm import textnp as T
from tests.compare import assert_same
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


# URL filters


def test_rules_longest_wins(spark):
    urls = {
        "https://Example.ORG/es/x": ("example.org", "/es/x", "example.org/es/", "block"), "http://a.example.org/en/12?q": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org": ("example.org", "", None, "allow"), "http://myexample.org/es/": ("myexample.org", "/es/", "org/", "allow"), "http://x.com/fr/1#a": ("x.com", "/fr/1", "com/fr/", "allow"),
        "x://b.com/de/": ("b.com", "/de/", "com/de/", "block"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge(pages, labels).collect()}
    assert got == dict(enumerate(urls.values()))


def test_bad_host_is_blocked_and_small_host_shrunk(spark):
    rows = [(i, f"http://{'bad' if i < 40 else 'good'}.net/p") for i in range(400)] + [(1000, "http://new.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 40 or i == 1000 else 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r["host"]: (r["verdict"], r["bad_rate"]) for r in url_reputation.judge(pages, labels).collect()}
    assert got["bad.net"][0] == "block" and got["good.net"][0] == "allow"
    assert got["new.net"][0] == "allow" and got["new.net"][1] < 1


def test_hosts_on_both_sides_of_the_limit(spark):
    """Two hosts of ten are bad nine times in ten, the others one in ten; one rare host has one bad page."""
    rows = [(100 * h + i, f"http://h{h}.net/p", 0 if (i % 10 > 0) == (h < 2) else 1) for h in range(10) for i in range(100)] + [(5000, "http://rare.net/", 0)]
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u, _ in rows] * 2, "page_id long, url string, bad string, prior double")
    labels = spark.createDataFrame([(i, q, 0, 7) for i, _, q in rows] + [(i, 1, 0, 7) for i, _, _ in rows], "doc_id long, quality int, toxic int, n int")
    rep = {r["host"]: r for r in url_reputation.reputation(pages, labels).collect()}
    assert all(rep[f"h{h}.net"]["n"] == 100 and rep[f"h{h}.net"]["bad"] == (90 if h < 2 else 10) for h in range(10))
    assert {h for h, r in rep.items() if r["bound"] > r["limit"]} == {"h0.net", "h1.net"}
    got = {(r["host"], r["verdict"]) for r in url_reputation.judge(pages, labels).collect()}
    assert {h for h, v in got if v == "block"} == {"h0.net", "h1.net"} and len(got) == 11


def test_quantile_equals_simulation(spark):
    import numpy as np

    r = np.random.default_rng(4)
    cases = [(0.7, 3.0), (2.0, 2.0), (30.0, 900.0), (5e4, 1e5)]
    df = spark.createDataFrame(cases, "a double, b double").select("a", "b", url_reputation.beta_quantile(F.col("a"), F.col("b")).alias("q"))
    for row in df.collect():
        below = (r.beta(row["a"], row["b"], 400_000) < row["q"]).mean()
        assert abs(below - 0.05) < 0.004


def test_null_ids_and_very_long_urls(spark):
    pages = spark.createDataFrame([(None, "http://a.net/" + "x" * 1_000_000), (1, None)], "page_id long, url string")
    labels = spark.createDataFrame([(None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert sorted((str(r["page_id"]), r["host"], r["verdict"]) for r in url_reputation.judge(pages, labels).collect()) == [("1", "", "allow"), ("None", "a.net", "allow")]


def test_no_pages(spark):
    assert url_reputation.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).collect() == []


# Benchmark decontamination

ITEMS = [(1, "What colour has the northern harbour light? The harbour light is green since spring."), (2, "uno dos tres cuatro"), (3, None), (4, ""), (5, "Ély vu aux quais\nLa mer était haute ce soir là")]


def test_leaks(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    filler = " ".join(f"filler{i}" for i in range(300))
    docs = [(1, f"{filler} {ITEMS[0][1].upper()} {filler}"), (2, "the northern harbour light is what colour"), (3, ITEMS[1][1]), (4, filler), (5, None), (6, ""), (7, "ÉLY VU AUX QUAIS LA MER ÉTAIT HAUTE CE SOIR LÀ"), (None, ITEMS[1][1]), (9, "What colour has the northern harbour light?")]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, items).collect()}
    assert got == {(1, 1), (3, 2), (None, 2), (7, 5)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, items, index_bytes=60).collect()} == got
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, items).where("doc_id is not null").collect()) == [2, 4, 5, 6, 9]
    assert decontaminate.leaks(df, items.limit(0)).collect() == []


def test_shards_score_alike(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole, dealt = (sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in decontaminate.leaks(docs, items, index_bytes=b).collect()) for b in (1 << 25, 16_000))
    assert whole and whole == dealt


def test_repeated_items_and_a_very_long_one(spark):
    long = " ".join(f"long{i}" for i in range(5000))
    items = spark.createDataFrame([(1, ITEMS[0][1]), (1, ITEMS[0][1]), (7, long)], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, f"{filler} {ITEMS[0][1]} {filler}", 2.0), (2, f"{filler} {long}", 2.0), (3, filler, 2.0)], "doc_id long, text string, score double")
    for size in (1 << 25, 30_000):
        got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items, index_bytes=size).collect())
        assert set(got) == {(1, 1), (2, 7)}


@pytest.mark.parametrize("seed", range(6))
def test_retrieval_equals_exhaustive_scores(seed):
    rng = random.Random(seed)
    texts = [f"q{i} " + " ".join(f"t{(i * j) % 40}" for j in range(1, 30)) for i in range(60)]
    texts += [" ".join(f"t{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.randint(1, 40))) for _ in range(70)]
    (index,) = decontaminate.indexes(list(enumerate(texts)))
    words = [decontaminate._coded(" ".join(rng.choice(texts) if rng.random() < 0.7 else f"t{rng.randint(0, 90)} x" for _ in range(rng.randint(1, 40)))) for _ in range(9)]
    codes = np.concatenate(words)
    counts = [-(-len(w) // index.segment) for w in words]
    seg_doc = np.repeat(np.arange(len(words)), counts)
    seg = np.concatenate([first + np.arange(len(w)) // index.segment for w, first in zip(words, np.cumsum([0, *counts]))])
    term = index.lookup(codes)
    found = list(zip(*[x.tolist() for x in index.candidates(term, seg, seg_doc)]))
    assert found == sorted(set(found))
    wanted = 0
    for s in range(len(seg_doc)):
        there = set(term[(seg == s) | ((seg == s + 1) & (seg_doc[np.minimum(seg, len(seg_doc) - 1)] == seg_doc[s]))].tolist())
        for i in range(len(texts)):
            pairs = list(zip(index.item_terms[i].tolist(), index.item_weights[i]))
            score = sum(w for t, w in pairs if t in there)
            bound = sum(w for t, w in pairs if t in there or not index.essential[t])
            assert ((s, i) in found) == (bound >= decontaminate.THRESHOLD - 1e-9) or abs(bound - decontaminate.THRESHOLD) < 1e-6
            wanted += score >= decontaminate.THRESHOLD
    assert wanted


def test_query_equals_brute_force_leaks(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    _same_leaks(brute.leaks(docs, items), queries.QUERIES["op3_decontaminate"](spark, sf).collect())


def test_leaks_of_items_of_all_lengths_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(n)) + ("? " if i % 2 else " ") + f"end{i} of w{i}") for i, n in enumerate([1, 2, 9, 40, 250, 300, 900, 1200, 1200])]
    docs = []
    for d in range(14):
        parts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 700)))]
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(items)[1].split()
            cut = rng.randint(0, len(words) // 2)
            parts += [" ".join(words[cut:] if rng.random() < 0.5 else words), f"w{rng.randint(0, 400)} filler " * rng.randint(0, 30)]
        docs.append((d, " ".join(parts)))
    rows = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    _same_leaks(brute.leaks(docs, items), rows.collect())
    dealt = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), index_bytes=4_000)
    _same_leaks(brute.leaks(docs, items), dealt.collect())


def _same_leaks(want, rows):
    assert want and sorted((r["doc_id"], r["item_id"]) for r in rows) == sorted(want)
    for r in rows:
        best, passages = want[r["doc_id"], r["item_id"]]
        assert (r["score"], r["question_overlap"], r["answer_overlap"]) == pytest.approx(best, abs=1e-8) and r["passage"] in passages


# Quality rules


def test_measures(spark):
    text = "a b c d e a b c d e # x\nline\nline\n \nlonger|"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "w " * 9), (5, "x y z w v " * 40)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert [got[1][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [15, 27, 2, 1, 10]
    assert [got[d]["base_failed"] for d in (1, 2, 3, 4, 5)] == [True] * 5
    assert got[5]["n_repeat_words"] == 200 and not got[5]["kept"]


def test_kept_returns_columns(spark):
    good = "The ships of the north come in the spring and leave with the first snow of the year."
    df = spark.createDataFrame([(1, good, "m"), (2, "#$% " * 30, "m"), (3, None, "m")], "doc_id long, text string, m string")
    assert [tuple(r) for r in quality_rules.kept(df).collect()] == [(1, good, "m")]


def test_line_and_word_ratios(spark):
    prose = "The ships of the north come in the spring and leave with the first snow of the year"
    texts = {1: "\n".join(["- the point is made here"] * 3 + [f"\u2022 and of it {i}" for i in range(9)]), 2: "\n".join(f"{prose} {i}..." for i in range(4)), 3: "\n".join([f"{prose} {i}\u2026 " for i in range(3)] + [f"{prose} {i}" for i in range(10, 18)]),
             4: "a b c d e f g h i j k l m n of", 5: " ".join(["THE", "Of", "und"] * 4 + [f"w{i}" for i in range(188)]), 6: "pneumonoultramicroscopicsilico " * 2 + prose.replace(" ", "x") * 12}
    df = spark.createDataFrame([(i, t, "z", 0) for i, t in texts.items()], "doc_id long, text string, m string, n_words int")
    got = {r["doc_id"]: {c for c in r.asDict() if c.startswith("fails_") and r[c]} for r in quality_rules.judge(df).collect()}
    assert got == {1: {"fails_bullet_lines"}, 2: {"fails_cut_lines"}, 3: set(), 4: {"fails_short_words"}, 5: set(), 6: {"fails_long_words"}}
    assert quality_rules.judge(df.limit(0)).count() == 0 and quality_rules.kept(df).columns == df.columns


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    df = spark.createDataFrame([(1, " ".join(words + words[:50]))], "doc_id long, text string")
    r = quality_rules.judge(df).first()
    assert (r["n_words"], r["n_repeat_words"], r["n_other_words"]) == (300_050, 100, 300_050)


def test_words_outside_the_list_are_counted(spark):
    rare = [f"word{i}" for i in range(1000)]
    texts = [rare[:999] + ["the"], rare[:990] + ["the"] * 10, rare, rare[:199] + ["the"], []]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_other_words"], r["fails_no_stop_words"], r["kept"]) for r in quality_rules.judge(df).collect()}
    assert got == {0: (999, True, False), 1: (990, False, True), 2: (1000, True, False), 3: (199, False, True), 4: (0, False, False)}
    assert [r["doc_id"] for r in quality_rules.kept(df).orderBy("doc_id").collect()] == [1, 3]


# HTML extraction

PAGE = "<html><body class='has-sidebar'><nav>menu</nav><div id='cookie-notice'>we use</div><div class='strap'>Daily news</div><article><h1>T{0} &amp; x</h1><p>one {0}<br>two <b>bold<p>three<ul><li>l1<li>l2</ul><div class='x9'>Follow us</div><script>var t='</p>';</script></article><section class='comments'><p>nice</p></section><footer>f</footer></body></html>"


def test_main_text(spark):
    rows = [(i, f"http://h/{i}", PAGE.format(i)) for i in range(6)] + [(90, None, None), (91, "http://o/", ""), (92, "http://o/1", "<p>a&nbsp; b</p>plain<div>c</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_wrapper.main_text(df).collect()}
    want = "T3 & x\n\none 3 two bold\n\nthree\n\nl1\n\nl2"
    assert got[3] == (want, len(want))
    assert got[90] == ("", 0) and got[91] == ("", 0) and got[92][0] == "a b\n\nplain\n\nc"


def test_copies_are_no_template(spark):
    df = spark.createDataFrame([(i, "http://h/", PAGE.format(1)) for i in range(6)], "page_id long, url string, html string")
    assert all(r["text"].startswith("T1 & x\n\none 1 two bold") for r in html_wrapper.main_text(df).collect())


def test_template_of_pages_without_article():
    pages = [f"<body><div>Site name</div><div>body {i}</div><p>same</p></body>" for i in range(5)]
    w = html_wrapper.induce(pages)
    assert html_wrapper.extract(pages[2], w) == "body 2"
    assert html_wrapper.extract(pages[2], None) == "Site name\n\nbody 2\n\nsame"
    assert html_wrapper.extract("<body><p>lone</p></body>", w) == "lone"


def test_deep_nesting():
    assert html_wrapper.extract("<div>" * 5000 + "x" + "</div>" * 5000, None) == "x"
    assert html_wrapper.extract("<div>" * 250 + "<nav>menu</nav><p>a</p><p>b", None) == "a\n\nb"
    deep = "<div>" * 2000
    w = html_wrapper.induce([f"{deep}<div>always</div><p>{i}</p>" for i in range(4)])
    assert html_wrapper.extract(f"{deep}<div>always</div><p>7</p>", w) == "7"


def test_quotes_without_a_partner():
    for page in ("<p><a title=it's href=u>y</a> don't</p>", '<p><a title="x href=u>y</a> don\'t</p>', "<p><a =\"' b>y</a> don't</p>", "<p><a title='a > b'>y</a> don't"):
        assert html_wrapper.extract(page, None) == "y don't"
    assert html_wrapper.extract("<p " + "a" * 50_000 + " " + "b='" * 20_000 + "x", None).startswith("<p a")


def test_furniture_by_whole_names():
    for name in ("reader-responses", "main-nav", "cookie-banner", "x9 site-footer", "comments"):
        assert html_wrapper.extract(f"<body><div class='{name}'>out</div><p>in</p>", None) == "in"
    for tag in ("<p class='search-result-note'>", "<p id='social'>", "<section class='header-story'>", "<div class='story-share-price'>"):
        assert html_wrapper.extract(f"<body>{tag}in</body>", None) == "in"


def test_tree_matching_is_order_preserving():
    n = lambda s, *c: [s, [""], list(c)]
    a, b = [n("x"), n("y", n("z")), n("w")], [n("y", n("z")), n("x"), n("w")]
    assert html_wrapper.matching(a, b) == [(1, 0), (2, 2)]
    assert html_wrapper.size(n("r", *a), n("r", *b)) == 4
    same = [["d", ["1"], []], ["d", ["2"], []], ["d", ["3"], []]], [["d", ["2"], []], ["d", ["9"], []]]
    assert html_wrapper.matching(*same) == [(1, 0), (2, 1)]  # equal texts attract


def test_slots_that_shift_are_aligned(spark):
    """A box of its own on some pages moves all that follow; furniture that varies goes by its element."""
    lead = lambda i: f"<div class='lead'>lead {i}</div>" * (i % 3)
    page = "<body><nav>menu {0}</nav><div>Daily news</div>{1}<div>text {0}</div><div>All rights</div></body>"
    rows = [(i, "http://h/", page.format(i, lead(i))) for i in range(9)] + [(20 + i, "http://few/", page.format(i, "")) for i in range(2)]
    got = _texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert all(got[i] == "\n\n".join([f"lead {i}"] * (i % 3) + [f"text {i}"]) for i in range(9))
    assert got[21] == "Daily news\n\ntext 1\n\nAll rights"  # two pages are no evidence


def test_boxes_that_are_on_no_page_of_the_skeleton(spark):
    """A box of some pages: constant there though the skeleton's pages are others; what copies of one page have is content."""
    page = "<body><div class='top'>Site</div>{1}<div class='text'>text {0}</div></body>"
    box = "<section class='alpha'><div class='in'>Rain tomorrow</div></section>"
    rows = [(i, "http://h/", page.format(i, "")) for i in range(60)]
    flat = html_wrapper.skeletons(spark.createDataFrame(rows, "page_id long, url string, html string")).first()["skeleton"]
    some = [(100 + i, "http://h/", page.format(100 + i, box)) for i in range(5)] + [(200 + i, "http://h/", page.format(200, "<section class='beta'>own</section>")) for i in range(4)]
    some += [(300 + i, "http://h/", page.format(300 + i, f"<section class='gamma'>varies {i}</section>")) for i in range(4)]
    df = spark.createDataFrame(rows + some, "page_id long, url string, html string")
    by_host = html_wrapper.templates(df, spark.createDataFrame([("h", flat)], "host string, skeleton string")).first()
    w = html_wrapper.Wrapper(by_host["skeleton"], frozenset(by_host["constant"].split(",")))
    got = {r[0]: html_wrapper.extract(r[2], w) for r in rows + some}
    assert all(got[i] == f"text {i}" for i in [*range(60), *range(100, 105)])
    assert all(got[200 + i] == "own\n\ntext 200" and got[300 + i] == f"varies {i}\n\ntext {300 + i}" for i in range(4))


def test_the_whole_result_equals_wrappers_of_each_host(spark, sf):
    """All pages of the table: hosts one after another in plain Python, from the same pages of a host."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    few = {r["host"]: r["skeleton"] for r in html_wrapper.skeletons(pages).collect()}
    host, _ = url_reputation.host_and_path(F.col("url"))
    rows = pages.select("page_id", "html", host.alias("host")).collect()
    want = {}
    for h in {r["host"] for r in rows}:
        mine = [r for r in rows if r["host"] == h]
        w = html_wrapper.Wrapper(few[h])
        seen = [w.facts(html_wrapper.parse(r["html"])) for r in mine]
        for slot, sign, text in set().union(*seen):
            pages_of_slot = sum(any(f[:2] == (slot, "") for f in x) for x in seen)
            n = sum((slot, sign, text) in x for x in seen)
            if text and n >= max(html_wrapper.ENOUGH, html_wrapper.SHARE * pages_of_slot):
                w.constant |= {html_wrapper._fact(slot, sign, text)}
        want |= {r["page_id"]: html_wrapper.extract(r["html"], w) for r in mine}
    assert _texts(pages) == want


def _texts(df):
    return {r["page_id"]: r["text"] for r in html_wrapper.main_text(df).collect()}


def test_boxes_after_many_runs_are_template(spark):
    runs = "".join(f"<h2>h{{0}} {k}</h2><p>p{{0}} {k}</p>" for k in range(20))
    page = f"<article>{runs}<div class='bio'>Written by us</div></article>"
    bare = f"<body>{runs}<div class='bottom'>All rights</div></body>"
    rows = [(i, "http://a/", page.format(i)) for i in range(6)] + [(10 + i, "http://b/", bare.format(i)) for i in range(6)]
    got = _texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    want = ["\n\n".join(f"h{i} {k}\n\np{i} {k}" for k in range(20)) for i in range(6)]
    assert got == {i: want[i] for i in range(6)} | {10 + i: want[i] for i in range(6)}


def test_deep_boxes_are_template(spark):
    page = "<body>" + "<div class='in'>" * 20 + "<div class='bottom'>All rights</div><p>text {0}</p>" + "</div>" * 20 + "</body>"
    df = spark.createDataFrame([(i, "http://h/", page.format(i)) for i in range(6)], "page_id long, url string, html string")
    assert _texts(df) == {i: f"text {i}" for i in range(6)}


def test_template_does_not_depend_on_the_partitions(spark):
    # Many layouts of one host: each page has boxes of its own around a common one.
    own = lambda i: "".join(f"<div class='w{chr(97 + (i * 7 + k * k) % 26)}{chr(97 + k)}'>x{i} {k}</div>" for k in range(20))
    rows = [(i, "http://h/", f"<body>{own(i)}<div class='bottom'>All rights</div>{own(i + 1)}</body>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [_texts(df.coalesce(1)), _texts(df.orderBy(F.desc("page_id")).coalesce(1)), _texts(df.repartition(7))]
    assert got[0] == got[1] == got[2]
    assert not any("All rights" in t for t in got[0].values())


# SentencePiece


@pytest.fixture(scope="module")
def pieces():
    pytest.importorskip("sentencepiece")
    import os

    if not os.path.exists(sentencepiece_ac.MODEL):
        pytest.skip("no model file")
    return sentencepiece_ac.Pieces.read()


TEXTS = ["", " ", "  a  b ", "x\n\n y\n", "▁ab ▁", "héllo wörld 漢字 😀 \x00", "the the\tthe", "a" * 3000, "\u2581\u2581 x"]


def test_round_trip(spark, pieces):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids array<int>")
    coded = sentencepiece_ac.encode(df)
    assert all(r["round_trip"] in (True, None) for r in coded.collect())
    back = {r["doc_id"]: r["text"] for r in sentencepiece_ac.decode(coded).collect()}
    assert back == dict(enumerate([*TEXTS, None]))


def test_library_decodes_the_same(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_ac.MODEL)
    enc = sentencepiece_ac.Encoder(pieces)
    for t in ("Hello there", "ordinary words, with 12 numbers", "naïve façade"):
        assert model.decode(list(memoryview(enc.encode(t)).cast("i"))) == t


def test_best_path_equals_enumeration(pieces):
    enc = sentencepiece_ac.Encoder(pieces)
    score = {p: s for p, s, _ in pieces.pieces}
    by_id = {i: p for p, _, i in pieces.pieces}
    for word in ("▁theses", "▁anble", "▁ciónes", "▁ab▁"[:3], "unerhört"):
        best = -1e9
        for cut in itertools.product((0, 1), repeat=len(word) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cut) if c], len(word)]
            parts = [word[i:j] for i, j in zip(at, at[1:])]
            if all(p in score for p in parts):
                best = max(best, sum(score[p] for p in parts))
        got = [by_id[i] for i in enc.segment(word)]
        assert "".join(got) == word
        assert sum(score[p] for p in got) == pytest.approx(best)


def test_words_join_to_the_whole_path(pieces):
    enc = sentencepiece_ac.Encoder(pieces)
    for t in ("one  two\nthree ", "The ship (sails) at 9."):
        assert list(memoryview(enc.encode(t)).cast("i")) == enc.segment((" " + t).replace(" ", sentencepiece_ac.MARK))


# PII


def masked(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(pii_feistel.masked(F.col("t"), "k").alias("m")).first()["m"]


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_formats_survive(spark):
    m = masked(spark, "card 4111 1111 1111 1111, +1 (499) 555-6503, ip 10.2.3.4, on 2024-02-29 or 31.12.1999, ssn 123-45-6789, mail a.b@c.example.com")
    assert m["kinds"] == ["card", "phone", "ip", "date", "date", "ssn", "email"]
    import re

    got = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}), \+1 \(\d{3}\) \d{3}-\d{4}, ip (\d+\.\d+\.\d+\.\d+), on (\d{4}-\d\d-\d\d) or \d\d\.\d\d\.\d{4}, ssn 123-\d\d-\d{4}, mail [a-z0-9]\.[a-z0-9]@c.example.com", m["text"])
    assert got and luhn(got[1]) and max(map(int, got[2].split("."))) <= 255 and date.fromisoformat(got[3])
    for old in ("4111", "499", "10.2.3.4", "2024-02-29", "45-6789", "a.b@"):
        assert old not in m["text"]


def test_invalid_and_clean_text_stay(spark):
    for t in ("4111111111111112", "2023-02-29", "999.1.1.1", "000-12-3456", "version 3 of 4.0", "", "no digits"):
        m = masked(spark, t)
        assert (m["text"], m["kinds"]) == (t, [])
    assert masked(spark, None)["text"] is None


def test_equal_values_stay_linked_and_others_differ(spark):
    a, b = masked(spark, "x 4111111111111111 4111-1111-1111-1111")["text"].split()[1:]
    assert a == b.replace("-", "")


def test_names_keep_their_form_and_never_collide(spark):
    one = [c for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    two = [f"{a}{b}" for a in one[::3] for b in one]
    long = ["n" * 300 + str(i) for i in range(200)] + [f"first.last-{i}" for i in range(200)]
    names = one + two + long
    df = spark.createDataFrame([(n, f"mail {n.upper()}@x.org and {n}@x.org.", 1) for n in names], "n string, t string, text int")
    got = {r["n"]: r["m"]["text"] for r in df.select("n", pii_feistel.masked(F.col("t"), "k").alias("m")).collect()}
    assert len(set(got.values())) == len(names)
    import re

    for n, t in got.items():
        m = re.fullmatch(r"mail (\S+)@x\.org and (\S+)@x\.org\.", t)
        assert m and m[1] == m[2] and re.sub("[a-z0-9]", "x", m[1]) == re.sub("[a-z0-9]", "x", n)


def test_report_of_odd_tables(spark):
    long = "word " * 200_000 + "call +1 (499) 555-6503"
    df = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (2, None, "c"), (3, "\u00e9ric@x.org +99 (12) 123 1234567890123456", "d")], "doc_id long, text string, kinds string")
    rows = pii_feistel.report(df, "k").collect()
    assert sorted((r["doc_id"], r["n_phone"]) for r in rows if r["doc_id"] == 1) == [(1, 1), (1, 1)]
    assert [len(r["text"]) for r in rows if r["doc_id"] == 1] == [len(long)] * 2 and [r["text"] for r in rows if r["doc_id"] == 2] == [None]
    assert pii_feistel.report(df.limit(0), "k").count() == 0 and pii_feistel.pseudonymise(df, "k").columns == df.columns


def test_permutations_are_bijective(spark):
    n = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert n.select(pii_feistel.permute_digits(F.col("d"), "t", "k").alias("p")).distinct().count() == 1000
    days = spark.range(0, 146097, 7).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pii_feistel._date(F.col("d"), "k").alias("p")).distinct().count() == days.count()


def test_feistel_equals_plain_python(spark):
    import hashlib

    def h(tag, r, x):
        return int(hashlib.sha256(f"key|{tag}|{r}|{x}".encode()).hexdigest()[:12], 16)

    def plain(d):
        left = len(d) // 2
        a, b, ra, rb, tag = int(d[:left]), int(d[left:]), 10**left, 10 ** (len(d) - left), f"t{len(d)}"
        for r in range(pii_feistel.ROUNDS):
            a, b = ((a + h(tag, r, b)) % ra, b) if r % 2 == 0 else (a, (b + h(tag, r, a)) % rb)
        return f"{a:0{left}d}{b:0{len(d) - left}d}"

    for d in ("12", "007", "1234567890", "123456789012345678"):
        got = spark.createDataFrame([(d,)], "d string").select(pii_feistel.permute_digits(F.col("d"), "t", "key")).first()[0]
        assert got == plain(d)


# Quality classifier


def test_held_out_accuracy(spark, sf):
    rows = queries.QUERIES["op9_quality_knn"](spark, sf).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r["predicted"] == label[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in label]
    assert sum(tested) >= 0.85 * len(tested)


def test_vocabulary_decides_between_texts_of_one_shape(spark):
    r = random.Random(8)
    good, bad = (["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(30)] for _ in range(2))
    rows = [(i, " ".join(r.sample(good if i % 2 else bad, 20)), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    out = [x for x in quality_knn.score(docs, labels).collect() if x["held_out"]]
    assert len(out) > 20
    assert all(x["predicted"] == x["doc_id"] % 2 for x in out)


def test_all_ties_at_the_last_neighbour_vote():
    texts = pa.array(["same words here again"] * 40 + ["12 34 ?"] * 10, pa.string())
    counts, n = quality_knn.term_counts(*T.raw(texts))
    labels = np.array([1] * 10 + [0] * 30 + [1] * 10)
    turned = np.arange(len(n))[::-1]
    for order in (np.arange(len(n)), turned):
        model = quality_knn.Model(counts[order], n[order], labels[order])
        assert np.allclose(model.scores(counts[:1], n[:1]), 0.25, atol=1e-6)
        assert np.allclose(model.scores(counts, n)[0], model.scores(counts[:1], n[:1])[0], atol=1e-6)


def test_repeated_rows_and_labels_and_a_long_text_score(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (3, "word " * 50000), (4, "x y z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (4, 1)], "doc_id long, quality int")
    out = quality_knn.score(docs, labels).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 1, 3, 4]
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    assert all(0 <= r["score"] <= 1 for r in out)


def test_scores_of_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "a word", 0.1), (4, "*** !!! ***", 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_knn.score(docs, none).collect()} == {0.5}
    assert quality_knn.score(docs.limit(0), none).collect() == []


# Pipeline


def test_pipeline_equals_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() <= before
    assert p.run(spark, sf).count() == docs.count()


def test_near_duplicate_stage_equals_brute_force(spark, sf):
    import corpus_pipeline as p

    docs = p.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).where("doc_id < 120")
    want = sorted(d for d, (_, c) in brute.components([(r["doc_id"], r["text"]) for r in docs.collect()]).items() if d == c)
    assert sorted(r["doc_id"] for r in p.near_duplicates(spark, docs, sf).collect()) == want
