from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from quarrykit.operators import claims, documents, extraction, ledger, match, merge, notices, ordered
from quarrykit.sources import feeds, paged
from quarrykit.streaming import feeds as streams

_PROPOSAL = (
    "표지\n목차 Ⅰ. 제안 개요 1 1. 사업 이해 2 2. 추진 방향 5 Ⅱ. 수행 계획 7 1. 교육 운영 8\nⅠ. 제안 개요\n1 사업 이해\n본문 하나\n| 1 표 | 안 |\n2 추진 방향\n제 2020-34호 벤처기업 확인서 2020 년\nⅡ. 수행 계획\n1 교육 운영\n마지막 줄"
)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_interest_rules(spark):
    n = spark.createDataFrame([(1, "a > b"), (2, "a"), (3, ""), (4, "a > c"), (5, None)], "id int, procure_class string")
    some = spark.createDataFrame([("b",)], "mid_class string")
    assert [r[0] for r in rows(notices.interested(n, some).select("id"))] == [1, 3, 5]
    assert notices.interested(n, some.limit(0)).count() == 5


def test_long_keyword_lists_match_alike(spark):
    docs = spark.createDataFrame([(1, "Solar panel"), (2, "wind"), (3, "")], "id int, t string")
    words = spark.createDataFrame([("panel",), ("SOL",), ("x",), ("wi",)], "keyword string")
    short = rows(match.matched(docs, F.col("t"), words).select("id", "keywords"))
    assert short == [(1, "SOL,panel"), (2, "wi")]
    assert rows(match._joined(docs, F.col("t"), words).select("id", "keywords")) == short
    assert rows(match.without_contained(words)) == [("SOL",), ("panel",), ("wi",), ("x",)]


def test_long_lists_keep_all_short_keywords(spark):
    pairs = [chr(0xAC00 + i // 50) + chr(0xB000 + i % 50) for i in range(2500)]
    docs = spark.createDataFrame([(i, f"x {k} y") for i, k in enumerate(pairs)] + [(3000, "!aQ"), (3001, "-"), (3002, None)], "id int, t string")
    words = spark.createDataFrame([(k,) for k in [*pairs, "Q", "long word"]], "keyword string")
    got = rows(match.matched(docs, F.col("t"), words).select("id", "keywords", "n_keywords"))
    assert got == [(i, k, 1) for i, k in enumerate(pairs)] + [(3000, "Q", 1)]


def test_upsert_tag_and_unique(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, t string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "id int, t string, n int")
    assert rows(merge.upsert(base, new, ["id"])) == [(1, "a", 1, "keep"), (2, "b", 5, "update"), (3, "c", 6, "insert")]
    tags = spark.createDataFrame([(1, "x", "m")], "notice_id int, tag string, memo string")
    change = spark.createDataFrame([(1, "y", "")], "notice_id int, tag string, memo string")
    assert rows(merge.set_tag(tags, change)) == [(1, "y", "m")]
    assert rows(merge.set_tag(tags, change, keep_memo=False)) == [(1, "y", "")]


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        merge.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n


def test_ledger(spark):
    e = spark.createDataFrame([(1, "k", "charge", 100.0), (2, "k", "usage", 30.0)], "id int, acc string, type string, amount double")
    out = ledger.with_balance(ledger.entries(e), "acc", "id")
    assert [r[0] for r in out.select("balance").orderBy("id").collect()] == [100.0, 70.0]


def test_streak_and_pages(spark):
    p = spark.createDataFrame([("d", i, v) for i, v in enumerate([1, 5, 20, 3, 4, 30, 20, 10, 40])], "k string, i int, v int")
    assert [r[0] for r in rows(ordered.cut_at_streak(p, ["k"], "i", "v", 5).select("i"))] == [0, 1, 2, 3, 4, 5, 6]
    q = spark.createDataFrame([("s", 1, 0), ("s", 2, 1), ("s", 2, 0), ("s", 3, 0)], "k string, page int, old int")
    assert rows(ordered.take_pages(q, ["k"], "page", F.col("old") == 1)) == [("s", 1, 0), ("s", 2, 0)]


def test_contents_keep_or_drop_sub_markers(spark):
    docs = spark.createDataFrame([(1, "목차 Ⅰ. 개요 1 1. 이해 2 1-1) 배경 3 2. 방향 4")], "doc_id int, text string")
    loose = documents.contents(docs).first()["entries"]
    assert [e["marker"] for e in loose] == ["Ⅰ.", "1.", "2."]
    assert [e["marker"] for e in documents.contents(docs, strict_sub=True).first()["entries"]] == ["Ⅰ.", "1.", "1-1)", "2."]


def test_hints(spark):
    body = "제 2020-34호 벤처기업 확인서 2020 년\n| 제 1호 인증\n등록 여부\n제 2020-34호 벤처기업 확인서 2020 년"
    docs = spark.createDataFrame([(1, body)], "doc_id int, text string")
    assert rows(documents.hints(docs)) == [(1, 0, "제 2020-34호 벤처기업 확인서 2020 년", 2020)]


def test_attachments(spark):
    page = '<a href="/f/a%20b.pdf">Plan (69KB)</a><a href="/f/a%20b.pdf">again</a><a href="x.png">i</a><a href="/down?fileDown=1"></a><a href="/about">no</a>'
    p = spark.createDataFrame([(1, "http://h/x/", page)], "page_id int, url string, html string")
    assert rows(documents.attachments(p)) == [(1, "Plan", "http://h/f/a%20b.pdf"), (1, "down", "http://h/down?fileDown=1")]


def _docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    xml = f'<w:document xmlns:w="{w}"><w:body>{p("one")}<w:tbl><w:tr>{cell("a")}{cell("b|c")}</w:tr><w:tr>{cell("d")}</w:tr></w:tbl>{p("two")}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.docx", _docx())
        z.writestr("skip.txt", "x")
    f = spark.createDataFrame([("a.docx", bytearray(_docx())), ("b.docx", bytearray(b"junk")), ("c.pptx", bytearray(b"x"))], "name string, content binary")
    got = {r["name"]: r["p"] for r in f.select("name", documents.parsed_file("name", "content").alias("p")).collect()}
    assert got["a.docx"]["text"] == "one\n| a | b\\|c |\n| --- | --- |\n| d |  |\ntwo"
    assert not got["b.docx"]["success"] and got["b.docx"]["error"].startswith("BadZipFile")
    assert got["c.pptx"]["error"] == "unsupported format: pptx"
    z = spark.createDataFrame([(bytearray(outer.getvalue()),)], "content binary")
    assert [m["name"] for m in z.select(documents.zip_members("content")).first()[0]] == ["in.docx"]


def test_greedy_merge_compares_with_representative(spark):
    c = spark.createDataFrame([(1, "k", "abcdefghij", ["x"], 0.7), (2, "k", "abcdefghijk", ["y"], 0.9), (3, "k", "zzz", ["z"], 0.8), (4, "l", "abcdefghij", ["w"], 0.6)], "id int, category string, statement string, tags array<string>, confidence double")
    got = rows(claims.greedy_merge(c).select("category", "statement", "recurrence", "tags", "confidence"), "category", "statement")
    assert got == [("k", "abcdefghijk", 2, ["x", "y"], 0.9), ("k", "zzz", 1, ["z"], 0.8), ("l", "abcdefghij", 1, ["w"], 0.6)]


def test_greedy_merge_keeps_sections_variants_and_source(spark):
    data = [
        (1, 7, "k", "abcdefghij", ["x"], ["s1"], {"short": "a", "long": ""}, 0.7), (2, 8, "k", "abcdefghijk", ["y"], ["s2", "s1"], {"short": "b", "tag": "t", "none": ""}, 0.9),
        (3, 9, "k", "zzz", ["z"], None, None, 0.8),
    ]
    c = spark.createDataFrame(data, "id int, doc int, category string, statement string, tags array<string>, sections array<string>, variants map<string,string>, confidence double")
    got = rows(claims.greedy_merge(c).select("id", "doc", "statement", "tags", "sections", "variants", "recurrence", "confidence"), "id")
    assert got == [(1, 7, "abcdefghijk", ["x", "y"], ["s1", "s2"], {"short": "a", "long": "", "tag": "t"}, 2, 0.9), (3, 9, "zzz", ["z"], [], {}, 1, 0.8)]


def test_greedy_merge_meets_equal_statements_in_order(spark):
    # The third claim equals the first, but by then the representative has grown out of its reach.
    grown = "abcdefghij" + "klm"
    c = spark.createDataFrame([(1, "k", "abcdefghij", ["x"], 0.7), (2, "k", grown, ["y"], 0.7), (3, "k", grown + "nopq", ["z"], 0.7), (4, "k", "abcdefghij", ["w"], 0.7)], "id int, category string, statement string, tags array<string>, confidence double")
    got = rows(claims.greedy_merge(c).select("id", "statement", "recurrence", "tags"), "id")
    assert got == [(1, grown + "nopq", 3, ["x", "y", "z"]), (4, "abcdefghij", 1, ["w"])]


def _ordered_model(prompt: str) -> str:
    name, body = prompt.split(": ", 1)
    say = lambda s, c: {"category": "USP", "statement": s, "tags": ["mentor"], "proposal_sections": [name], "length_variants": {"at": name}, "confidence": c}
    return json.dumps({"claims": [say("We ship our goods by sea", 0.7), say(f"Only {name}", 0.9)]})


def test_extracted_claims_go_by_document_and_section(spark):
    docs = spark.createDataFrame([(i, _PROPOSAL) for i in (2, 1)], "doc_id long, text string")
    names = [r["name"] for r in documents.wanted_sections(documents.sections(docs)).where("doc_id = 1").orderBy("start").collect()]
    got = {r["statement"]: r for r in extraction.extract_claims(docs, "{section}: {text}", _ordered_model, ["mentor"]).collect()}
    r = got["We ship our goods by sea"]
    assert (r["doc_id"], r["name"], r["sections"], r["variants"], r["recurrence"]) == (1, names[0], names, {"at": names[0]}, 2 * len(names))
    assert r["claim_id"] == "cl_" + hashlib.md5(b"1:We ship our goods by sea").hexdigest()[:8]


def test_preview_and_apply(spark):
    h = spark.createDataFrame([(1, 7, "실적", "Harbour project 2024"), (2, 7, "실적", "Tiny"), (3, 7, "인증", "Certificate of venture"), (4, 7, "기타", "else")], "id int, source_id int, type string, name string")
    p = spark.createDataFrame([(7, ["harbour-project"])], "source_id int, names array<string>")
    c = spark.createDataFrame([(7, "certificate of venturE\nother")], "source_id int, existing string")
    got = {r["id"]: (r["target"], r["duplicate"], r["selected"]) for r in claims.preview(h, p, c).collect()}
    assert got == {1: ("project", True, False), 2: ("project", False, False), 3: ("certificate", True, False), 4: ("ignored", False, False)}
    fresh = spark.createDataFrame([(1, 7, "project", "New dock works"), (2, 7, "project", "new-dock works (2)")], "id int, source_id int, target string, name string")
    assert claims.applied(fresh, p).first()["names"] == ["harbour-project", "New dock works"]


def _model(prompt: str) -> str:
    if "교육" in prompt:
        raise ValueError("down")
    return "```json\n" + json.dumps({"claims": [{"category": "USP", "statement": "We ship", "tags": ["mentoring"], "confidence": 0.9}, {"category": "none", "statement": "x", "tags": [], "confidence": 0.9}]}) + "\n```"


def test_extraction_with_stub_model(spark):
    docs = spark.createDataFrame([(1, _PROPOSAL)], "doc_id long, text string")
    got = extraction.extract_claims(docs, "{section}: {text}", _model, ["mentor"]).collect()
    assert [(r["statement"], r["recurrence"], r["tags"]) for r in got] == [("We ship", 2, ["mentor"])]


def fetch(keyword, lo, hi, page, size):
    items = [{"k": keyword, "lo": lo, "i": i} for i in range(5)]
    return items[(page - 1) * size : page * size], len(items)


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged_api").options(fetch="tests.test_operators:fetch", keywords='["a", "b"]', start="2026-01-01", end="2026-01-10", size="2").load()
    assert df.count() == 2 * 2 * 5
    assert df.agg(F.max("page")).first()[0] == 3


def fetch_failing(keyword, lo, hi, page, size):
    """The second page of keyword b always fails."""
    if keyword == "b" and page == 2:
        raise OSError("no answer")
    return fetch(keyword, lo, hi, page, size)


def test_paged_source_keeps_what_a_failing_loop_read(spark):
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged_api").options(fetch="tests.test_operators:fetch_failing", keywords='["a", "b"]', start="2026-01-01", end="2026-01-10", size="2", wait="0").load()
    got = df.groupBy("keyword").agg(F.count("item"), F.count("error"), F.max("error")).orderBy("keyword")
    assert [tuple(r) for r in got.collect()] == [("a", 10, 0, None), ("b", 4, 2, "OSError: no answer")]


def test_paged_source_asks_only_for_wanted_keywords(spark):
    reader = paged.PushedReader({"keywords": '["a", "b", "c"]', "start": "2026-01-01", "end": "2026-01-03"})
    other = EqualTo(("page",), 1)
    assert list(reader.pushFilters([In(("keyword",), ("a", "c")), other, EqualTo(("keyword",), "c")])) == [other]
    assert [p.keyword for p in reader.partitions()] == ["c"]
    spark.dataSource.register(paged.PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("paged_api").options(fetch="tests.test_operators:fetch", keywords='["a", "b"]', start="2026-01-01", end="2026-01-10", size="2", push="true").load()
        assert df.where("keyword = 'a' and page = 1").count() == 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_site_configs_and_list_pages(spark, tmp_path):
    (tmp_path / "sites.json").write_text(json.dumps([{"source_key": "a", "list_url": "http://a/list", "pagination": "?p={page}", "max_pages": 2}, {"source_key": "b", "list_url": "http://b/", "max_pages": 5}, {"name": "no key"}]))
    sites = feeds.site_configs(spark, str(tmp_path / "sites.json"))
    assert {r["encoding"] for r in sites.collect()} == {"utf-8"}
    assert rows(feeds.list_pages(sites).orderBy("source_key", "page")) == [("a", 1, "http://a/list?p=1"), ("a", 2, "http://a/list?p=2"), ("b", 1, "http://b/")]


def test_landed_json_and_xml(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"response": {"body": {"items": [{"no": "1", "nm": "T", "dt": "20260301"}, {"no": "2", "nm": "", "dt": ""}, {"no": "3", "nm": "U", "dt": "20200101"}]}}}))
    items = feeds.json_items(spark, str(tmp_path / "a.json"), "response.body.items", "no: string, nm: string, dt: string")
    cols = {"bid_no": F.col("no"), "title": F.col("nm"), "start_date": F.col("dt")}
    got = feeds.notices(items, "s", cols, F.lit("2026-03-10 00:00:00"), since_days=30)
    assert rows(got.select("bid_no", "start_date", "status")) == [("1", "2026-03-01", "ongoing")]
    (tmp_path / "a.xml").write_text("<r><item><title>x</title></item><item><title>y</title></item></r>")
    assert feeds.xml_items(spark, str(tmp_path / "a.xml"), "title string").count() == 2


def test_html_list(spark):
    html = "<ul><li><a href='/1'>First</a><i>2026.03.02</i></li><li><a href='/1'>First</a><i>2026.03.02</i></li><li><a href='/2'>Second</a><i>-</i></li></ul>"
    pages = spark.createDataFrame([("k", 1, html)], "source_key string, page int, html string")
    sites = spark.createDataFrame([("k", "http://h/list", "(?s)<li>(.*?)</li>", "<a[^>]*>([^<]*)", "href='([^']*)'", "<i>([^<]*)", "", True)], "source_key string, list_url string, row_pattern string, title_pattern string, link_pattern string, date_pattern string, link_base string, require_date boolean")
    assert rows(feeds.html_list(pages, sites, F.lit("2026-03-01")).select("title", "url", "start_date")) == [("First", "http://h/1", "2026-03-02")]


def test_stream_upsert(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([(1, "a", 1)], [(1, "b", 2), (2, "c", 2)]):
        spark.createDataFrame(batch, "id int, t string, at int").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id int, t string, at int").parquet(src)
        streams.upsert_stream(stream, out, ["id"], "at", str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(out).select("id", "t")) == [(1, "b"), (2, "c")]


def test_constant_proposal_aligns(spark):
    docs = spark.createDataFrame([(1, _PROPOSAL), (2, "목차 없음"), (3, "")], "doc_id long, text string")
    got = [tuple(r)[1:] for r in documents.aligned(docs, documents.contents(docs)).orderBy("position").collect()]
    assert got == [(0, 1, 2, 3, "strict"), (1, 2, 3, 6, "strict"), (2, 2, 6, 8, "strict"), (3, 1, 8, 9, "strict"), (4, 2, 9, 11, "strict"), (5, 1, None, None, "missed")]


class FakeFs:
    """A file system whose renames may say false."""

    def __init__(self, paths, refused):
        self.paths, self.refused = dict(paths), refused

    def exists(self, p):
        return p in self.paths

    def delete(self, p, _):
        self.paths.pop(p, None)

    def rename(self, a, b):
        if (a, b) in self.refused or a not in self.paths:
            return False
        self.paths[b] = self.paths.pop(a)
        return True


@pytest.mark.parametrize("refused", [[("live", "old")], [("new", "live")], [("new", "live"), ("old", "live")]])
def test_a_failed_rename_loses_nothing(refused):
    fs = FakeFs({"live": 1, "new": 2}, refused)
    with pytest.raises(OSError):
        merge.swap(fs, "new", "old", "live")
    assert fs.paths["old" if len(refused) == 2 else "live"] == 1 and fs.paths["new"] == 2
    fs.refused = []
    merge.swap(fs, "new", "old", "live")
    assert fs.paths == {"live": 2}
