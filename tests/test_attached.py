"""Files by layout, files worth reading, and a paged source's own rules."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrykit.operators import attached
from quarrykit.sources import paged

BUTTON = """<ul><li><a href="/v/1">Call for plans.hwp</a><p>2 pages</p><div class="btn_wrap x"><a href="/view/1">바로보기</a><a href="/afile/fileDownload/A1">다운로드</a></div></li>
<li><a href=/v/2>다운로드</a><div class=btn_wrap><span><a href='/afile/fileDownload/%EA%B0%80.pdf'>다운로드</a></span></div></li><a href="/afile/fileDownload/A1">again</a><a href="/afile/fileDownload/">x</a></ul>"""
PREFIXED = "<a href='/cms/fileDown.download?uuid=1'>_첨부파일_ Plan &amp; rules.pdf</a><a href='fileDown.download?uuid=2'><b>첨부파일</b> </a><a href='/download?uuid=3'>no</a>"
LISTED = """<ul><li><div><span class="name a">[one]_form.zip  [209.4 KB]</span></div><a href="/x/Download.do?n=1">내려받기</a><a href="/x/Download.do?n=9">second</a></li>
<li><span class=name>내려받기</span><a title="Call.hwpx 새 창 열림" href=/view>바로보기</a><a href="/x/Download.do?n=2">내려받기</a></li><li><a href="/x/Download.do">내려받기</a></li><li><a href=/view>x</a></li></ul>"""


def test_layouts(spark):
    pages = [(1, "http://h.example/a/b?c", BUTTON, "button"), (2, "https://h.example", PREFIXED, "prefixed"), (3, "http://h.example/", LISTED, "listed"), (4, "http://h.example/d/", "<a href='f.pdf'>File (69KB)</a>", None), (5, "http://h.example/", None, "listed"), (None, None, LISTED, "listed"), (7, "http://h.example/d/", "<a href='f.pdf'>g</a>", "unheard of")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, layout string")
    got = {tuple(r) for r in attached.by_layout(df, F.col("layout")).collect()}
    host = "http://h.example"
    assert {r for r in got if r[0] is not None} == {
        (1, "Call for plans.hwp", f"{host}/afile/fileDownload/A1"), (1, "가.pdf", f"{host}/afile/fileDownload/%EA%B0%80.pdf"), (1, "첨부파일", f"{host}/afile/fileDownload/"),
        (2, "Plan & rules.pdf", "https://h.example/cms/fileDown.download?uuid=1"), (2, "fileDown.download", "https://h.example/fileDown.download?uuid=2"),
        (3, "[one]_form.zip", f"{host}/x/Download.do?n=1"), (3, "Call.hwpx", f"{host}/x/Download.do?n=2"), (3, "Download.do", f"{host}/x/Download.do"),
        (4, "File", f"{host}/d/f.pdf"), (7, "g", f"{host}/d/f.pdf"),
    }
    assert sorted(r[2] for r in got if r[0] is None) == ["/x/Download.do", "/x/Download.do?n=1", "/x/Download.do?n=2"]
    assert attached.by_layout(df.limit(0), F.col("layout")).collect() == []


def _worth(files: list[tuple]) -> list[tuple]:
    """One notice's files as they are met: loose ones, then archive by archive."""
    loose = [f for f in files if not f[2]]
    taken = [f for f in loose if f[3]] or loose
    for n in sorted({f[1] for f in files if f[2]}):
        members = [f for f in files if f[2] and f[1] == n]
        taken = taken + ([f for f in members if f[3]] or ([] if taken else members))
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_files_worth_reading_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    files = [(rng.choice([None, *range(60)]), rng.randint(0, 3), rng.random() < 0.7, rng.random() < 0.2, i) for i in range(260)]
    df = spark.createDataFrame(files, "notice_id int, n int, in_archive boolean, wanted boolean, id int")
    got = sorted(r["id"] for r in attached.worth_reading(df, F.col("wanted")).collect())
    assert got == sorted(f[4] for k in {f[0] for f in files} for f in _worth([f for f in files if f[0] == k]))
    assert attached.worth_reading(df.limit(0), F.col("wanted")).columns == df.columns


def test_priority_names(spark):
    df = spark.createDataFrame([("2026 제안요청서.hwp",), ("form.hwp",), (None,), ("",)], "name string")
    assert [r[0] for r in df.select(attached.is_priority(F.col("name"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(attached.is_priority(F.col("name"), [])).collect()] == [False] * 4


class Refused(OSError):
    def __init__(self, code: int):
        super().__init__(f"status {code}")
        self.code = code


def fetch_kinds(keyword, lo, hi, page, size, kind):
    """Seven items a loop; kind busy is refused twice with 429 before each page, kind broken fails on its second page, kind shut always with 429."""
    marks = Path(keyword)
    asked = marks.read_text().split() if marks.exists() else []
    marks.write_text(" ".join([*asked, f"{kind}{page}"]))
    if kind == "shut" or (kind == "busy" and asked.count(f"busy{page}") < 2):
        raise Refused(429)
    if kind == "broken" and page == 2:
        raise Refused(500)
    items = [{"no": f"{kind}-{i}", "old": i >= 4} for i in range(7)]
    return items[(page - 1) * size : page * size], len(items)


def has_old(items):
    return any(i["old"] for i in items)


def _asked(spark, keyword, **options):
    spark.dataSource.register(paged.PagedSource)
    common = {"fetch": "tests.test_attached:fetch_kinds", "keywords": f'["{keyword}"]', "start": "2026-01-01", "end": "2026-01-05", "size": "2", "wait": "0", "statuses": "[429]"}
    out = spark.read.format("paged_api").options(**common, **options).load().collect()
    marks = Path(keyword).read_text().split()
    return out, marks


def test_only_some_statuses_are_waited_for(spark, tmp_path):
    out, asked = _asked(spark, str(tmp_path / "a"), kinds='["busy"]')
    assert [(r["kind"], r["page"], r["error"]) for r in out] == [("busy", p, None) for p in (1, 1, 2, 2, 3, 3, 4)] and len(asked) == 12
    out, asked = _asked(spark, str(tmp_path / "b"), kinds='["broken"]')
    assert [(r["page"], r["error"]) for r in out] == [(1, None), (1, None), (2, "Refused: status 500")] and asked == ["broken1", "broken2"]
    out, asked = _asked(spark, str(tmp_path / "c"), kinds='["shut"]')
    assert [r["error"] for r in out] == ["Refused: status 429"] and asked == ["shut1"] * 3


def test_stop_rules(spark, tmp_path):
    out, _ = _asked(spark, str(tmp_path / "d"), kinds='["plain"]', pages="2")
    assert [r["page"] for r in out] == [1, 1, 2, 2]
    out, _ = _asked(spark, str(tmp_path / "e"), kinds='["plain"]', stop="tests.test_attached:has_old")
    assert [r["page"] for r in out] == [1, 1, 2, 2, 3, 3]
