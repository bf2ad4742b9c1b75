"""Selectors, configured sites, markdown of XHTML and workbooks."""

from __future__ import annotations

import io
import json
import random
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from quarrykit.functions import markup
from quarrykit.sources import sheets, sites

PAGE = """<body><div id=grid class='list big'><table><thead><tr><th>no</th></tr></thead><tbody>
<tr class="notice"><td>1<td class=subject><a href='/v?id=1' title="it's">First &amp; <b>one</b></a><td>2026.03.20
<tr><td>2</td><td><a href="javascript:show('a7', '9')" onclick="go('12')">Second</a></td><td><span>2026-03-01</span></td></tr>
<tr><td>3<td>no link<td>2026-03-25</table></div><ul><li>x<ul><li>y</ul><li>z</ul><p>a<p>b</body>"""


@pytest.mark.parametrize(
    "selector, want",
    [
        ("#grid td:first-child", ["1", "2", "3"]), ("td:nth-child(2) a", ["First &one", "Second"]), ("tr:nth-child(odd) > td:last-child", ["2026.03.20", "2026-03-25"]),
        ("div.list.big tbody tr.notice td.subject > a", ["First &one"]), ("body > ul > li", ["xy", "z"]), ("ul ul li, p", ["y", "a", "b"]), ("a[href^=javascript]", ["Second"]), ("a[title]", ["First &one"]),
        ("a[href$='1'], a[onclick*=\"12\"]", ["First &one", "Second"]), ("tr:nth-last-child(1) td:nth-of-type(2)", ["no link"]), ("td.nothing a", []), ("tr:nth-child(n+2) td:nth-child(-n+1)", ["2", "3"]), ("p:last-of-type", ["b"]), ("th:only-child", ["no"]),
    ],
)
def test_selectors(selector, want):
    assert ["".join(e.strings()) for e in markup.select(markup.parsed(PAGE), selector)] == want


@pytest.mark.parametrize("selector", ["", "a::b", "td:nth-child(x)", "a[", "a >"])
def test_selectors_that_cannot_be_read(selector):
    if selector == "a >":
        assert markup.select(markup.parsed(PAGE), selector)  # as "a"
    else:
        with pytest.raises(ValueError):
            markup.compiled(selector)


def test_deep_pages():
    assert len(markup.select(markup.parsed("<div>" * 3000 + "<a>x"), "div > a")) == 1


def site(**settings):
    return {"name": "Site", "source_key": "s", "list_url": "http://h.example/list", "date_selector": "td:last-child", "title_selector": "td a", **settings}


def landed(spark, pages):
    return spark.createDataFrame(pages, "source_key string, page int, html string")


def configured(spark, tmp_path, *rows):
    (tmp_path / "sites.json").write_text(json.dumps(rows))
    return sites.configs(spark, str(tmp_path / "sites.json"))


def test_all_settings_are_read(spark, tmp_path):
    s = configured(spark, tmp_path, site()).first()
    assert len(s) == 21 and s["list_selector"] == "table tbody tr" and s["max_pages"] == 3 and s["skip_no_date"] is True and s["post_data"] is None


def test_scraped_rows(spark, tmp_path):
    s = configured(spark, tmp_path, site(link_js_regex=r"show\('(\w+)', '(\d)'\)", link_template="http://x.example/{id}/{2}"), site(source_key="t", name="T", link_attr="onclick", link_js_regex=r"go\('(\d+)'\)", link_template="v/{1}", link_base="http://b.example/a/", grid_selector="#grid", skip_no_date=False))
    got = sites.scraped(landed(spark, [("s", 1, PAGE), ("s", 2, PAGE), ("t", 1, PAGE), ("nobody", 1, PAGE)]), s, F.lit("2026-03-26"), 30)
    assert sorted((r["source_key"], r["title"], r["start_date"], r["url"]) for r in got.collect()) == [
        ("s", "First &one", "2026-03-20", "http://h.example/v?id=1"), ("s", "Second", "2026-03-01", "http://x.example/a7/9"),
        ("t", "First &one", "2026-03-20", ""), ("t", "Second", "2026-03-01", "http://b.example/a/v/12"),
    ]
    assert all(r["bid_no"].startswith(f"SCR-{r['source_key']}-") and r["page"] == 1 for r in got.collect())


def test_pages_stop_as_a_visitor_would(spark, tmp_path):
    row = lambda t, d: f"<tr><td><a href='/{t}'>{t}</a></td><td>{d}</td></tr>"
    page = lambda *rows: f"<table><tbody>{''.join(rows)}</tbody></table>"
    new, old, none = "2026-03-20", "2025-01-01", "soon"
    pages = [("old", 1, page(row("a", new)), 200), ("old", 2, page(row("b", old), row("c", new)), 200), ("old", 3, page(row("d", new)), 200), ("empty", 1, page(row("e", new), row("f", none)), 200), ("empty", 2, page(), 200), ("empty", 3, page(row("g", new)), 200),
             ("failed", 1, page(row("h", new)), 200), ("failed", 2, page(row("i", new)), 500), ("failed", 3, page(row("j", new)), 200), ("bad", 1, page(row("k", new)), 200)]
    s = configured(spark, tmp_path, *[site(source_key=k, name=k) for k in ("old", "empty", "failed")], site(source_key="bad", name="bad", list_selector="tr:nth-child(x)"))
    df = spark.createDataFrame(pages, "source_key string, page int, html string, status int")
    assert sorted(r["title"] for r in sites.scraped(df, s, F.lit("2026-03-26")).collect()) == ["a", "c", "e", "h"]
    assert [r["source_key"] for r in sites.rows_of(df, s).where("failure is not null").collect()] == ["bad"]


def test_requests(spark, tmp_path):
    s = configured(spark, tmp_path, site(source_key="one"), site(source_key="get", pagination="?p={page}", max_pages=2), site(source_key="off", pagination="?o={offset}", offset_size=10, max_pages=3, session_init_url="http://h.example/"),
                   site(source_key="form", post_data={"q": "a b", "n": "0"}, page_param_key="n", max_pages=2), site(source_key="json", post_data={}, post_json=True, page_param_key="pageIndex", max_pages=1))
    got = {(r["source_key"], r["page"]): (r["method"], r["url"], r["body"], r["session_init_url"]) for r in sites.requests(s).collect()}
    u = "http://h.example/list"
    assert got == {
        ("one", 1): ("GET", u, None, None), ("get", 1): ("GET", u, None, None), ("get", 2): ("GET", f"{u}?p=2", None, None),
        ("off", 1): ("GET", u, None, "http://h.example/"), ("off", 2): ("GET", f"{u}?o=10", None, "http://h.example/"), ("off", 3): ("GET", f"{u}?o=20", None, "http://h.example/"),
        ("form", 1): ("POST", u, "n=1&q=a+b", None), ("form", 2): ("POST", u, "n=2&q=a+b", None), ("json", 1): ("POST", u, '{"pageIndex":"1"}', None),
    }


# Markdown


def plainly(root: ElementTree.Element) -> str:
    """Markdown of well-formed XHTML by looking at parents."""
    up = {c: p for p in root.iter() for c in p}
    words = lambda e: " ".join(t.strip() for t in e.itertext() if t.strip())

    def above(e):
        while (e := up.get(e)) is not None:
            yield e

    parts = []
    for e in root.iter():
        if e.tag not in ("p", "table") or any(a.tag in ("p", "table") for a in above(e)):
            continue
        if e.tag == "p":
            parts.append(words(e))
            continue
        rows = [[words(c).replace("|", "\\|") for c in tr if c.tag in ("td", "th")] for tr in e.iter("tr") if next(a for a in above(tr) if a.tag == "table") is e]
        rows = [r for r in rows if r]
        if rows:
            n = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (n - len(r))) + " |" for r in rows]
            parts.append("\n".join([lines[0], "| " + " | ".join(["---"] * n) + " |", *lines[1:]]))
    return "\n\n".join(p for p in parts if p)


def made(r: random.Random, depth: int = 0) -> str:
    word = lambda: escape(r.choice(["a", "b|c", "x & y", "é <1>", " ", "\n z "]))
    inline = lambda: "".join(r.choice([word(), f"<b>{word()}</b>", f"<span>{word()}<i>{word()}</i></span>"]) for _ in range(r.randrange(4)))
    kind = r.randrange(4 if depth < 3 else 2)
    if kind == 0:
        return f"<p>{inline()}</p>"
    if kind == 1:
        return f"<h2>{inline()}</h2>"
    if kind == 2:
        return "<div>" + "".join(made(r, depth + 1) for _ in range(r.randrange(4))) + "</div>"
    cell = lambda: r.choice([inline(), made(r, depth + 1)])
    rows = "".join("<tr>" + "".join(f"<{t}>{cell()}</{t}>" for t in r.choices(["td", "th"], k=r.randrange(4))) + "</tr>" for _ in range(r.randrange(4)))
    return f"<table>{f'<tbody>{rows}</tbody>' if r.random() < 0.5 else rows}</table>"


@pytest.mark.parametrize("seed", range(40))
def test_markdown_equals_a_plain_version(seed):
    r = random.Random(seed)
    page = "<html><head><title>t</title></head><body>" + "".join(made(r) for _ in range(6)) + "</body></html>"
    assert markup.markdown(page) == plainly(ElementTree.fromstring(page))


def test_markdown_of_odd_pages(spark):
    pages = [("<p>one<p>two <b>b</b><script>x</script><div>no</div>", "one\n\ntwo b"), ("", ""), (None, None), ("<table></table>", ""), ("no tags", ""), ("<table><tr><td>a<td>b<tr><td>c</table>", "| a | b |\n| --- | --- |\n| c |  |")]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "i int, html string")
    assert [r["m"] for r in df.select("i", markup.xhtml_to_markdown(F.col("html")).alias("m")).orderBy("i").collect()] == [m for _, m in pages]


# Workbooks

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(*tabs: list[list]) -> bytes:
    """Cells: text (shared, or inline where it begins with '='), numbers, booleans, None (left out)."""
    shared: list[str] = []
    letters = lambda i: (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)

    def cell(v, at):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v}</v></c>'
        if v.startswith("="):
            return f'<c r="{at}" t="inlineStr"><is><t>{escape(v[1:])}</t></is></c>'
        shared.append(v)
        return f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, rows in enumerate(tabs):
            body = "".join(f'<row r="{i}">' + "".join(cell(v, f"{letters(j)}{i}") for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1) if r)
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {_NS}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f"<workbook {_NS}><sheets>" + "".join(f'<sheet name="tab {k}" sheetId="{k + 1}" r:id="x{k}"/>' for k in range(len(tabs))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="x{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(tabs))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>" + "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r><rPh><t>hint</t></rPh></si>" for s in shared) + "</sst>")
    return out.getvalue()


ORGS = [["Organisations"], ["no", "kind", "name", "on", "page", "url"], [1, "city", " Seoul & co ", "O", "bids", "http://s"], [2, None, "Off", "X", None, "=http://o"], [3, "x", None, "O", "p", "http://n"], [], [4, "x", "No url", "O"]]
WORDS = [["Keywords"], ["", "IT", None, "Events"], [1, "cloud", "x", None, "beyond"], [2, None, None, " fair "], [3.0, True, 2.5]]


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook(ORGS, WORDS))
    (tmp_path / "b.xlsx").write_bytes(b"no archive")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = sheets.workbook_rows(files).cache()
    assert [(r["sheet"], r["n"]) for r in rows.where("failure is null").orderBy("sheet", "n").collect()] == [(0, n) for n in (1, 2, 3, 4, 5, 7)] + [(1, n) for n in range(1, 6)]
    assert [r["failure"].split(":")[0] for r in rows.where("failure is not null").collect()] == ["BadZipFile"]
    got = sheets.organisations(rows.where("sheet = 0")).orderBy("n").collect()
    assert [tuple(r) for r in got] == [(3, "Seoul & co", "city", "bids", "http://s", 1), (4, "Off", None, None, "http://o", 0)]
    got = sheets.keyword_groups(rows.where("sheet = 1")).collect()
    assert sorted(tuple(r) for r in got) == [(3, "beyond", "other"), (3, "cloud", "IT"), (3, "x", "group2"), (4, "fair", "Events"), (5, "2.5", "group2"), (5, "true", "IT")]
    assert sheets.workbook_rows(files, sheet=1).where("failure is null").select("name").distinct().collect() == [("tab 1",)]


def test_columns_of_references():
    assert [sheets.column_of(x) for x in ("A1", "Z9", "AA1", "AB7", "BA3")] == [0, 25, 26, 27, 52]


def test_pages_are_parsed_a_piece_at_a_time(spark, monkeypatch):
    """A task's Python objects are those of a piece of a batch: the rows are the same however small it is."""
    monkeypatch.setattr(sites, "pieces", lambda found: (p.slice(k, 1) for p in found for k in range(p.num_rows)))
    pages = spark.createDataFrame([("k", i, f"<ul><li><a href='/{i}'>t{i}</a></li></ul>" * (i % 3)) for i in range(40)] + [("k", 99, None)], "source_key string, page long, html string")
    own = sites.with_defaults(spark.createDataFrame([("k", "k", "http://k/", "li", "a")], "source_key string, name string, list_url string, list_selector string, title_selector string"))
    asked = [(r["page"], r["n"], r["title"], r["link"]) for r in sites.rows_of(pages, own).collect()]
    want = [(i, n, f"t{i}", f"/{i}") for i in range(40) for n in range(i % 3)] + [(i, -1, "", "") for i in [*range(0, 40, 3), 99]]
    assert sorted(asked) == sorted(want)
