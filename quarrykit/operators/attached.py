"""Files of a notice: links of pages whose layout is known, and which files are worth fetching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import markup, text
from quarrykit.operators import documents, ordered


@dataclass(frozen=True)
class Name:
    """Where a file's name stands: the link's own text, the title or text of the first element in the box that
    selector fits, or the text of the nearest such element beside the box before it; noise is cut off."""

    place: str  # own, inside, title or before
    selector: str = ""
    noise: str = ""


@dataclass(frozen=True)
class Layout:
    """How pages list their files.

    link selects links.  box selects what holds one link each (the first in it counts);
    with around it is instead what each link lies in, and without box the link itself.
    names are tried in turn; an empty or refused one passes to the next, and the last
    resort is the end of the link's path.
    """

    link: str
    names: tuple[Name, ...]
    box: str = ""
    around: bool = False
    refused: tuple[str, ...] = ()


# The three layouts of notice pages, with the words on their buttons.
LAYOUTS = {
    "button": Layout("a[href*='/afile/fileDownload/']", (Name("before", "a"),), "div.btn_wrap", True, ("바로보기", "다운로드")),
    "prefixed": Layout("a[href*='fileDown.download?uuid=']", (Name("own", noise=r"^_?첨부파일_?\s*"),)),
    "listed": Layout("a[href*='Download.do']", (Name("inside", "span.name", r"\s*\[[\d.]+ [KMG]?B\]\s*$"), Name("title", "a[title]", r"\s*새\s*창\s*열림\s*$")), "li", refused=("내려받기",)),
}
UNNAMED = "첨부파일"
PRIORITY = "제안요청 과업지시 사업안내 평가기준 입찰안내 제안안내 사업설명 공고문 심사기준 사업계획 과업내용 제안서작성 평가배점 제안평가 기술평가 입찰공고".split()


def _up(e: markup.Element, fits: set[int]) -> markup.Element | None:
    while e is not None and id(e) not in fits:
        e = e.parent
    return e


def _said(name: Name, link: markup.Element, box: markup.Element | None) -> str:
    if name.place == "own":
        found = link
    elif box is None:
        return ""
    elif name.place == "before":
        beside = [id(e) for e in markup.select(box.parent, name.selector)]
        near = [i for i in box.parent.items if isinstance(i, markup.Element)]
        near = near[: next(n for n, i in enumerate(near) if i is box)]
        found = next((i for i in reversed(near) if id(i) in beside), None)
    else:
        found = markup.select_one(box, name.selector)
    if found is None:
        return ""
    said = found.attrs.get("title", "") if name.place == "title" else "".join(found.strings())
    return re.sub(name.noise, "", said).strip() if name.noise else said.strip()


def linked(layout: Layout, page: str) -> Iterator[tuple[str, str]]:
    """(href, name, empty where none is said) of the files of a page, in page order."""
    root = markup.parsed(page)
    boxes = markup.select(root, layout.box) if layout.box else []
    if boxes and not layout.around:
        pairs = [(markup.select_one(b, layout.link), b) for b in boxes]
    elif layout.box and not layout.around:
        pairs = []
    else:
        fits = {id(b) for b in boxes}
        pairs = [(a, _up(a, fits) if layout.box else a) for a in markup.select(root, layout.link)]
    for link, box in pairs:
        if link is not None and link.attrs.get("href"):
            said = (_said(n, link, box) for n in layout.names)
            yield link.attrs["href"], next((s for s in said if s and s not in layout.refused), "")


def by_layout(pages: DataFrame, layout: Column, layouts: dict[str, Layout] = LAYOUTS, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, name, link of the files of pages, first of each link; pages without a known layout by the rules for any page.

    Links without a host are those of the page's host.  Pages without html have none.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.coalesce(html, F.lit("")).alias("_html"), layout.alias("_layout"))
    known = F.coalesce(F.col("_layout").isin(*layouts), F.lit(False))
    kind = dict(pages.select(key).dtypes)[key]

    def read(parts):
        for pdf in parts:
            out = [(k, u, n, *file) for k, u, h, name in zip(pdf["_key"], pdf["_url"], pdf["_html"], pdf["_layout"]) for n, file in enumerate(linked(layouts[name], h))]
            yield pd.DataFrame(out, columns=["_key", "_url", "n", "href", "said"], dtype=object)

    found = rows.where(known).mapInPandas(read, f"_key {kind}, _url string, n int, href string, said string")
    found = found.withColumn("link", text.absolute_url(F.regexp_extract(F.coalesce("_url", F.lit("")), "^[a-z]+://[^/?#]*", 0), F.col("href")))
    found = found.withColumn("name", F.when(F.col("said") != "", F.col("said")).otherwise(text.name_from_url(F.col("link"), UNNAMED)))
    found = ordered.first_seen(found, ["_key", "link"], ["n"]).select(F.col("_key").alias(key), "name", "link")
    rest = rows.where(~known).select(F.col("_key").alias(key), F.col("_url").alias("url"), F.col("_html").alias("html"))
    return found.unionByName(documents.attachments(rest, key))


def is_priority(name: Column, words: list[str] = PRIORITY) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(re.escape(w) for w in words)), F.lit(False)) if words else F.lit(False)


def worth_reading(files: DataFrame, priority: Column, key: str = "notice_id", order: str = "n", archive: str = "in_archive") -> DataFrame:
    """The readable files of each notice that an analysis takes.

    A row is a loose file or a member of the archive at place order.  Loose files: the
    priority ones, or all if there are none.  An archive: its priority members, or all of
    them if there are none and nothing came before, which is when the notice has no loose
    file and this is its first archive.  A notice's facts are aggregated and joined, so
    the files of a large one need not meet in one task.
    """
    rows = files.withColumns({"_inside": F.coalesce(archive, F.lit(False)), "_wanted": F.coalesce(priority, F.lit(False))})
    inside = F.col("_inside")
    own = rows.groupBy(key, order, "_inside").agg(F.bool_or("_wanted").alias("_some"))
    facts = own.groupBy(key).agg(
        F.coalesce(F.bool_or(~inside), F.lit(False)).alias("_loose"), F.coalesce(F.bool_or(F.col("_some") & ~inside), F.lit(False)).alias("_loose_some"), F.min(F.when(inside, F.col(order))).alias("_first")
    )
    plain = own.where(inside & ~F.col("_some")).select(F.col(key).alias("_k"), F.col(order).alias("_n"))
    facts = facts.join(plain, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_first") == F.col("_n")), "left").select(
        F.col(key).alias("_k"), "_loose", "_loose_some", F.when(~F.col("_loose") & F.col("_n").isNotNull(), F.col("_n")).alias("_all_of"))
    joined = rows.join(facts, F.col(key).eqNullSafe(F.col("_k")))
    keep = F.col("_wanted") | (~inside & ~F.col("_loose_some")) | (inside & F.coalesce(F.col(order) == F.col("_all_of"), F.lit(False)))
    return joined.where(keep).select(*files.columns)
