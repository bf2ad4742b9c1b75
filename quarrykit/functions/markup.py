"""A small element tree of a page, CSS selectors over it, and markdown of XHTML.

The tree is made by the standard library's streaming tokenizer.  Selectors are those
that list pages need: tags, ids, classes, attributes, positions, descendants, children
and alternatives.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements without an end tag; blocks, which end a paragraph; what an element's start ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li", ("ul", "ol", "menu")), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("td", ("tr", "table")), "dt": ("dd", ("dl",)), "dd": ("dd", ("dl",)), "option": ("option", ("select",))}
SAME = {"th": "td", "dt": "dd"}


class Element:
    __slots__ = ("attrs", "items", "parent", "place", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[Element | str] = []
        self.place = 0 if parent is None else sum(isinstance(i, Element) for i in parent.items) + 1

    def elements(self):
        """All elements below, in page order."""
        todo = [i for i in reversed(self.items) if isinstance(i, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [i for i in reversed(e.items) if isinstance(i, Element)]

    def strings(self):
        """Stripped pieces of text below, in page order, blank ones left out; scripts and styles have none."""
        todo: list[Element | str] = [self]
        while todo:
            i = todo.pop()
            if isinstance(i, Element):
                todo += [] if i.tag in ("script", "style") else reversed(i.items)
            elif i.strip():
                yield i.strip()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def _end(self, tags: tuple[str, ...], walls: tuple[str, ...]) -> None:
        e = self.at
        while e.parent is not None and e.tag not in walls:
            if SAME.get(e.tag, e.tag) in tags:
                self.at = e.parent
                return
            e = e.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end(("p",), ("td", "th", "table", "button"))
        if tag in ENDS:
            end, walls = ENDS[tag]
            self._end((end,), walls)
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self._add(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None:
            if e.tag == tag:
                self.at = e.parent
                return
            e = e.parent

    def handle_data(self, data):
        self._add(data)

    def _add(self, item):
        self.at.items.append(item)


def parsed(page: str) -> Element:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


# Selectors

_PART = re.compile(r"""(?P<tag>^[\w-]+|^\*)|\#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*["']?(?P<value>[^"'\]]*)["']?)?\s*\]|:(?P<pseudo>nth-child|nth-of-type|nth-last-child)\(\s*(?P<nth>[^)]+?)\s*\)|:(?P<plain>first-child|last-child|only-child|first-of-type|last-of-type)""")
_OPS = {"=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "^=": lambda a, v: bool(v) and a.startswith(v), "$=": lambda a, v: bool(v) and a.endswith(v), "*=": lambda a, v: bool(v) and v in a, "|=": lambda a, v: a == v or a.startswith(f"{v}-")}
_PLAIN = {"first-child": ("nth-child", "1"), "last-child": ("nth-last-child", "1"), "first-of-type": ("nth-of-type", "1")}


def _nth(rule: str) -> tuple[int, int]:
    """Step and offset of an an+b rule."""
    rule = {"odd": "2n+1", "even": "2n"}.get(rule.lower(), rule.lower()).replace(" ", "")
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", rule)
    if m is None:
        raise ValueError(f"position {rule!r}")
    if m[3]:
        return 0, int(m[3])
    return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)


def _place(e: Element, kind: str) -> int:
    if kind == "nth-child":
        return e.place
    near = [i for i in e.parent.items if isinstance(i, Element) and (kind == "nth-last-child" or i.tag == e.tag)]
    at = next(i for i, x in enumerate(near) if x is e)
    return len(near) - at if kind == "nth-last-child" else at + 1


def _tests(compound: str) -> list:
    out, at = [], 0
    while at < len(compound):
        m = _PART.match(compound, at) if at == 0 else _PART.match(" " + compound[at:], 1)
        if m is None or not m[0]:
            raise ValueError(f"selector part {compound[at:]!r}")
        at += len(m[0])
        if m["tag"]:
            out.append(lambda e, t=m["tag"].lower(): t in ("*", e.tag))
        elif m["id"]:
            out.append(lambda e, v=m["id"]: e.attrs.get("id") == v)
        elif m["class"]:
            out.append(lambda e, v=m["class"]: v in e.attrs.get("class", "").split())
        elif m["attr"]:
            name, test = m["attr"].lower(), _OPS.get(m["op"])
            out.append(lambda e, n=name, t=test, v=m["value"]: n in e.attrs and (t is None or t(e.attrs[n], v)))
        elif m["plain"] in ("only-child", "last-of-type"):
            alike = (lambda i, e: True) if m["plain"] == "only-child" else (lambda i, e: i.tag == e.tag)
            last = m["plain"] == "last-of-type"
            out.append(lambda e, a=alike, last=last: (near := [i for i in e.parent.items if isinstance(i, Element) and a(i, e)])[-1] is e and (last or len(near) == 1))
        else:
            kind, rule = (m["pseudo"], m["nth"]) if m["pseudo"] else _PLAIN[m["plain"]]
            a, b = _nth(rule)
            out.append(lambda e, k=kind, a=a, b=b: (_place(e, k) - b == 0) if a == 0 else (_place(e, k) - b) % a == 0 and (_place(e, k) - b) // a >= 0)
    return out


@lru_cache(1000)
def compiled(selector: str) -> list[list[tuple[str, list]]]:
    """Alternatives; each a list of (combinator before it, tests), last first."""
    out = []
    for one in selector.split(","):
        parts = re.sub(r"\s*>\s*", " > ", one.strip()).split()
        way, before = [], " "
        for part in parts:
            if part == ">":
                before = ">"
                continue
            way.append((before, _tests(part)))
            before = " "
        if not way:
            raise ValueError(f"selector {selector!r}")
        out.append(way[::-1])
    return out


def _fits(e: Element, way: list) -> bool:
    """Whether e is reached by the steps (last first)."""
    before, tests = way[0]
    if not all(t(e) for t in tests):
        return False
    if len(way) == 1:
        return True
    up = e.parent
    while up is not None and up.parent is not None:  # the root is no element
        if _fits(up, way[1:]):
            return True
        if before == ">":
            return False
        up = up.parent
    return False


def select(top: Element, selector: str) -> list[Element]:
    """Elements below top that an alternative of the selector fits, in page order; what is above top counts for its steps."""
    ways = compiled(selector)
    return [e for e in top.elements() if any(_fits(e, w) for w in ways)]


def select_one(top: Element, selector: str) -> Element | None:
    ways = compiled(selector)
    return next((e for e in top.elements() if any(_fits(e, w) for w in ways)), None)


# Markdown


def _table(table: Element) -> str:
    """A table in markdown: its own rows, cells with all of their text, those of nested tables too."""
    rows, todo = [], [i for i in reversed(table.items) if isinstance(i, Element)]
    while todo:
        e = todo.pop()
        if e.tag == "tr":
            rows.append([" ".join(c.strings()).replace("|", "\\|") for c in e.items if isinstance(c, Element) and c.tag in ("td", "th")])
        elif e.tag != "table":
            todo += [i for i in reversed(e.items) if isinstance(i, Element)]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join(cells + [""] * (width - len(cells))) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def markdown(page: str) -> str:
    """Paragraphs and tables in page order, parted by an empty line; tables hold what is inside them, once."""
    parts, todo = [], [parsed(page)]
    while todo:
        e = todo.pop()
        if e.tag in ("p", "table"):
            parts.append(_table(e) if e.tag == "table" else " ".join(e.strings()))
        else:
            todo += [i for i in reversed(e.items) if isinstance(i, Element) and i.tag not in ("head", "script", "style")]
    return "\n\n".join(p for p in parts if p)


@F.pandas_udf(StringType())
def xhtml_to_markdown(page: pd.Series) -> pd.Series:
    return page.map(markdown, na_action="ignore").astype(object)
