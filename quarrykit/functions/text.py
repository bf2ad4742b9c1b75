"""Text helpers: HTML to text, names, lists, headings, tables."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references decoded (no built-in knows all of them)."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def absolute_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link)], dtype=object)


def unescape_basic(text: Column) -> Column:
    """The five references that escaping produces, in built-ins; & last."""
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return text


def escape_html(text: Column) -> Column:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(ref))
    return text


def breaks_to_lines(text: Column, decode=unescape) -> Column:
    """References decoded, the three literal <br> spellings made line feeds, trimmed; tags stay."""
    t = decode(F.coalesce(text, F.lit("")))
    for br in ("<br />", "<br/>", "<br>"):
        t = F.replace(t, F.lit(br), F.lit("\n"))
    return F.btrim(t, F.lit(" \t\n\r\x0b\x0c"))


def html_to_text(text: Column, decode=unescape) -> Column:
    """Breaks and paragraph ends to line feeds, tags dropped, runs of spaces and empty lines squeezed."""
    t = decode(F.coalesce(text, F.lit("")))
    for pattern, to in ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n"), (r"<[^>]+>", ""), ("&nbsp;", " "), (" +", " "), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, to)
    return F.btrim(t, F.lit(" \t\n\r\x0b\x0c"))


def search_text(*columns: Column | str) -> Column:
    """Lower-cased columns joined by a space; nulls are blank."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


def split_list(text: Column, by: str = ",") -> Column:
    """Parts of a delimited text, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), by), lambda x: F.trim(x)), lambda x: x != "")


def list_length(text: Column, by: str = ",") -> Column:
    return F.size(split_list(text, by))


def join_list(parts: Column, by: str = ",") -> Column:
    return F.array_join(parts, by)


def join_path(*parts: Column) -> Column:
    """Non-blank parts joined by ' > '."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " > ")


def last_of_path(path: Column) -> Column:
    """Last part of a ' > ' path; '' where there is no '>'."""
    return F.when(F.instr(path, ">") > 0, F.trim(F.element_at(F.split(path, ">"), -1))).otherwise(F.lit(""))


def first_filled(*columns: Column) -> Column:
    """First that is neither null nor blank, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def norm_key(text: Column) -> Column:
    """For comparing names: white space and ,.·-_()[] removed, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s,.·\-_()\[\]]+", ""))


def norm_heading(text: Column) -> Column:
    """For comparing headings: white space and ·.,() removed."""
    return F.regexp_replace(text, r"(?U)[·.,()\s]+", "")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def extension(name: Column) -> Column:
    """Lower-cased part after the last dot, '' if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def name_from_url(url: Column, default: str = "attachment") -> Column:
    """Percent-decoded last part of the path."""
    last = F.try_url_decode(F.replace(F.substring_index(F.try_parse_url(url, F.lit("PATH")), "/", -1), F.lit("+"), F.lit("%2B")))
    return F.coalesce(F.nullif(last, F.lit("")), F.lit(default))


def host_of(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def drop_size_suffix(name: Column) -> Column:
    """Without a trailing '(69KB)' or '[209.4 KB]'."""
    return F.trim(F.regexp_replace(name, r"\s*[(\[]\s*[\d.]+\s*[KMG]?B\s*[)\]]$", ""))


def first_url(text: Column) -> Column:
    return F.rtrim(F.regexp_extract(text, r"https?://[^\s<>\"']+", 0), F.lit(".)"))


def link_from_script(link: Column, pattern: str, template: str, groups: int = 1) -> Column:
    """A template's {id}, {1} ... filled from a script link; the link itself where it does not match."""
    filled = F.lit(template)
    for i in range(1, groups + 1):
        got = F.regexp_extract(link, pattern, i)
        filled = F.replace(filled, F.lit(f"{{{i}}}"), got)
        if i == 1:
            filled = F.replace(filled, F.lit("{id}"), got)
    return F.when(link.rlike(pattern), filled).otherwise(link)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def clip(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def line_of(text: Column, position: Column) -> Column:
    """0-based line of a 0-based character position."""
    head = F.substring(text, F.lit(1), F.greatest(position.cast("int"), F.lit(0)))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def table_to_markdown(rows: Column) -> Column:
    """array<array<string>> as a markdown table: short rows padded, line feeds to spaces, bars escaped."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(F.transform(F.sequence(F.lit(0), width - 1), lambda i: cell(F.get(r, i)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(F.size(body), F.lit(1)))), "\n")).otherwise(F.lit(""))


def tri_state(value: Column, yes: str = "yes", no: str = "no", unknown: str = "unknown") -> Column:
    return F.when(value.isNull(), F.lit(unknown)).when(value, F.lit(yes)).otherwise(F.lit(no))


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1048576, F.concat(F.format_number(n / 1024, 1), F.lit("KB"))).otherwise(F.concat(F.format_number(n / 1048576, 1), F.lit("MB")))
