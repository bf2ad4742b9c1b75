"""Workbooks (xlsx): a task for each sheet of a file, rows streamed from its XML.

Files come as bytes (``binaryFile``), so they may be in any store that Spark reads.  A
workbook's list of sheets and a sheet's own XML are read from the archive as they are
needed; the shared strings are read once for a sheet, the rows as they are parsed.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROWS = "path string, sheet int, name string, n int, cells array<string>, failure string"
BATCH = 5000


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets, in the order of their tabs, and where they are in the archive."""
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"]
    return [(e.get("name"), t.lstrip("/") if (t := targets[e.get(_REL)]).startswith("/") else f"xl/{t}") for e in sheets]


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out: list[str] = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _tag(e) == "si":
                out.append(_text(e))
                e.clear()
    return out


def _text(e) -> str:
    """Text of a string item: its runs, without phonetic hints."""
    if _tag(e) == "rPh":
        return ""
    return (e.text or "") if _tag(e) == "t" else "".join(_text(c) for c in e)


def column_of(reference: str) -> int:
    """0 for A1, 27 for AB7."""
    n = 0
    for c in re.match(r"[A-Z]*", reference.upper())[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(cell, strings: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(_text(c) for c in cell)
    value = next((c.text for c in cell if _tag(c) == "v"), None)
    if value is None:
        return None
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "n" and re.fullmatch(r"-?\d+\.0+", value):
        return value.split(".")[0]
    return value


def rows_of(content: bytes, sheet: int) -> Iterator[tuple[int, list[str | None]]]:
    """(number from 1, cells) of a sheet's rows; cells stand in their columns."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _strings(book)
        with book.open(sheets_of(book)[sheet][1]) as f:
            n = 0
            for _, e in ElementTree.iterparse(f):
                if _tag(e) != "row":
                    continue
                n = int(e.get("r", n + 1))
                cells: list[str | None] = []
                for c in e:
                    if _tag(c) == "c":
                        at = column_of(c.get("r", "")) if c.get("r") else len(cells)
                        cells += [None] * (at - len(cells)) + [_value(c, strings)]
                yield n, cells
                e.clear()


def _listing(parts):
    for pdf in parts:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    out += [(path, i, name, None) for i, (name, _) in enumerate(sheets_of(book))]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                out.append((path, -1, "", f"{type(error).__name__}: {error}"))
        yield pd.DataFrame(out, columns=["path", "sheet", "name", "failure"], dtype=object)


def _read(parts):
    for pdf in parts:
        for r in pdf.to_dict("records"):
            out: list[tuple] = []
            try:
                for n, cells in rows_of(r["content"], r["sheet"]) if r["sheet"] >= 0 else ():
                    out.append((r["path"], r["sheet"], r["name"], n, cells, None))
                    if len(out) >= BATCH:
                        yield _frame(out)
                        out = []
                if isinstance(r["failure"], str):
                    out.append((r["path"], r["sheet"], r["name"], None, None, r["failure"]))
            except (KeyError, IndexError, ValueError, ElementTree.ParseError, zipfile.BadZipFile) as error:
                out.append((r["path"], r["sheet"], r["name"], None, None, f"{type(error).__name__}: {error}"))
            yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _ROWS.split(", ")], dtype=object)


def workbook_rows(files: DataFrame, sheet: int | None = None) -> DataFrame:
    """path, sheet (from 0), name, n (from 1) and cells of all rows of files (path, content); a file or sheet that fails has one row with its failure.

    Files are listed first; each sheet is then a row of its own, dealt over the cluster.
    """
    listed = files.select("path", "content").mapInPandas(_listing, "path string, sheet int, name string, failure string")
    wanted = listed if sheet is None else listed.where(F.col("sheet").isin(sheet, -1))
    return files.select("path", "content").join(wanted.repartition("path", "sheet"), "path").mapInPandas(_read, _ROWS)


def organisations(rows: DataFrame, skip: int = 2) -> DataFrame:
    """name, category, page_category, url and is_active of a sheet (no, category, name, active, page category, url) after its headings; name and url must be there."""
    cell = lambda i: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    out = rows.where(F.col("failure").isNull() & (F.col("n") > skip))
    return out.select("n", cell(2).alias("name"), cell(1).alias("category"), cell(4).alias("page_category"), cell(5).alias("url"), (F.coalesce(F.get("cells", F.lit(3)), F.lit("")) == "O").cast("int").alias("is_active")).where("name is not null and url is not null")


def keyword_groups(rows: DataFrame, heading: int = 2, rest: Column | None = None) -> DataFrame:
    """n, keyword and keyword_group of a matrix whose row heading names the groups, from the second column on.

    A blank heading is named by its place, a keyword beyond the headings belongs to rest.
    """
    ok = rows.where("failure is null")
    names = ok.where(F.col("n") == heading).select("path", F.transform(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))), lambda c, i: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("group"), (i + 1).cast("string")))).alias("groups"))
    cells = ok.where(F.col("n") > heading).select("path", "n", F.posexplode(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))).alias("at", "keyword"))
    out = cells.join(names, "path", "left").withColumn("keyword", F.trim("keyword")).where(F.coalesce("keyword", F.lit("")) != "")
    return out.select("n", "keyword", F.coalesce(F.get("groups", F.col("at")), rest if rest is not None else F.lit("other")).alias("keyword_group"))
