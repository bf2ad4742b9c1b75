"""Long documents: sections, tables of contents, hints, attachments, office files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, StringType, StructField, StructType

from quarrykit.functions import text
from quarrykit.functions.batches import pieces
from quarrykit.operators import ordered

# Heading, anchor and number patterns of the documents; section names to skip.
ROMAN = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ"
TOP_HEADING = rf"^([{ROMAN}])\.\s+(.+)$"
MID_HEADING = r"^([1-9])\s+([가-힣][가-힣\s·/]+)$"
ANCHOR = r"목\s*차|차\s*례|CONTENTS|Contents|목\s*록"
CERTIFICATE_NUMBER = r"(?U)제\s*[\w\d*\-]+\s*호"
CERTIFICATE_WORDS = ("인증", "등록", "확인서", "Main-Biz", "메인비즈", "벤처기업")
SKIPPED_SECTIONS = ("사업의 필요성", "사업필요성", "추진배경", "사업목표", "사업목적", "기대효과", "파급효과", "제안개요")
DECORATION = "▸▶▼▽◇◆◈○●◎◦ㅇ★☆♦♠♣♥〒〓→←↑↓⇒⇐⇑⇓"
FILE_LINK = r"(?i)\.(?:pdf|hwp|hwpx|docx?|xlsx?|pptx?|zip|rar|7z|alz|egg)(?:\?|$|#|&)"
DOWNLOAD_LINK = r"(?i)(?:download|fileDown|attachDown|getFile|file_download|dnFile|atchFileDown)"
IMAGE_LINK = r"(?i)\.(?:jpg|jpeg|png|gif|bmp|svg|ico)(?:\?|$)"
PARSEABLE = ("pdf", "hwpx", "docx", "hwp", "zip")


def _parsed(kind: str):
    return StructType.fromDDL(f"x {kind}")[0].dataType


def lines(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, line number from 0, raw line, trimmed line."""
    return docs.select(key, F.posexplode(F.split(column, "\n")).alias("line", "raw")).withColumn("stripped", F.btrim("raw", F.lit(" \t\r\x0b\x0c")))


def sections(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, name, start, end, text of the middle-level sections of a document.

    A table line (starting with a bar) is never a heading and stays in the body;
    text before the first middle heading, and after a top heading until the next
    one, is dropped; a section without a line is none.
    """
    rows = lines(docs, key, column)
    table = F.startswith("stripped", F.lit("|"))
    top = ~table & F.col("stripped").rlike(TOP_HEADING)
    mid = ~table & ~top & F.col("stripped").rlike("(?U)" + MID_HEADING)
    rows = rows.withColumns({"top": F.when(top, F.regexp_extract("stripped", TOP_HEADING, 1)), "is_mid": mid, "opens": top | mid})
    rows = ordered.carried(rows, [key], "line", "top", "roman")
    rows = ordered.numbered_groups(rows, [key], "line", F.col("opens"))
    body = rows.groupBy(key, "group").agg(
        F.max(F.when(F.col("is_mid"), F.struct("line", "stripped", "roman"))).alias("head"), F.max("line").alias("last"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("line", "raw")))), lambda x: x["raw"]).alias("body"),
    )
    kept = body.where(F.col("head").isNotNull() & (F.size("body") > 0))
    title = F.trim(F.regexp_extract("head.stripped", "(?U)" + MID_HEADING, 2))
    name = F.concat(F.coalesce("head.roman", F.lit("")), F.lit("."), F.regexp_extract("head.stripped", "(?U)" + MID_HEADING, 1), F.lit(" "), title)
    total = docs.select(key, F.size(F.split(column, "\n")).alias("total"))
    out = kept.select(key, name.alias("name"), F.col("head.line").alias("start"), F.btrim(F.array_join("body", "\n"), F.lit(" \t\n\r")).alias("text")).join(total, key)
    return ordered.section_ends(out, [key], "start", "total").select(key, "name", "start", "end", "text")


def wanted_sections(rows: DataFrame, words: tuple[str, ...] = SKIPPED_SECTIONS) -> DataFrame:
    return rows.where(~F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("name"), w)))


def hints(docs: DataFrame, key: str = "doc_id", column: str = "text", most: int = 20) -> DataFrame:
    """Numbered certificates and registrations: key, line, name (120 letters), year; distinct by their first 100."""
    rows = lines(docs, key, column)
    named = F.exists(F.array(*[F.lit(w) for w in CERTIFICATE_WORDS]), lambda w: F.contains(F.col("stripped"), w))
    rows = rows.where((F.col("stripped") != "") & (F.length("stripped") <= 250) & ~F.startswith("stripped", F.lit("|")) & F.col("stripped").rlike(CERTIFICATE_NUMBER) & named)
    rows = ordered.first_seen(rows.withColumn("_k", F.substring("stripped", 1, 100)), [key, "_k"], ["line"])
    rows = ordered.top_k(rows, [key], ["line"], most)
    year = F.nullif(F.regexp_extract("stripped", r"(20\d{2})\s*년", 1), F.lit("")).cast("int")
    return rows.select(key, "line", F.substring("stripped", 1, 120).alias("name"), year.alias("year"))


def line_classes(stripped: Column) -> Column:
    """One of seven classes of a line, the first that fits."""
    return (
        F.when(stripped.rlike(TOP_HEADING), "roman_top").when(stripped.rlike(r"^\d+-\d+\)?\s"), "num_nested").when(stripped.rlike(r"^\d+\.\s"), "num_dot")
        .when(stripped.rlike("(?U)" + MID_HEADING), "num_space").when(stripped.rlike(r"^제\s*\d+\s*[장절]"), "chapter").when(stripped.rlike("^#"), "hash").when(F.startswith(stripped, F.lit("|")), "table")
    )


ENTRY = "struct<marker: string, title: string, page: int, level: int, position: int>"
_ENTRIES = pa.list_(pa.struct([("marker", pa.string()), ("title", pa.string()), ("page", pa.int32()), ("level", pa.int32()), ("position", pa.int32())]))


def _entries(region: str, strict_sub: bool) -> list[tuple]:
    """Marker, title and page of the entries of a table of contents.

    Tokens are trimmed of brackets, which costs third-level markers their ')';
    strict_sub keeps it there.
    """
    found, marker, title = [], None, []
    for token in region.split():
        bare = token.strip("<>·«»〈〉" if strict_sub and re.fullmatch(r"\d{1,2}-\d{1,2}\)", token) else "<>·«»()〈〉")
        level = 1 if re.fullmatch(rf"[{ROMAN}]\.", bare) else 2 if re.fullmatch(r"\d{1,2}\.", bare) else 3 if re.fullmatch(r"\d{1,2}-\d{1,2}\)", bare) else 0
        if level:
            marker, title = (bare, level), []
        elif bare and marker and re.fullmatch(r"\d{1,3}", bare):
            if title:
                if len(title) <= 10 and not set(DECORATION) & set("".join(title)):
                    found.append((marker[0], " ".join(title), int(bare), marker[1]))
                marker = None
        elif bare and marker and bare != "|" and set(bare) != {"-"}:
            title.append(bare)
    out, falls = found[:1], 0
    for before, now in zip(found, found[1:]):
        falls = falls + 1 if now[2] < before[2] - 5 else 0
        if falls == 2:
            break
        out.append(now)
    one = {(m, t, p): (m, t, p, lv) for m, t, p, lv in reversed(out)}
    return [(*e, i) for i, e in enumerate(sorted(one.values(), key=out.index))]


def contents(docs: DataFrame, key: str = "doc_id", column: str = "text", head: int = 8000, span: int = 4000, strict_sub: bool = False) -> DataFrame:
    """key, found, anchor_line, body_start and entries of each document's table of contents."""
    start = F.regexp_instr(F.substring(column, 1, head), F.lit(ANCHOR))
    anchor = F.regexp_extract(F.substring(column, 1, head), ANCHOR, 0)

    def parse(batches):
        for part in pieces(batches):
            found = [[dict(zip(("marker", "title", "page", "level", "position"), e)) for e in _entries(r or "", strict_sub)] for r in part.column("_r").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(key), part.column("anchor_line"), pa.array(found, _ENTRIES)], [key, "anchor_line", "entries"])

    region = F.substring(F.substring(column, 1, head), start + F.length(anchor), F.lit(span))
    rows = docs.select(key, F.when(start > 0, text.line_of(F.col(column), start - 1)).alias("anchor_line"), F.when(start > 0, region).otherwise("").alias("_r"))
    rows = rows.mapInArrow(parse, StructType([*rows.drop("_r").schema, StructField("entries", _parsed(f"array<{ENTRY}>"))]))
    return rows.select(key, (F.size("entries") > 0).alias("found"), "anchor_line", (F.col("anchor_line") + 1).alias("body_start"), "entries")


MATCH = "struct<position: int, level: int, start: int, mode: string>"


def _marked(line: str, marker: str, level: int) -> bool:
    if level == 1:
        return line[0] in ROMAN
    if level == 2:
        return re.match(rf"\.?{re.escape(marker.rstrip('.'))}\b", line) is not None
    return line.startswith(marker) or re.match(r"\d+[-.]", line) is not None


def _aligned(body: list[str], entries, start: int) -> list[tuple]:
    """First line at or after the cursor for each entry; the cursor moves past each hit."""
    bare = lambda s: re.sub(r"[·.,()\s]+", "", s)
    usable = [(i, s, bare(s)) for i, s in enumerate(x.strip() for x in body) if s and s[0] != "|" and len(s) <= 200]
    out = []
    for e in entries:
        want, marker, level = bare(e["title"]), re.escape(e["marker"].rstrip(".")), e["level"]
        exact = {1: rf"{marker}\s*\.\s*", 2: rf"{marker}\s*\.?\s+", 3: rf"(?:{re.escape(e['marker'])}\s+)?"}[level] + re.escape(e["title"]) + r"\s*"
        hit, mode = -1, "missed"
        for i, s, b in usable:
            if i < start or not want:
                continue
            if re.fullmatch(exact, s):
                hit, mode = i, "strict"
                break
            if want in b and len(s) <= 80 and _marked(s, e["marker"], level):
                hit, mode = i, "relaxed"
                break
        words = e["title"].split()[:3]
        if hit < 0 and want and len(words) >= 2:
            prefix = bare(" ".join(words))
            hit = next((i for i, s, b in usable if start <= i < start + 500 and prefix in b and _marked(s, e["marker"], level)), -1)
            mode = "approx" if hit >= 0 else mode
        out.append((e["position"], level, hit if hit >= 0 else None, mode))
        start = hit + 1 if hit >= 0 else start
    return out


def aligned(docs: DataFrame, found: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, position, level, start, end, mode of each entry; end is the next matched start."""

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def match(batches):
        for part in pieces(batches):
            each = [_aligned((t or "").split("\n"), e, int(s)) for t, e, s in zip(*(part.column(c).to_pylist() for c in ("_text", "entries", "body_start")))]
            of = pa.array([i for i, found in enumerate(each) for _ in found], pa.int32())
            made = [pa.array([m[k] for found in each for m in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(key).take(of), part.column("total").take(of), *made], [key, "total", "position", "level", "start", "mode"])

    rows = docs.select(key, F.col(column).alias("_text"), F.size(F.split(column, "\n")).alias("total")).join(found.where("found").select(key, "entries", "body_start"), key)
    out = rows.mapInArrow(match, StructType([*rows.select(key, "total").schema, *_parsed(MATCH).fields]))
    out = ordered.next_present(out, [key], "position", "start")
    return out.select(key, "position", "level", "start", F.when(F.col("start").isNotNull(), F.coalesce("next", "total")).alias("end"), "mode")


def section_names(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, position, level and display name of each entry; below the top the name opens with the last roman numeral before it."""
    rows = entries.select(key, F.explode("entries").alias("e")).select(key, "e.*")
    rows = ordered.carried(rows.withColumn("_top", F.when(F.col("level") == 1, F.regexp_extract("marker", f"[{ROMAN}]", 0))), [key], "position", "_top", "_roman")
    marker = F.when(F.col("level") == 2, F.regexp_replace("marker", r"\.+$", "")).otherwise(F.col("marker"))
    name = F.when(F.col("level") == 1, F.concat_ws(" ", "marker", "title")).otherwise(F.concat(F.coalesce("_roman", F.lit("")), F.lit("."), marker, F.lit(" "), F.col("title")))
    return rows.select(key, "position", "level", F.trim(name).alias("name"))


def diagnosis(files: DataFrame, key: str = "file") -> DataFrame:
    """A row per parsed file (key, success, text): sizes, sections, wanted ones, contents found, and its status."""
    docs = files.select(key, "text")
    found = sections(docs, key)
    counts = found.groupBy(key).agg(F.count("*").alias("sections")).join(wanted_sections(found).groupBy(key).agg(F.count("*").alias("targets")), key, "left")
    anchor = contents(docs, key).select(key, F.col("anchor_line").isNotNull().alias("has_contents"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = files.join(counts, key, "left").join(anchor, key, "left").select(
        key, F.coalesce("success", F.lit(False)).alias("success"), zero(F.length("text")).alias("text_len"), F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).alias("line_count"),
        zero("sections").alias("sections"), zero("targets").alias("targets"), F.coalesce("has_contents", F.lit(False)).alias("has_contents"),
    )
    return out.withColumns({"silent_fail": F.col("success") & (F.col("sections") == 0), "status": file_status(F.col("success"), F.col("sections"))})


def file_status(success: Column, n_sections: Column) -> Column:
    return F.when(~success, "PARSE_FAIL").when(n_sections > 0, "ok").otherwise("no_sections")


def run_status(success: Column, has_dump: Column, found: Column) -> Column:
    """How far a contents run came."""
    return F.when(~success, "parse_fail").when(~has_dump, "no_dump").when(~found, "toc_not_found").otherwise("ok")


def diagnosis_summary(rows: DataFrame) -> DataFrame:
    """One row: files, parsed, silent failures, contents found."""
    return rows.agg(F.count("*").alias("files"), F.count_if("success").alias("parsed"), F.count_if("silent_fail").alias("silent"), F.count_if("has_contents").alias("with_contents"))


def rates_by_mode(matches: DataFrame) -> DataFrame:
    """Entries by level and mode."""
    return matches.groupBy("level", "mode").agg(F.count("*").alias("n"))


# The two named download calls of notice boards, and where their files lie.
CALL_TWO = r"fncFileDownload\s*\(\s*'([^']+)'\s*,\s*'([^']+)'\s*\)"
CALL_ID = r"fileDown\s*\(\s*'(\d+)'\s*\)"
CALL_FILE = r"(?i)['\"]([^'\"]+\.(?:pdf|hwp|hwpx|docx?|xlsx?|pptx?|zip))['\"]"
PATH_TWO, PATH_ID, NAME_ID = "/inc/download.asp?cate=", "/home/board/fileDown.do?file_no=", "첨부파일_"


def script_link(href: Column, base: Column, page: Column) -> Column:
    """struct(name, link) of a script call that downloads a file, null for others; the first pattern that fits."""
    kind, file, number, any_file = (F.regexp_extract(href, p, g) for p, g in ((CALL_TWO, 1), (CALL_TWO, 2), (CALL_ID, 1), (CALL_FILE, 1)))
    made = lambda name, link: F.struct(name.alias("name"), link.alias("link"))
    return (
        F.when(file != "", made(file, F.concat(base, F.lit(PATH_TWO), kind, F.lit("&fname="), file)))
        .when(number != "", made(F.concat(F.lit(NAME_ID), number), F.concat(base, F.lit(PATH_ID), number)))
        .when(F.startswith(any_file, F.lit("http")), made(F.substring_index(any_file, "/", -1), any_file))
        .when(any_file != "", made(any_file, text.absolute_url(page, any_file)))
    )


def match_rates(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    return matches.groupBy(key).agg(F.count("*").alias("entries"), F.count("start").alias("hits"), F.round(F.count("start") / F.count("*"), 3).alias("rate"))


def attachments(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, name, link of the file links of a page, first of each link."""
    anchors = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*(?:"[^"]*"|'[^']*')[^>]*>.*?</a>"""), F.lit(0))
    rows = pages.select(key, F.col(url).alias("_page"), F.posexplode(anchors).alias("n", "a"))
    quoted = [F.regexp_extract("a", rf"(?is)^<a\s[^>]*?href\s*=\s*{q}([^{q}]*){q}", 1) for q in ('"', "'")]
    href = text.unescape(F.trim(F.concat(*quoted)))
    label = F.trim(F.regexp_replace(text.unescape(F.regexp_replace("a", r"(?s)<[^>]+>", "")), r"\s+", " "))
    rows = rows.withColumns({"_href": href, "_label": label}).where(~F.startswith("_href", F.lit("#")) & (F.col("_href").rlike(FILE_LINK) | F.col("_href").rlike(DOWNLOAD_LINK)))
    call = F.when(F.startswith("_href", F.lit("javascript:")), F.coalesce(script_link(F.col("_href"), F.regexp_extract("_page", "^[a-z]+://[^/?#]*", 0), F.col("_page"))["link"], F.lit("")))
    target = F.coalesce(call, F.col("_href"))
    rows = rows.withColumn("link", F.when(call.isNotNull(), call).otherwise(text.absolute_url(F.col("_page"), target))).where((target != "") & ~F.col("link").rlike(IMAGE_LINK))
    name = F.when((F.col("_label") == "") | (F.length("_label") > 200), text.name_from_url(F.col("link"))).otherwise(F.col("_label"))
    return ordered.first_seen(rows.select(key, "n", text.drop_size_suffix(name).alias("name"), "link"), [key, "link"], ["n"]).select(key, "name", "link")


PARSED = StructType([StructField("success", BooleanType()), StructField("error", StringType()), StructField("format", StringType()), StructField("text", StringType())])
MEMBERS = ArrayType(StructType([StructField("name", StringType()), StructField("content", BinaryType())]))


def _cells(table, tag: str, cell: str) -> str:
    local = lambda n: n.tag.rpartition("}")[2]
    rows = [[" ".join("".join(c.itertext()).split()) for c in r if local(c) == cell] for r in table.iter() if local(r) == tag]
    width = max(map(len, rows), default=0)
    row = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r + [""] * (width - len(r))) + " |"
    return "\n".join([row(rows[0]), row(["---"] * width), *map(row, rows[1:])]) if width else ""


def _body(node, parts: list[str]) -> None:
    """Paragraphs and tables in order; both office formats name them p and tbl."""
    for child in node:
        kind = child.tag.rpartition("}")[2]
        if kind == "tbl":
            parts.append(_cells(child, "tr", "tc"))
        elif kind == "p":
            inner = [t for t in child.iter() if t.tag.rpartition("}")[2] == "tbl"]
            own = "".join(t.text or "" for t in child.iter() if t.tag.rpartition("}")[2] == "t" and not any(t in set(i.iter()) for i in inner))
            parts.append(own)
            parts.extend(_cells(t, "tr", "tc") for t in inner)
        else:
            _body(child, parts)


def _office(name: str, raw: bytes) -> dict:
    """Text of one file; what cannot be read is an error value, never an exception."""
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    try:
        if kind not in ("docx", "hwpx"):
            return {"success": False, "error": f"unsupported format: {kind}", "format": kind, "text": ""}
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            members = ["word/document.xml"] if kind == "docx" else sorted(n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n))
            parts: list[str] = []
            for m in members:
                _body(ElementTree.fromstring(z.read(m)), parts)
        return {"success": True, "error": None, "format": kind, "text": "\n".join(p for p in parts if p.strip())}
    except Exception as error:
        return {"success": False, "error": f"{type(error).__name__}: {error}"[:500], "format": kind, "text": ""}


@F.pandas_udf(PARSED)
def parsed_file(names: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_office(n or "", bytes(c or b"")) for n, c in zip(names, content)], columns=["success", "error", "format", "text"])


@F.pandas_udf(MEMBERS)
def zip_members(content: pd.Series) -> pd.Series:
    """Parseable members of an archive; an unreadable archive has none."""

    def members(raw) -> list[dict]:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                return [{"name": n, "content": z.read(n)} for n in sorted(z.namelist()) if n.rsplit(".", 1)[-1].lower() in PARSEABLE]
        except (zipfile.BadZipFile, TypeError):
            return []

    return content.map(members)


def chunks(docs: DataFrame, key: str = "doc_id", column: str = "text", size: int = 20_000) -> DataFrame:
    """Flat pieces of at most size characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(column) - 1, F.lit(0)), F.lit(size))
    return docs.select(key, F.posexplode(F.transform(starts, lambda s: F.substring(F.col(column), s + 1, F.lit(size)))).alias("n", "text"))
