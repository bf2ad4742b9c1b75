"""Document and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.functions import dates, text
from quarrykit.operators import claims, documents, ordered
from quarrykit.plans.registry import Registry, table

REGISTRY = query = Registry()
_LINES = "l AS (SELECT doc_id, unnest(range(len(x))) AS line, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


@query(f"""WITH {_LINES}, g AS (SELECT *, sum(CASE WHEN regexp_matches(raw, '^[A-Z][a-z]+[.]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS grp FROM l),
s AS (SELECT doc_id, grp, min(line) AS start, string_agg(raw, chr(10) ORDER BY line) AS body FROM g WHERE grp > 0 GROUP BY ALL), n AS (SELECT doc_id, count(*) AS total FROM l GROUP BY doc_id)
SELECT doc_id, grp::BIGINT AS grp, start::INT AS start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), total)::INT AS "end", md5(body) AS body FROM s JOIN n USING (doc_id)""")
def q_section_assembly(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = ordered.numbered_groups(documents.lines(docs), ["doc_id"], "line", F.col("raw").rlike("^[A-Z][a-z]+[.]$"), "grp")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n")
    out = rows.where("grp > 0").groupBy("doc_id", "grp").agg(F.min("line").alias("start"), F.md5(body.cast("binary")).alias("body"))
    total = docs.select("doc_id", F.size(F.split("text", "\n")).alias("total"))
    return ordered.section_ends(out.join(total, "doc_id"), ["doc_id"], "start", "total").drop("total")


@query(f"""WITH {_LINES} SELECT CASE WHEN raw = '' THEN 'blank' WHEN contains(raw, ' | ') THEN 'table' WHEN regexp_matches(raw, '^[A-Z][a-z]+[.]$') THEN 'heading' ELSE 'body' END AS class, count(*) AS n FROM l GROUP BY 1""")
def q_line_histogram(spark, sf_dir):
    raw = F.col("raw")
    kind = F.when(raw == "", "blank").when(F.contains(raw, F.lit(" | ")), "table").when(raw.rlike("^[A-Z][a-z]+[.]$"), "heading").otherwise("body")
    return documents.lines(table(spark, sf_dir, "documents")).groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(r"""WITH a AS (SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<br\s*/?>', chr(10), 'gi'), '</p>', chr(10), 'gi'), '<[^>]+>', '', 'g'), ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM a)
SELECT page_id, md5(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS digest FROM b""")
def q_clean_html_text(spark, sf_dir):
    plain = text.html_to_text(F.col("html"), text.unescape_basic)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(plain.cast("binary")).alias("digest"))


@query(r"""SELECT page_id, len(h)::INT AS n, array_to_string(h, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""")
def q_extract_links(spark, sf_dir):
    h = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(h).alias("n"), F.array_join(h, " ").alias("links"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^?#]*/([^/?#]*)', 1), ''), 'attachment') AS name,
CASE WHEN contains(regexp_extract(url, '^[a-z]+://[^?#]*/([^/?#]*)', 1), '.') THEN lower(regexp_extract(url, '\.([^./?#]*)(?:[?#].*)?$', 1)) ELSE '' END AS ext FROM pages""")
def q_url_parts(spark, sf_dir):
    name = text.name_from_url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.host_of(F.col("url")).alias("host"), name.alias("name"), text.extension(name).alias("ext"))


_DATES = ["20260301", "202603011400", "2026.03.01", "2026-03-01 09:00", "26-3-1", "2026년 3월 1일", "2026-13-45", "", "soon"]
_FOUND = {"20260301": ("2026-03-01", "2026-03-01"), "202603011400": ("2026-03-01", "2026-03-01"), "2026.03.01": ("2026-03-01", "2026-03-01"), "2026-03-01 09:00": ("2026-03-01", "2026-03-01"), "26-3-1": ("26-3-1", "2026-03-01"), "2026년 3월 1일": ("2026년 3월 1일", "2026-03-01"), "2026-13-45": ("2026-13-45", "2026-13-45"), "": ("", None), "soon": ("soon", None)}
_ROWS = ", ".join("('{}', '{}', {})".format(k, a, f"'{b}'" if b else "NULL") for k, (a, b) in _FOUND.items())


@query(f"SELECT * FROM (VALUES {_ROWS}) t(raw, normal, found)")
def q_format_date(spark, sf_dir):
    rows = spark.createDataFrame([(d,) for d in _DATES], "raw string")
    return rows.select("raw", dates.normalise_date(F.col("raw")).alias("normal"), dates.find_date(F.col("raw")).alias("found"))


@query("""SELECT doc_id, regexp_extract(text, '(?:^|[^0-9])([0-9]{8})', 1) AS digits FROM documents WHERE regexp_matches(text, '[0-9]{8}')""")
def q_digit_runs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]{8}")).select("doc_id", F.regexp_extract("text", "(?:^|[^0-9])([0-9]{8})", 1).alias("digits"))


@query(f"""WITH {_LINES} SELECT doc_id, line::INT AS line, raw[:120] AS name FROM l WHERE length(raw) <= 250 AND raw[1] <> '|' AND regexp_matches(raw, 'version [0-9]|Version [0-9]') AND (contains(raw, 'icense') OR contains(raw, 'GNU'))""")
def q_quant_hints(spark, sf_dir):
    """The hint filter on what the corpus has: numbered licence lines."""
    rows = documents.lines(table(spark, sf_dir, "documents"))
    named = F.contains("raw", F.lit("icense")) | F.contains("raw", F.lit("GNU"))
    return rows.where((F.length("raw") <= 250) & (F.substring("raw", 1, 1) != "|") & F.col("raw").rlike("version [0-9]|Version [0-9]") & named).select("doc_id", "line", F.substring("raw", 1, 120).alias("name"))


@query("SELECT doc_id, regexp_replace(lower(source || ' (' || lang || ') - ' || doc_id), '[ ,.·_()\\[\\]-]+', '', 'g') AS name, regexp_replace(source || '/' || lang || ' ' || doc_id || '.pdf', '[^A-Za-z0-9._-]', '_', 'g') AS file FROM documents")
def q_normalised_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit(" ("), "lang", F.lit(") - "), F.col("doc_id").cast("string"))
    return d.select("doc_id", text.norm_key(name).alias("name"), text.safe_name(F.concat("source", F.lit("/"), "lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("file"))


@query("SELECT nextval AS n, CASE nextval WHEN 1 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| x y | \\|z |' WHEN 2 THEN '| h |  |' || chr(10) || '| --- | --- |' || chr(10) || '|  | 1 |' ELSE '' END AS md FROM (SELECT unnest([1, 2, 3]) AS nextval)")
def q_attachment_table_md(spark, sf_dir):
    rows = spark.createDataFrame([(1, [["a", "b"], ["x\ny", "|z"]]), (2, [["h"], [None, "1"]]), (3, [])], "n int, t array<array<string>>")
    return rows.select("n", text.table_to_markdown(F.col("t")).alias("md"))


@query("""SELECT doc_id, array_to_string(list_filter(['enterprise', 'en', 'de', 'fr'], lambda v: v = lang), ',') AS exact, CASE WHEN lang IN ('en', 'de', 'fr') THEN lang ELSE '' END AS tags FROM documents""")
def q_tag_vocabulary(spark, sf_dir):
    vocab = ["de", "en", "fr"]
    t = claims.vocabulary_tags(F.array(F.concat("lang", F.lit("!")), "lang", F.lit(" ")), vocab)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang").isin(*vocab), F.col("lang")).otherwise("").alias("exact"), F.array_join(t, ",").alias("tags"))


def _statements(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("category"), F.substring_index("text", "\n", 1).alias("statement"))


@query()
def q_near_dup_pairs(spark, sf_dir):
    return claims.similar_pairs(_statements(spark, sf_dir), 0.85, 50)


@query()
def q_near_dup_distinct_pairs(spark, sf_dir):
    """The most similar pairs of different statements: each statement of a category once, by its first id."""
    rows = _statements(spark, sf_dir).groupBy("category", "statement").agg(F.min("id").alias("id"))
    return claims.similar_pairs(rows, 0.85, 50)


@query()
def q_greedy_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumns({"category": F.concat_ws("/", "source", "lang"), "statement": F.coalesce(F.substring_index("text", "\n", 1), F.lit(""))})
    rows = d.select(F.col("doc_id").alias("id"), "source", "category", "statement", F.array("lang").alias("tags"), F.array("source").alias("sections"), F.lit(0.9).alias("confidence"))
    return claims.greedy_merge(rows).select("category", "id", "source", "statement", "sections", "tags", "recurrence", "confidence")


@query("""WITH a AS (SELECT s_suppkey AS id, 'Supplier no ' || s_suppkey AS name FROM supplier), n AS (SELECT id, replace(lower(name), ' ', '') AS k FROM a)
SELECT a.id, EXISTS (SELECT 1 FROM n e WHERE e.id < 10 AND (e.k = replace(lower(a.name), ' ', '') OR contains(replace(lower(a.name), ' ', ''), e.k) OR contains(e.k, replace(lower(a.name), ' ', '')))) AS duplicate FROM a""")
def q_project_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Supplier no "), F.col("s_suppkey").cast("string")).alias("name"))
    known = F.array(*[F.lit(f"supplier-no. {i}") for i in range(10)])
    return rows.select("id", claims.known_project(F.col("name"), known).alias("duplicate"))


@query()
def q_fuzzy_line_dedup(spark, sf_dir):
    new = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("key"), F.col("text").alias("line"))
    old = table(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 5).alias("key")).agg(F.min("text").alias("existing"))
    return claims.known_lines(new, old, "key")


# A proposal for each document: its last section is headed as in the contents, with a
# remark, cut short or not at all, by the id.
_CONTENTS = "목차 Ⅰ. 제안 개요 1 1. 사업 이해 2 2. 추진 방향 5 Ⅱ. 수행 계획 7 1. 교육 운영 세부 안 8"
_HEADS = ("1 교육 운영 세부 안", "1. 교육 운영 세부 안 (요약)", "1 교육 운영 세부", "기타 내용")
_BODY = "표지 {0}|" + _CONTENTS + "|Ⅰ. 제안 개요|1 사업 이해|본문 {0}|\u2502 1 표|2 추진 방향|제 2020-{0}호 벤처기업 확인서 2020 년|Ⅱ. 수행 계획|{1}|마지막 {0}|제 3 장|# h|1-2) x"


def _proposals(spark, sf_dir):
    n, head = F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("doc_id") % 4 + 1).cast("int"))
    text_ = F.lit(_BODY.replace("|", "\n").replace("\u2502", "|"))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace(text_, F.lit("{0}"), n), F.lit("{1}"), head).alias("text"))


def _contents(docs):
    return documents.contents(docs, span=len(_CONTENTS))


_ENTRY_ROWS = "(VALUES (0, 1, 2, 3), (1, 2, 3, 6), (2, 2, 6, 8), (3, 1, 8, 9), (4, 2, 9, 14)) e(position, level, a, b)"
_MATCHES = f"""m AS (SELECT doc_id, position, level, CASE WHEN position = 4 AND doc_id % 4 = 3 THEN NULL ELSE a END AS start,
CASE WHEN doc_id % 4 = 3 AND position = 4 THEN NULL WHEN doc_id % 4 = 3 AND position = 3 THEN 14 ELSE b END AS "end", CASE WHEN position < 4 THEN 'strict' ELSE ['strict', 'relaxed', 'approx', 'missed'][1 + doc_id % 4] END AS mode FROM documents, {_ENTRY_ROWS})"""


@query(f"WITH {_MATCHES} SELECT * FROM m")
def q_toc_align(spark, sf_dir):
    docs = _proposals(spark, sf_dir)
    return documents.aligned(docs, _contents(docs))


@query(f"WITH {_MATCHES} SELECT doc_id, count(*) AS entries, count(start) AS hits, round(count(start) / count(*), 3) AS rate FROM m GROUP BY doc_id")
def q_toc_match_rates(spark, sf_dir):
    return documents.match_rates(q_toc_align(spark, sf_dir))


@query(f"WITH {_MATCHES} SELECT level, mode, count(*) AS n FROM m GROUP BY level, mode")
def q_toc_modes(spark, sf_dir):
    return documents.rates_by_mode(q_toc_align(spark, sf_dir))


@query("SELECT doc_id, position, level, name FROM documents, (VALUES (0, 1, 'Ⅰ. 제안 개요'), (1, 2, 'Ⅰ.1 사업 이해'), (2, 2, 'Ⅰ.2 추진 방향'), (3, 1, 'Ⅱ. 수행 계획'), (4, 2, 'Ⅱ.1 교육 운영 세부 안')) e(position, level, name)")
def q_section_names(spark, sf_dir):
    return documents.section_names(_contents(_proposals(spark, sf_dir)))


_TAIL = "|| chr(10) || '제 3 장' || chr(10) || '# h' || chr(10) || '1-2) x'"


@query(f"""SELECT doc_id, 'Ⅰ.1 사업 이해' AS name, 3 AS start, 6 AS "end", '본문 ' || doc_id || chr(10) || '| 1 표' AS text FROM documents
UNION ALL SELECT doc_id, 'Ⅰ.2 추진 방향', 6, CASE WHEN doc_id % 2 = 0 THEN 9 ELSE 14 END, '제 2020-' || doc_id || '호 벤처기업 확인서 2020 년' FROM documents
UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Ⅱ.1 교육 운영 세부 안' ELSE 'Ⅱ.1 교육 운영 세부' END, 9, 14, '마지막 ' || doc_id {_TAIL} FROM documents WHERE doc_id % 2 = 0""")
def q_proposal_sections(spark, sf_dir):
    return documents.wanted_sections(documents.sections(_proposals(spark, sf_dir)))


@query("SELECT doc_id, 7 AS line, '제 2020-' || doc_id || '호 벤처기업 확인서 2020 년' AS name, 2020 AS year FROM documents")
def q_certificate_hints(spark, sf_dir):
    return documents.hints(_proposals(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, unnest(['roman_top', 'num_space', 'table', 'num_space', 'roman_top', ['num_space', 'num_dot', 'num_space', NULL][1 + doc_id % 4], 'chapter', 'hash', 'num_nested', NULL, NULL, NULL, NULL, NULL]) AS class FROM documents)
SELECT class, count(*) AS n FROM d GROUP BY class""")
def q_line_classes(spark, sf_dir):
    return documents.lines(_proposals(spark, sf_dir)).groupBy(documents.line_classes(F.col("stripped")).alias("class")).agg(F.count("*").alias("n"))


def _files(spark, sf_dir):
    d = F.col("doc_id")
    return _proposals(spark, sf_dir).select(d.alias("file"), (d % 5 != 0).alias("success"), F.when(d % 7 == 0, "").otherwise(F.col("text")).alias("text"))


_DIAGNOSED = """g AS (SELECT doc_id AS file, doc_id % 5 <> 0 AS success, CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS sections, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 14 END AS line_count, doc_id % 7 <> 0 AS has_contents FROM documents),
f AS (SELECT *, success AND sections = 0 AS silent_fail FROM g)"""


@query(f"WITH {_DIAGNOSED} SELECT file, success, line_count, sections, sections AS targets, has_contents, silent_fail, CASE WHEN NOT success THEN 'PARSE_FAIL' WHEN sections > 0 THEN 'ok' ELSE 'no_sections' END AS status FROM f")
def q_file_diagnosis(spark, sf_dir):
    return documents.diagnosis(_files(spark, sf_dir)).drop("text_len")


@query(f"WITH {_DIAGNOSED} SELECT count(*) AS files, count(*) FILTER (success) AS parsed, count(*) FILTER (silent_fail) AS silent, count(*) FILTER (has_contents) AS with_contents FROM f")
def q_diagnosis_summary(spark, sf_dir):
    return documents.diagnosis_summary(documents.diagnosis(_files(spark, sf_dir)))


@query("""SELECT page_id, 'File ' || page_id AS name, 'http://h.kr/files/' || page_id || '.pdf' AS link FROM pages UNION ALL SELECT page_id, 'plan.hwp', 'http://h.kr/inc/download.asp?cate=bbs&fname=plan.hwp' FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'get', 'http://h.kr/download?id=' || page_id FROM pages""")
def q_page_attachments(spark, sf_dir):
    """File links of a page made for each id: a relative one, the same again, a script call, a download path, an image, a plain link."""
    n = F.col("page_id").cast("string")
    anchors = ["<a href='/files/%s.pdf'>File <b>%s</b> (69KB)</a>", "<a class=x href=\"http://h.kr/files/%s.pdf\">again %s</a>", "<a href='/download?id=%s'>get</a>", "<a href='/download/i%s.png'>i</a>", "<a href='/view?n=%s'>v</a>"]
    parts = [F.replace(F.lit(a), F.lit("%s"), n) for a in anchors]
    call = F.when(F.col("page_id") % 2 == 0, "<a href=\"javascript:fncFileDownload('bbs','plan.hwp')\">plan.hwp</a>").otherwise("")
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("http://h.kr/board/1").alias("url"), F.concat(*parts[:2], call, *parts[2:]).alias("html"))
    return documents.attachments(pages)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 3 THEN year(o_orderdate) || '년 ' || month(o_orderdate) || '월 ' || day(o_orderdate) || '일' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS normal, strftime(o_orderdate, '%Y-%m-%d') AS found FROM orders""")
def q_format_order_dates(spark, sf_dir):
    made = [F.when(F.col("o_orderkey") % 5 == i, F.date_format("o_orderdate", f)) for i, f in enumerate(("yyyyMMdd", "yyyy.MM.dd", "yyyy-MM-dd' 09:00'", "yyyy'년 'M'월 'd'일'", "yyyyMMdd'1400'"))]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(*made).alias("raw"))
    return rows.select("id", dates.normalise_date(F.col("raw")).alias("normal"), dates.find_date(F.col("raw")).alias("found"))
