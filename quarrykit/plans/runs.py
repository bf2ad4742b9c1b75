"""Queries of runs, stored results and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.operators import claims, documents, runs
from quarrykit.plans.registry import Registry, table

REGISTRY = query = Registry()


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS state, event_id % 101 AS progress, event_type AS message FROM events)
SELECT user_id, arg_max(state, event_id) AS state, arg_max(progress, event_id) AS progress, arg_max(message, event_id) AS message, max(event_id) FILTER (state IN ('completed', 'failed')) AS completed_at, count(*) AS steps FROM e GROUP BY user_id""")
def q_run_states(spark, sf_dir):
    state = F.element_at(F.array(*[F.lit(s) for s in runs.STATES]), (F.col("event_id") % 4 + 1).cast("int"))
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), state.alias("state"), (F.col("event_id") % 101).alias("progress"), F.col("event_type").alias("message"))
    return runs.latest_state(log, "user_id")


@query("SELECT o_orderpriority AS source, max(o_orderkey) AS last_collected_at, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END, o_orderkey) AS last_collected_count FROM orders GROUP BY 1")
def q_last_collected(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return runs.last_collected(o.select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("collected")))


@query("""SELECT source, count(*) AS collected, count(*) FILTER (contains(lower(text), 'th')) AS matched, count(*) FILTER (contains(lower(text), 'th') AND l.doc_id IS NULL) AS inserted, count(*) FILTER (contains(lower(text), 'th') AND l.doc_id IS NOT NULL) AS updated
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""")
def q_run_counters(spark, sf_dir):
    return runs.counters(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.contains(F.lower("text"), F.lit("th")), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT doc_id AS source_id, lang AS type, coalesce(text, '')[:500] AS name, 2000 + doc_id % 25 AS year, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS organization, source AS section, CASE WHEN doc_id % 3 = 0 THEN 'rule' ELSE 'llm' END AS extractor FROM documents""")
def q_hint_append(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    org = F.when(F.col("doc_id") % 2 == 0, F.col("source")).when(F.col("doc_id") % 5 == 0, "")
    return runs.hint_rows(d.select(F.col("doc_id").alias("source_id"), F.col("lang").alias("type"), F.col("text").alias("name"), (F.col("doc_id") % 25 + 2000).alias("year"), org.alias("org"), F.col("lang").alias("organization"), F.col("source").alias("section"), F.when(F.col("doc_id") % 3 == 0, "rule").alias("extractor")))


def _analyses(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("notice_id"), F.col("o_custkey").alias("analysis_seq"), F.when(k % 2 == 0, "full").otherwise("simple").alias("mode"), F.concat(F.lit("s"), k.cast("string")).alias("parsed_summary"),
        F.when(k % 6 == 0, "not json").when(k % 4 == 0, F.concat(F.lit('[{"score":"'), F.col("o_custkey").cast("string"), F.lit('"},{"score":"1"}]'))).alias("match_detail"), F.lit("[]").alias("parsed_criteria"),
        F.when(k % 4 == 0, F.col("o_custkey")).alias("match_rate"), F.col("o_orderstatus").alias("simple_grade"), F.col("o_orderpriority").alias("simple_reason"),
    )


@query("""SELECT o_orderkey AS notice_id, CASE WHEN o_orderkey % 2 = 1 THEN 'simple' WHEN o_orderkey % 4 = 0 THEN 'full' ELSE 'parsed' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey END AS parsed_summary,
CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS match_rate, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS simple_grade FROM orders""")
def q_analysis_store(spark, sf_dir):
    return runs.analysis_rows(_analyses(spark, sf_dir)).select("notice_id", "kind", "parsed_summary", "match_rate", "simple_grade")


@query("""SELECT o_orderkey AS notice_id, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey END AS summary, CASE WHEN o_orderkey % 2 = 1 THEN NULL WHEN o_orderkey % 6 = 0 OR o_orderkey % 4 <> 0 THEN 0 ELSE 2 END::INT AS items,
CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 6 <> 0 THEN o_custkey::VARCHAR END AS first_score, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS grade, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS reason FROM orders""")
def q_analysis_shown(spark, sf_dir):
    full = F.col("full").isNotNull()
    return runs.shown(_analyses(spark, sf_dir)).select("notice_id", F.col("full.summary").alias("summary"), F.when(full, F.size("full.items")).alias("items"), F.get("full.items", F.lit(0))["score"].alias("first_score"), F.col("simple.grade").alias("grade"), F.col("simple.reason").alias("reason"))


@query("""WITH f AS (SELECT l_orderkey, list({'name': 'part ' || l_partkey, 'url': 'http://h/' || l_suppkey} ORDER BY l_linenumber, 'part ' || l_partkey, 'http://h/' || l_suppkey) AS x FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
SELECT o_orderkey AS id, '[' || array_to_string(list_transform(x, lambda f: '{"name":"' || f.name || '","url":"' || f.url || '"}'), ',') || ']' AS attachments FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def q_attachment_write_back(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"), F.concat(F.lit("http://h/"), F.col("l_suppkey").cast("string")).alias("url"))
    return runs.with_attachments(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), files)


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 1 AND o_orderkey % 5 <> 0""")
def q_attachment_trigger(spark, sf_dir):
    k = F.col("o_orderkey")
    tag = F.when(F.col("o_orderstatus") == "O", "review").when(F.col("o_orderstatus") == "P", "bid").otherwise("lost")
    files = F.when(k % 4 == 0, "").when(k % 4 == 1, '[{"name":"x"}]').when(k % 4 == 2, "[]")
    wanted = runs.wants_attachments(tag, F.when(k % 3 == 0, "procurement").otherwise("scraper"), files, F.when(k % 5 != 0, "http://h/"))
    return table(spark, sf_dir, "orders").where(wanted).select(k.alias("id"))


@query("""WITH c AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS x FROM orders GROUP BY 1), h AS (SELECT s_nationkey, list(s_name ORDER BY s_suppkey) AS x FROM supplier GROUP BY 1)
SELECT c_custkey AS source_id, array_to_string(c.x, ',') AS claims, array_to_string(h.x, ',') AS hints, coalesce(len(c.x), 0)::INT AS n_claims, coalesce(len(h.x), 0)::INT AS n_hints FROM customer LEFT JOIN c ON o_custkey = c_custkey LEFT JOIN h ON s_nationkey = c_custkey""")
def q_nested_export(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("id"), F.col("o_comment").alias("statement") if "o_comment" in table(spark, sf_dir, "orders").columns else F.lit("").alias("statement"))
    hints = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source_id"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    out = runs.export(sources, rows, hints)
    return out.select("source_id", F.array_join(F.transform("claims", lambda x: x["id"].cast("string")), ",").alias("claims"), F.array_join("hints.name", ",").alias("hints"), "n_claims", "n_hints")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def q_existence_flag(spark, sf_dir):
    return runs.with_flag(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "labelled")


_CLAIMS = "c AS (SELECT item_id AS id, ['Identity', 'Methodology', 'USP'][1 + item_id % 3] AS category, text AS statement, CASE WHEN item_id % 4 = 0 THEN 'edited ' || item_id WHEN item_id % 4 = 1 THEN '' END AS edited, item_id % 3 AS user_verified, (item_id % 7) / 10.0 AS confidence, item_id % 2 AS source_id FROM benchmark)"


def _claims(spark, sf_dir):
    i = F.col("item_id")
    kind = F.element_at(F.array(*[F.lit(c) for c in claims.CATEGORIES[:3]]), (i % 3 + 1).cast("int"))
    edited = F.when(i % 4 == 0, F.concat(F.lit("edited "), i.cast("string"))).when(i % 4 == 1, "")
    return table(spark, sf_dir, "benchmark").select(i.alias("id"), kind.alias("category"), F.col("text").alias("statement"), edited.alias("user_edited_statement"), (i % 3).alias("user_verified"), ((i % 7) / 10).alias("confidence"), (i % 2).alias("source_id"))


@query(f"WITH {_CLAIMS} SELECT id, coalesce(nullif(edited, ''), statement) AS statement, statement AS statement_original FROM c WHERE category = 'USP' AND source_id = 1")
def q_claim_list(spark, sf_dir):
    return claims.listed(_claims(spark, sf_dir), category="USP", source_id=1).select("id", "statement", "statement_original")


@query(f"WITH {_CLAIMS} SELECT category, count(*) AS total, count(*) FILTER (user_verified = 0) AS pending, count(*) FILTER (user_verified = 1) AS approved, count(*) FILTER (user_verified = 2) AS hidden FROM c GROUP BY category")
def q_claim_verdicts(spark, sf_dir):
    return claims.verdict_counts(_claims(spark, sf_dir))


@query("""SELECT s_suppkey AS id, trim(s_name) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Org' ELSE '' END AS client, '' AS amount, CASE WHEN s_suppkey % 3 = 0 THEN (2000 + s_suppkey % 25)::VARCHAR ELSE '' END AS period, '' AS role FROM supplier""")
def q_hint_projects(spark, sf_dir):
    k = F.col("s_suppkey")
    hint = F.struct(F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("name"), F.when(k % 2 == 0, " Org").alias("organization"), F.when(k % 3 == 0, k % 25 + 2000).alias("year"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), claims.project_item(hint).alias("p")).select("id", "p.*")


@query(r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'plan ' || page_id || '.hwp' WHEN 1 THEN '첨부파일_' || page_id WHEN 2 THEN 'f' || page_id || '.PDF' WHEN 3 THEN 'doc/' || page_id || '.zip' END AS name,
CASE page_id % 5 WHEN 0 THEN 'http://h.kr/inc/download.asp?cate=bbs&fname=plan ' || page_id || '.hwp' WHEN 1 THEN 'http://h.kr/home/board/fileDown.do?file_no=' || page_id WHEN 2 THEN 'https://cdn/f' || page_id || '.PDF' WHEN 3 THEN 'http://h.kr/board/doc/' || page_id || '.zip' END AS link FROM pages""")
def q_script_links(spark, sf_dir):
    n = F.col("page_id").cast("string")
    forms = ["javascript:fncFileDownload('bbs','plan %s.hwp')", "javascript:fn_fileDown('%s')", "javascript:open(\"https://cdn/f%s.PDF\")", "javascript:get('doc/%s.zip', 1)", "javascript:void(%s)"]
    href = F.element_at(F.array(*[F.format_string(f, n) for f in forms]), (F.col("page_id") % 5 + 1).cast("int"))
    link = documents.script_link(href, F.lit("http://h.kr"), F.lit("http://h.kr/board/view?id=1"))
    return table(spark, sf_dir, "pages").select("page_id", link.alias("l")).select("page_id", "l.name", "l.link")


@query("""SELECT k.kind, 'part' || w AS keyword, start::DATE AS start, least(start::DATE + 6, DATE '2026-03-31') AS "end" FROM (SELECT DISTINCT p_size % 7 AS w FROM part), (VALUES ('goods'), ('service'), ('works')) k(kind), range(DATE '2026-03-01', DATE '2026-04-01', INTERVAL 7 DAY) r(start)""")
def q_page_plan(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.concat(F.lit("part"), (F.col("p_size") % 7).cast("string")).alias("keyword"))
    return runs.page_plan(words, ["goods", "service", "works"], F.lit("2026-03-01").cast("date"), F.lit("2026-03-31").cast("date"))
