"""Search, statistics, joins and keyword queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.functions import cost, dates, text
from quarrykit.operators import match, notices
from quarrykit.plans.registry import AS_OF, KEYWORDS, NOTICES_SQL, Registry, table, tags
from quarrykit.plans.registry import notices as notice_table

REGISTRY = query = Registry()
_DAY = AS_OF
_KW = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"
_HITS = f"list_filter({_KW}, lambda k: contains(lower(text), k))"


@query(f"""WITH {NOTICES_SQL} SELECT id, source, organization, start_date FROM notices
WHERE source = 'src0' AND start_date >= '2026-01-01' AND (title ILIKE '%th%' OR organization ILIKE '%th%') AND id NOT IN (SELECT notice_id FROM tags WHERE tag = 'excluded')
ORDER BY CASE WHEN start_date = '' THEN 1 ELSE 0 END, start_date DESC, n_keywords DESC, id LIMIT 20""")
def q_notice_search(spark, sf_dir):
    rows = notices.search(notice_table(spark, sf_dir), tags(spark, sf_dir), 1, 20, "latest", q="th", source="src0", window_days=90, as_of=F.lit(_DAY).cast("timestamp"), columns=("title", "organization"))
    return rows.select("id", "source", "organization", "start_date")


@query(f"""WITH {NOTICES_SQL} SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM notices WHERE title ILIKE '%th%' AND id NOT IN (SELECT notice_id FROM tags WHERE tag = 'excluded')""")
def q_notice_page_total(spark, sf_dir):
    rows = notices.not_tagged(notice_table(spark, sf_dir).where(notices.predicate(q="th", columns=("title",))), tags(spark, sf_dir))
    return notices.page_totals(rows, 20)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= strftime(DATE '1998-08-01' - 30, '%Y-%m-%d')")
def q_recent_window_filter(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").where(dates.in_last_days(day, F.lit("1998-08-01").cast("date"), 30)).select("o_orderkey", "o_totalprice")


@query(f"""WITH {NOTICES_SQL} SELECT id, end_date FROM notices ORDER BY CASE WHEN end_date = '' THEN 1 ELSE 0 END, end_date, n_keywords DESC, id LIMIT 50""")
def q_deadline_sort_blank_last(spark, sf_dir):
    return notices.page(notice_table(spark, sf_dir), notices.order_by_deadline(), 1, 50).select("id", "end_date")


@query(f"""WITH {NOTICES_SQL} SELECT source, count(*) AS count FROM notices WHERE id NOT IN (SELECT notice_id FROM tags WHERE tag = 'excluded') GROUP BY source""")
def q_source_counts_not_excluded(spark, sf_dir):
    return notices.source_counts(notice_table(spark, sf_dir), tags(spark, sf_dir))


@query(f"""WITH {NOTICES_SQL}, s AS (SELECT source, start_date, CASE WHEN end_date <> '' AND end_date < '{AS_OF}' THEN 'closed' ELSE 'ongoing' END AS status FROM notices)
SELECT source, count(*) AS count, count(*) FILTER (status = 'ongoing') AS ongoing, count(*) FILTER (status = 'closed') AS closed, max(start_date) AS last_collected FROM s GROUP BY source""")
def q_status_stats_by_source(spark, sf_dir):
    rows = notice_table(spark, sf_dir).withColumns({"status": dates.status(F.col("end_date"), F.lit(_DAY).cast("timestamp")), "collected_at": F.col("start_date")})
    return notices.status_stats(rows)


@query("SELECT o_orderstatus, count(*) AS count, max(o_orderdate) AS latest FROM orders GROUP BY ROLLUP (o_orderstatus)")
def q_grand_total_latest(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus").agg(F.count("*").alias("count"), F.max("o_orderdate").alias("latest"))


@query(f"WITH {NOTICES_SQL} SELECT tag, count(*) AS count FROM tags GROUP BY tag")
def q_tag_counts(spark, sf_dir):
    return notices.tag_counts(tags(spark, sf_dir))


@query(f"""WITH {NOTICES_SQL} SELECT n.id, t.tag, c.c_name AS tagged_by_name FROM notices n JOIN tags t ON t.notice_id = n.id LEFT JOIN customer c ON c.c_custkey = t.tagged_by WHERE t.tag <> 'lost'""")
def q_tagged_list(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    out = notices.tagged(notice_table(spark, sf_dir).select("id", "source"), tags(spark, sf_dir).where("tag <> 'lost'"), users)
    return out.select("id", "tag", "tagged_by_name")


@query(f"""WITH {NOTICES_SQL} SELECT id, tag, memo, CASE WHEN id % 5 = 0 THEN 'fetched' ELSE title END AS content FROM (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN '' ELSE title END AS title) FROM notices) n LEFT JOIN tags ON notice_id = id""")
def q_tag_detail_left(spark, sf_dir):
    n = notice_table(spark, sf_dir).select("id", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("title")).alias("content"), F.lit("x").alias("target"))
    fetched = n.where("content = ''").select("id", F.lit("fetched").alias("content"), F.lit("y").alias("target"))
    return notices.detail(n, tags(spark, sf_dir), fetched).select("id", "tag", "memo", "content")


@query(f"""WITH {NOTICES_SQL} SELECT id, end_date FROM notices WHERE end_date <> '' AND end_date < '2026-03-01' AND id NOT IN (SELECT notice_id FROM tags)""")
def q_never_tagged_purge(spark, sf_dir):
    return notices.purge(notice_table(spark, sf_dir).select("id", "end_date"), tags(spark, sf_dir), "2026-03-01")[1]


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def q_child_count_subquery(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT event_id, c_name AS name FROM events JOIN customer ON c_custkey = user_id WHERE ts > (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def q_session_user_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("expires_at"))
    cut = e.agg((F.max("expires_at") - F.expr("interval 2 days")).alias("cut"), F.lit(1).alias("one"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    live = e.withColumn("one", F.lit(1)).join(F.broadcast(cut), "one")  # one row
    return notices.sessions(live, users, F.col("cut")).select("event_id", "name")


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT DISTINCT p_type FROM part WHERE p_size <= 3)")
def q_interest_semi(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    wanted = part.where("p_size <= 3").select(F.col("p_type").alias("mid_class"))
    rows = part.select("p_partkey", "p_type", F.concat(F.lit("goods > "), "p_type").alias("procure_class"))
    return notices.interested(rows, wanted).select("p_partkey", "p_type")


@query("SELECT s_suppkey, coalesce(n_name, '') AS url FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = s_nationkey")
def q_lookup_default(spark, sf_dir):
    urls = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("name"), F.col("n_name").alias("url"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("name"))
    return notices.with_default_url(rows, urls).select("s_suppkey", "url")


@query(f"SELECT doc_id, array_to_string({_HITS}, ',') AS keywords, len({_HITS})::INT AS n FROM documents")
def q_keyword_hits(spark, sf_dir):
    h = match.hits(F.col("text"), KEYWORDS)
    return table(spark, sf_dir, "documents").select("doc_id", text.join_list(h).alias("keywords"), F.size(h).alias("n"))


@query(f"""SELECT doc_id, array_to_string(list_sort(k), ',') AS keywords, len(k)::INT AS n_keywords FROM (SELECT doc_id, list_filter({_KW}, lambda k: contains(lower(string_split(text, chr(10))[1]), k)) AS k FROM documents) WHERE len(k) > 0""")
def q_keyword_title_filter(spark, sf_dir):
    words = spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return match.matched(rows, F.col("title"), words).select("doc_id", "keywords", "n_keywords")


@query(f"SELECT keyword, count(*) AS docs, sum(doc_id)::BIGINT AS id_sum FROM documents, (SELECT unnest({_KW}) AS keyword) WHERE contains(lower(text), keyword) GROUP BY keyword")
def q_keyword_theta_join(spark, sf_dir):
    p = match.pairs(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), KEYWORDS)
    return p.groupBy("keyword").agg(F.count("*").alias("docs"), F.sum("doc_id").alias("id_sum"))


@query("SELECT k AS keyword FROM (SELECT DISTINCT p_brand AS k FROM part) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT p_brand AS k FROM part) b WHERE b.k <> a.k AND contains(a.k, b.k))")
def q_keyword_containment_prune(spark, sf_dir):
    return match.without_contained(table(spark, sf_dir, "part").select(F.col("p_brand").alias("keyword")))


@query("SELECT source, min_by(doc_id, doc_id) AS id, min_by(n_chars, doc_id) AS n_chars, array_to_string(list_sort(list_distinct(list(lang))), ',') AS keywords FROM documents GROUP BY source")
def q_dedup_keyword_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), "n_chars", F.col("lang").alias("keywords"))
    return match.merged_by_key(rows, "source", "id", "keywords")


@query("SELECT DISTINCT source AS keyword FROM documents WHERE lang IN ('en', 'de')")
def q_distinct_keywords(spark, sf_dir):
    code = F.when(F.col("lang") == "de", 7).when(F.col("lang") != "en", 9)
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("keyword"), F.lit(1).alias("is_active"), code.alias("source_id"))
    return match.active_keywords(rows, 7)


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (value < 20) AS pending, count(*) FILTER (value >= 20 AND value < 80) AS approved, count(*) FILTER (value >= 80) AS hidden FROM events GROUP BY ROLLUP (event_type)""")
def q_category_cond_counts(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("total"), F.count_if(v < 20).alias("pending"), F.count_if((v >= 20) & (v < 80)).alias("approved"), F.count_if(v >= 80).alias("hidden"))


@query("""SELECT source, lang, count(*) AS collected, count(*) FILTER (n_chars > 1000) AS matched, round(count(*) FILTER (n_chars > 1000) / count(*), 3) AS rate FROM documents GROUP BY ROLLUP (source, lang)""")
def q_run_rollup(spark, sf_dir):
    big = F.count_if(F.col("n_chars") > 1000)
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("collected"), big.alias("matched"), cost.rate(big, F.count("*")).alias("rate"))


@query("SELECT quality, count(*) AS n, round(avg(toxic), 3) AS rate FROM labels GROUP BY ROLLUP (quality)")
def q_match_rate(spark, sf_dir):
    return table(spark, sf_dir, "labels").rollup("quality").agg(F.count("*").alias("n"), cost.rate(F.sum("toxic"), F.count("*")).alias("rate"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def q_set_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id")).distinct()
