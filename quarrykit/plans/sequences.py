"""Order-dependent queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.functions import dates
from quarrykit.operators import ordered
from quarrykit.plans.registry import NOTICES_SQL, Registry, table
from quarrykit.plans.registry import notices as notice_table
from quarrykit.streaming import feeds

REGISTRY = query = Registry()


@query("SELECT source, doc_id, n_chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents) WHERE rank <= 3")
def q_topk_per_group(spark, sf_dir):
    return ordered.top_k(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 3)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def q_first_seen(spark, sf_dir):
    return ordered.first_seen(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, event_id, first_value(CASE WHEN value > 70 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM events")
def q_next_nonmissing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 70, F.col("event_id")).alias("hit"))
    return ordered.next_present(e, ["user_id"], "event_id", "hit").drop("hit")


@query("SELECT user_id, event_id, last_value(CASE WHEN value > 70 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def q_carry_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 70, F.col("event_type")).alias("hit"))
    return ordered.carried(e, ["user_id"], "event_id", "hit", "carried").drop("hit")


@query("""WITH f AS (SELECT user_id, event_id, value, coalesce((value < lag(value) OVER w - 5)::INT, 0) AS fall FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, max(CASE WHEN fall = 1 AND p = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cut FROM (SELECT *, coalesce(lag(fall) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS p FROM f))
SELECT user_id, event_id, value FROM c WHERE cut = 0""")
def q_streak_cut(spark, sf_dir):
    return ordered.cut_at_streak(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 5)


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_orderkey // 1000 AS page, o_totalprice < 20000 AS old FROM orders), q AS (SELECT o_custkey, page, max(old) AS any_old FROM p GROUP BY ALL),
s AS (SELECT *, coalesce(max(any_old::INT) OVER (PARTITION BY o_custkey ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT o_custkey, o_orderkey FROM p JOIN s USING (o_custkey, page) WHERE before = 0 AND NOT old""")
def q_take_while_pages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr("o_orderkey div 1000").alias("page"), "o_totalprice")
    return ordered.take_pages(o, ["o_custkey"], "page", F.col("o_totalprice") < 20000).select("o_custkey", "o_orderkey")


@query("SELECT doc_id FROM (SELECT doc_id, n_chars > 5000 AS p, bool_or(n_chars > 5000) OVER (PARTITION BY source, lang) AS a FROM documents) WHERE p OR NOT a")
def q_fallback_to_all(spark, sf_dir):
    return ordered.preferred_or_all(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], F.col("n_chars") > 5000).select("doc_id")


@query("SELECT user_id, min(event_id) FILTER (value > 90) AS first FROM events GROUP BY user_id")
def q_first_position(spark, sf_dir):
    return ordered.first_position(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") > 90)


@query("""WITH b AS (SELECT user_id, event_id, sum((value < 30)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING) = 3 AS stop FROM events)
SELECT user_id, event_id FROM (SELECT *, max(stop::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM b) WHERE s = 0""")
def q_blank_streak(spark, sf_dir):
    return ordered.until_blank_run(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") < 30).select("user_id", "event_id")


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_tumbling_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = feeds.windowed_counts(e, "at", ["event_type"], "7 days")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""WITH {NOTICES_SQL} SELECT id, greatest(coalesce(date_diff('day', try_cast(nullif(start_date, '') AS DATE), DATE '2026-03-01') + 1, 1), 1)::INT AS days FROM notices""")
def q_days_back(spark, sf_dir):
    return notice_table(spark, sf_dir).select("id", dates.days_back(F.col("start_date"), F.lit("2026-03-01").cast("date")).alias("days"))


@query("""SELECT o_orderkey, count(*) AS chunks, min(lo) AS first, max(hi) AS last FROM (SELECT o_orderkey, CASE WHEN i = 0 THEN t ELSE t + INTERVAL (7 * i) DAY + INTERVAL 1 SECOND END AS lo, least(t + INTERVAL (7 * (i + 1)) DAY, t + INTERVAL 30 DAY) AS hi
FROM (SELECT o_orderkey, o_orderdate AS t, unnest(range(5)) AS i FROM orders)) WHERE lo <= hi GROUP BY o_orderkey""")
def q_date_chunks(spark, sf_dir):
    t = F.col("o_orderdate").cast("timestamp")
    c = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(dates.date_chunks(t, t + F.expr("interval 30 days"))).alias("c"))
    return c.groupBy("o_orderkey").agg(F.count("*").alias("chunks"), F.min("c.lo").cast("timestamp_ntz").alias("first"), F.max("c.hi").cast("timestamp_ntz").alias("last"))
