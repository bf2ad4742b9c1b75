"""Mutations as merges, and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.functions import keys
from quarrykit.operators import ledger, merge
from quarrykit.plans.registry import NOTICES_SQL, Registry, table, tags

REGISTRY = query = Registry()
_SPLIT = "TIMESTAMP '1996-01-01'"


def _halves(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    early = o.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).drop("o_orderdate")
    changes = o.where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) | (F.col("o_orderkey") % 4 == 0)).select("o_orderkey", F.when(F.col("o_orderkey") % 8 == 0, None).otherwise(F.col("o_totalprice") + 1).alias("o_totalprice"))
    return early, changes


_BASE = f"b AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate < {_SPLIT}), c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_totalprice + 1 END AS price FROM orders WHERE o_orderdate >= {_SPLIT} OR o_orderkey % 4 = 0)"


@query(f"""WITH {_BASE} SELECT o_orderkey, b.o_custkey, coalesce(c.price, b.o_totalprice) AS o_totalprice,
CASE WHEN b.o_custkey IS NULL THEN 'insert' WHEN c.k IS NULL THEN 'keep' ELSE 'update' END AS _action FROM b FULL JOIN (SELECT *, 1 AS k FROM c) c USING (o_orderkey)""")
def q_upsert(spark, sf_dir):
    return merge.upsert(*_halves(spark, sf_dir), ["o_orderkey"])


@query(f"WITH {_BASE} SELECT count(*) FILTER (b.o_orderkey IS NULL) AS inserted, count(*) FILTER (b.o_orderkey IS NOT NULL) AS updated FROM c LEFT JOIN b ON b.o_orderkey = c.o_orderkey")
def q_upsert_counts(spark, sf_dir):
    return merge.upsert_counts(*_halves(spark, sf_dir), ["o_orderkey"])


@query(f"""WITH {NOTICES_SQL}, c AS (SELECT doc_id AS notice_id, 'won' AS tag, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE '' END AS memo FROM documents WHERE n_chars > 2000)
SELECT notice_id, coalesce(c.tag, t.tag) AS tag, coalesce(nullif(c.memo, ''), t.memo) AS memo FROM tags t FULL JOIN c USING (notice_id)""")
def q_tag_upsert_keep_memo(spark, sf_dir):
    new = table(spark, sf_dir, "documents").where("n_chars > 2000").select(F.col("doc_id").alias("notice_id"), F.lit("won").alias("tag"), F.when(F.col("doc_id") % 3 == 0, "new").otherwise("").alias("memo"))
    return merge.set_tag(tags(spark, sf_dir), new)


@query("""WITH b AS (SELECT c_name FROM customer WHERE c_nationkey < 12), r AS (SELECT DISTINCT c_name FROM customer WHERE c_acctbal > 0)
SELECT 'added' AS what, count(*) AS n FROM r WHERE c_name NOT IN (SELECT c_name FROM b) UNION ALL SELECT 'skipped', count(*) FROM r WHERE c_name IN (SELECT c_name FROM b) UNION ALL SELECT 'table', (SELECT count(*) FROM b) + count(*) FROM r WHERE c_name NOT IN (SELECT c_name FROM b)""")
def q_insert_if_absent(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    parts = merge.insert_if_absent(c.where("c_nationkey < 12").select("c_name"), c.where("c_acctbal > 0").select("c_name"), ["c_name"])
    out = [p.agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), "n") for w, p in zip(("table", "added", "skipped"), parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN CASE WHEN c_custkey % 2 = 1 THEN 0 ELSE 1 END ELSE (c_custkey % 2)::INT END AS flag FROM customer")
def q_patch_update(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    base = c.select("c_custkey", "c_acctbal", "c_nationkey", (F.col("c_custkey") % 2).cast("int").alias("flag"))
    changes = c.where("c_custkey % 5 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return merge.toggle(merge.patch(base, changes, "c_custkey"), "flag", F.col("c_nationkey") == 3).select("c_custkey", "c_acctbal", "flag")


@query("""WITH b AS (SELECT user_id, event_type, 1 AS n FROM events GROUP BY ALL HAVING min(event_id) % 2 = 0), s AS (SELECT user_id, event_type, count(*) AS k FROM events WHERE value > 50 GROUP BY ALL)
SELECT user_id, event_type, (coalesce(n, 0) + coalesce(k, 0))::BIGINT AS recurrence FROM b FULL JOIN s USING (user_id, event_type)""")
def q_increment_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("m")).where("m % 2 = 0").select("user_id", "event_type", F.lit(1).cast("long").alias("recurrence"))
    return merge.increment(base, e.where("value > 50"), ["user_id", "event_type"], "recurrence")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def q_cascade_delete(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return merge.cascade(nation, supplier, nation.where("n_regionkey = 2"), "n_nationkey", "s_nationkey")[1].select("s_suppkey")


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 2 ELSE 0 END AS verified FROM part")
def q_bulk_verify(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit(0).alias("verified"))
    return merge.bulk_set(rows, "verified", 2, (F.col("p_size") > 40) & (F.col("verified") == 0)).select("p_partkey", "verified")


def _entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 5 == 0, "charge").otherwise("usage")
    return ledger.entries(e.select(F.col("event_id").alias("id"), "user_id", kind.alias("type"), (F.floor(F.col("value"))).cast("double").alias("amount"), F.col("ts").alias("created_at")))


_LEDGER = "l AS (SELECT event_id AS id, user_id, CASE WHEN event_id % 5 = 0 THEN 'charge' ELSE 'usage' END AS type, CASE WHEN event_id % 5 = 0 THEN floor(value) ELSE -floor(value) END AS amount, ts AS created_at FROM events)"


@query(f"WITH {_LEDGER} SELECT id, user_id, sum(amount) OVER (PARTITION BY user_id ORDER BY id) AS balance FROM l")
def q_running_balance(spark, sf_dir):
    return ledger.with_balance(_entries(spark, sf_dir), "user_id", "id").select("id", "user_id", "balance")


@query(f"WITH {_LEDGER}, b AS (SELECT user_id, id, sum(amount) OVER (PARTITION BY user_id ORDER BY id) AS balance FROM l) SELECT user_id, round(arg_max(balance, id), 2) AS balance, max(id) AS last_id FROM b GROUP BY user_id")
def q_latest_balance(spark, sf_dir):
    return ledger.latest_balance(ledger.with_balance(_entries(spark, sf_dir), "user_id", "id"), "user_id")


@query(f"WITH {_LEDGER}, m AS (SELECT max(created_at) AS t FROM l) SELECT coalesce(sum(abs(amount)), 0) AS used, count(*) AS n FROM l, m WHERE type = 'usage' AND created_at >= date_trunc('month', t) AND created_at <= t")
def q_month_to_date_usage(spark, sf_dir):
    rows = _entries(spark, sf_dir)
    last = rows.agg(F.max("created_at").alias("t"), F.lit(1).alias("one"))
    return ledger.month_to_date(rows.withColumn("one", F.lit(1)).join(F.broadcast(last), "one"), "created_at", F.col("t"))


@query(f"WITH {_LEDGER} SELECT id, amount FROM l ORDER BY id DESC LIMIT 50")
def q_ledger_history(spark, sf_dir):
    return ledger.history(_entries(spark, sf_dir)).select("id", "amount")


@query("SELECT user_id, coalesce(max(event_id), 0) + 1 AS next FROM events GROUP BY user_id")
def q_next_sequence(spark, sf_dir):
    return ledger.next_sequence(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("""SELECT doc_id, substr(md5(source || lang), 1, 10) AS content_id, 'cl_' || substr(md5(doc_id || ':' || text), 1, 8) AS claim_id, 'src_' || lpad(doc_id::VARCHAR, 12, '0') AS source_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE source || '-' || lang END AS bid_no FROM documents""")
def q_stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", keys.content_id(F.col("source"), F.col("lang")).alias("content_id"), keys.claim_id(F.col("doc_id").cast("string"), F.col("text")).alias("claim_id"),
        keys.padded_id("src_", F.col("doc_id"), 12).alias("source_id"), keys.composite_key(F.col("source"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang"))).alias("bid_no"),
    )
