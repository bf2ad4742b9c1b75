"""Nested records, routing, JSON and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.functions import cost, jsonx, text
from quarrykit.operators import claims
from quarrykit.plans.registry import Registry, table
from quarrykit.sources import feeds

REGISTRY = query = Registry()


@query("SELECT conv_id, count(*) AS turns, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")
def q_group_to_nested(spark, sf_dir):
    nested = F.array_sort(F.collect_list(F.struct("turn", "role")))
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(nested.alias("items"))
    return out.select("conv_id", F.size("items").cast("long").alias("turns"), F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])), ",").alias("roles"))


@query("""WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS n FROM conversations)
SELECT 'c' || conv_id AS claim_id, string_agg(role, ',' ORDER BY turn) FILTER (n = 1) AS tags, max(total) AS recurrence FROM (SELECT c.*, count(*) OVER (PARTITION BY conv_id) AS total FROM c) GROUP BY conv_id""")
def q_merge_nested(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"), F.count("*").alias("recurrence"))
    rows = c.select(F.concat_ws("-", F.lpad("turn", 6, "0"), "role").alias("claim_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("primary_id"), F.array("role").alias("tags"), F.create_map(F.lit("role"), F.col("role")).alias("variants"), "recurrence", F.lit(1.0).alias("confidence"))
    rows = rows.withColumn("claim_id", F.concat_ws("-", "claim_id", "primary_id"))
    out = claims.merged(rows.drop("primary_id"), rows.select("claim_id", "primary_id"))
    return out.select("claim_id", F.array_join("tags", ",").alias("tags"), "recurrence")


@query("""SELECT l_returnflag, k AS keyword_group, v AS keyword FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) UNPIVOT (v FOR k IN (l_linestatus))""")
def q_unpivot_groups(spark, sf_dir):
    sheet = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    out = [feeds.unpivoted_keywords(sheet.where(F.col("l_returnflag") == f).select("l_linestatus")).withColumn("l_returnflag", F.lit(f)) for f in ("A", "N", "R")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT CASE WHEN event_type = 'purchase' THEN 'project' WHEN event_type IN ('click', 'view') THEN 'certificate' ELSE 'ignored' END AS target, count(*) AS n, count(*) FILTER (length(event_type) < 6) AS suspicious FROM events GROUP BY 1""")
def q_route_by_type(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", claims.PROJECT_KINDS[0]).when(F.col("event_type").isin("click", "view"), claims.CERTIFICATE_KINDS[0]).otherwise("-")
    rows = claims.routed(table(spark, sf_dir, "events").select("event_type", kind.alias("type")))
    return rows.groupBy("target").agg(F.count("*").alias("n"), F.count_if(claims.suspicious(F.col("event_type"))).alias("suspicious"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END AS found FROM events")
def q_json_props(spark, sf_dir):
    answer = F.when(F.col("event_id") % 3 == 0, F.lit("no braces here")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("It is "), F.col("props"), F.lit(" .")))
    return table(spark, sf_dir, "events").select("event_id", jsonx.decoded(F.col("props"), "k long")["k"].alias("k"), jsonx.json_in_text(answer).alias("found"))


@query("""SELECT event_id, round(coalesce((event_id * 10 / 1000000 * pi + user_id / 1000000 * po) * 1400, 0)::VARCHAR::DECIMAL(38, 20), 1)::DOUBLE AS cost FROM (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 3.0 END AS pi, CASE event_type WHEN 'click' THEN 5.0 WHEN 'view' THEN 15.0 END AS po FROM events)""")
def q_token_cost(spark, sf_dir):
    model = F.when(F.col("event_type") == "click", "small").when(F.col("event_type") == "view", "model-large-1").otherwise("other")
    p_in, p_out = cost.prices_of(model)
    return table(spark, sf_dir, "events").select("event_id", cost.token_cost(p_in, p_out, F.col("event_id") * 10, F.col("user_id")).alias("cost"))


@query("""SELECT doc_id, source || '=u0' || CASE WHEN doc_id % 2 = 0 THEN ';file 2=u1' ELSE '' END AS files FROM documents""")
def q_zip_join(spark, sf_dir):
    urls = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("u0"), F.lit("u1"))).otherwise(F.array(F.lit("u0")))
    z = feeds.zipped_files(F.array("source"), urls)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(z, lambda p: F.concat_ws("=", p["name"], p["url"])), ";").alias("files"))


@query("SELECT string_agg(n_name || '=' || n_nationkey, ',' ORDER BY n_name) AS settings FROM nation")
def q_key_values(spark, sf_dir):
    kv = feeds.key_values(table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("string").alias("v")), "n_name", "v")
    return kv.select(F.array_join(F.transform(F.map_entries("settings"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("settings"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 25 THEN '' ELSE p_type END, ''), p_brand) AS label, CASE WHEN p_size IS NULL THEN 'unknown' WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS big FROM part")
def q_fallback_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.first_filled(F.when(F.col("p_size") > 25, "").otherwise(F.col("p_type")), F.col("p_brand")).alias("label"), text.tri_state(F.col("p_size") > 25).alias("big"))
