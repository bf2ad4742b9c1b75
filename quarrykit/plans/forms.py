"""Queries of text forms, routing, numbering and permission rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.functions import text
from quarrykit.operators import claims, documents, extraction, notices
from quarrykit.plans.registry import Registry, table

REGISTRY = query = Registry()


@query("""SELECT doc_id, lower(coalesce(lang, '') || ' ' || coalesce(source, '')) AS search, regexp_replace(t, '[·.,()\\s\\p{Z}]+', '', 'g') AS heading, substring(text, 1, 100) AS head,
replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped
FROM (SELECT *, string_split(text, chr(10))[1] AS t FROM documents)""")
def q_text_forms(spark, sf_dir):
    title = F.substring_index("text", "\n", 1)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.search_text("lang", "source").alias("search"), text.norm_heading(title).alias("heading"), text.clip(F.col("text"), 100).alias("head"), text.escape_html(title).alias("escaped"))


@query("""SELECT doc_id, (s // 500)::INT AS n, substring(text, s + 1, 500) AS text
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 500)) AS s FROM documents)""")
def q_text_chunks(spark, sf_dir):
    return documents.chunks(table(spark, sf_dir, "documents"), size=500)


@query("""SELECT doc_id, CASE WHEN trim(coalesce(CASE WHEN doc_id % 4 <> 0 THEN text END, '')) = '' THEN 'simple' WHEN doc_id % 3 <> 0 AND n_chars * 20000 < 30000000 THEN 'binary' ELSE 'text' END AS route FROM documents""")
def q_input_route(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select("doc_id", extraction.input_route(F.when(k % 4 != 0, F.col("text")), F.when(k % 3 == 0, "hwpx").otherwise("PDF"), F.col("n_chars") * 20_000).alias("route"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INT AS n FROM lineitem")
def q_claim_numbers(spark, sf_dir):
    return claims.numbered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 >= l_suppkey % 7 THEN 'a' || l_partkey ELSE 'b' || l_suppkey END AS kept FROM lineitem")
def q_primary_of_pair(spark, sf_dir):
    side = lambda name, c, m: F.struct(F.concat(F.lit(name), F.col(c).cast("string")).alias("id"), (F.col(c) % m).alias("confidence"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", claims.primary_of(side("a", "l_partkey", 10), side("b", "l_suppkey", 7))["id"].alias("kept"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 3 = 0")
def q_permitted_users(spark, sf_dir):
    k = F.col("c_custkey")
    users = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 10 == 0, "admin").otherwise("user").alias("role"), F.when(k % 3 == 0, 1).otherwise(0).alias("can_analyse"))
    return notices.permitted(users, "can_analyse").select("id", "role")


@query("""SELECT o_custkey, c AS current, p AS last, array_to_string(range(greatest(1, c - 4), least(p, c + 4) + 1), ',') AS shown
FROM (SELECT o_custkey, (count(*) + 1) // 2 AS p, max(o_orderkey) % ((count(*) + 1) // 2) + 1 AS c FROM orders GROUP BY 1)""")
def q_page_numbers(spark, sf_dir):
    last = F.floor((F.count("*") + 1) / 2)
    pages = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(last.alias("last"), F.max("o_orderkey").alias("k")).withColumn("current", F.col("k") % F.col("last") + 1)
    return pages.select("o_custkey", "current", "last", F.array_join(notices.page_numbers(F.col("current"), F.col("last")).cast("array<string>"), ",").alias("shown"))
