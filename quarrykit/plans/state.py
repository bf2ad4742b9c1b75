"""Queries of ordered state: credit gates, run states, commits of a versioned table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.operators import gate, profiles, runs
from quarrykit.plans.registry import Registry, table
from quarrykit.storage import shared_path
from quarrykit.tables import Table

REGISTRY = query = Registry()
_BALANCE, _STATES = 5000.0, {"click": "processing", "view": "pending", "purchase": "completed", "error": "failed"}


def priced(row: dict) -> dict:
    """Stands for a model: half a unit and one for every forty characters, and no answer to a blank text."""
    n = len(row["text"] or "")
    return {"error": "blank", "cost": 0.0} if not n else {"answer": f"{n} characters", "cost": n // 40 + 0.5}


@query(f"""WITH d AS (SELECT doc_id AS id, source AS account, CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE length(text) // 40 + 0.5 END AS c, text FROM documents),
r AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY account ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM d),
g AS (SELECT *, {_BALANCE} - used >= 50 AS ok FROM r)
SELECT id, account, CASE WHEN NOT ok THEN 'credit_insufficient' WHEN coalesce(text, '') = '' THEN 'failed' ELSE 'completed' END AS state, CASE WHEN ok THEN c ELSE 0 END::DOUBLE AS cost,
({_BALANCE} - sum(CASE WHEN ok THEN c ELSE 0 END) OVER (PARTITION BY account ORDER BY id))::DOUBLE AS balance FROM g""")
def q_credit_gate(spark, sf_dir):
    """Every document of a source in order, until the source's credit is below the least."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("account"), "text")
    balances = docs.select("account").distinct().withColumn("balance", F.lit(_BALANCE))
    return gate.gated(docs, balances, priced).select("id", "account", "state", "cost", "balance")


def _case() -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items()) + " ELSE 'processing' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {_case()} AS state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT * FROM (VALUES ('', 'pending'), ('', 'processing'), ('pending', 'processing'), ('pending', 'failed'), ('processing', 'processing'), ('processing', 'completed'), ('processing', 'failed'), ('failed', 'pending'), ('failed', 'processing')) t(a, b)),
f AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, ''::VARCHAR AS state, ''::VARCHAR AS before, ''::VARCHAR AS now FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.n, e.event_id, e.state, f.now, CASE WHEN (f.now, e.state) IN (SELECT (a, b) FROM g) THEN e.state ELSE f.now END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id, state, before, CASE WHEN (before, state) NOT IN (SELECT (a, b) FROM g) THEN coalesce(nullif(before, ''), 'nothing') || ' to ' || state END AS error FROM f WHERE n > 0""")
def q_checked_states(spark, sf_dir):
    kind = F.lit("processing")
    for k, v in _STATES.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return runs.checked(table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("state")), "user_id", "event_id")


@query("""WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS p FROM orders GROUP BY 1)
SELECT c_custkey AS k, coalesce(p, c_acctbal) AS p, c_name AS name FROM customer LEFT JOIN o ON k = c_custkey WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT k, p, NULL FROM o WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def q_versioned_commits(spark, sf_dir):
    """Customers, then the best price of each one's orders merged in, then a segment deleted: three commits, read back."""
    t = Table(spark, shared_path(spark, "customers"), ["k"])
    customers = table(spark, sf_dir, "customer")
    t.upsert(customers.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("p"), F.col("c_name").alias("name")))
    t.upsert(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("p")))
    t.delete(customers.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k")))
    return t.read()


def profile_rows(spark, sf_dir):
    """Profiles of the sources, and the documents' first lines as hints: projects in English, certificates in other languages."""
    d = table(spark, sf_dir, "documents")
    name = F.substring(F.substring_index("text", "\n", 1), 1, 40)
    hints = d.select(F.col("source").alias("source_id"), F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "실적").otherwise("인증").alias("type"), name.alias("name"), F.when(F.col("doc_id") % 3 == 0, 2026).alias("year"), F.col("lang").alias("organization"))
    first = hints.groupBy("source_id").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    item = F.struct(F.col("a").alias("name"), *[F.lit("").alias(c) for c in ("client", "amount", "period", "role")])
    return first.select("source_id", F.array(item).alias("projects"), F.concat_ws("\n", "a", "b").alias("certificates")), hints


@query()
def q_profile_apply(spark, sf_dir):
    return profiles.applied(*profile_rows(spark, sf_dir))
