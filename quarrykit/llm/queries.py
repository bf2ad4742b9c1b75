"""Driver queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import decontaminate, group_join, html_wrapper, impact_search, importance, minhash_odd, pii_feistel, quality_knn, quality_rules, rlz_dedup, sentencepiece_ac, suffix_dedup, url_reputation
from quarrykit.llm.minhash_odd import near_duplicates
from quarrykit.llm.rlz_dedup import remove_repeated_phrases
from quarrykit.llm.suffix_dedup import remove_repeated_bytes


KEY = "spark.quarrykit.pseudonymKey"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pseudonym_key(spark: SparkSession) -> str:
    """The secret in spark.quarrykit.pseudonymKey; where it is unset a random one for the session, so that nobody can undo the output.

    Pseudonyms of different sessions are linked only if the setting is the same.
    """
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY, key)
    return key


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op2_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_phrases(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("factors").cast("long").alias("n_factors"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "n_shared", F.sha2("kept", 256).alias("kept_sha256"))


def op6_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_text(_table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_ac.encode(_table(spark, sf_dir, "documents"))


def op8_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.report(_table(spark, sf_dir, "documents"), pseudonym_key(spark))


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_minhash_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.linked(_table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = importance.weigh(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return importance.draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_reputation": op1_url_reputation,
    "op2_rlz_dedup": op2_rlz_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_html_wrapper": op6_html_wrapper,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_pii_feistel": op8_pii_feistel,
    "op9_quality_knn": op9_quality_knn,
    "op10_minhash_odd": op10_minhash_odd,
    "op11_group_join": op11_group_join,
    "op12_importance": op12_importance,
    "op13_impact_search": op13_impact_search,
}

ORACLES: dict[str, str] = {
    "op1_url_reputation": url_reputation.ORACLE,
    "op2_rlz_dedup": rlz_dedup.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op5_suffix_dedup": suffix_dedup.ORACLE,
    "op10_minhash_odd": minhash_odd.ORACLE,
    "op11_group_join": group_join.ORACLE,
    "op12_importance": importance.ORACLE,
    "op13_impact_search": impact_search.ORACLE,
}
