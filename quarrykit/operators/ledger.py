"""Append-only usage ledger: signed amounts, balances, monthly usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_BALANCE = 50.0


def entries(rows: DataFrame) -> DataFrame:
    """amount signed by type: charges add, usage subtracts."""
    return rows.withColumn("amount", F.when(F.col("type") == "usage", -F.abs("amount")).otherwise(F.abs("amount")))


def with_balance(rows: DataFrame, account: str, order: str) -> DataFrame:
    """Running balance of each account."""
    w = Window.partitionBy(account).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("balance", F.sum("amount").over(w))


def latest_balance(rows: DataFrame, account: str) -> DataFrame:
    """The balance that an account's last entry (by id) stored; partial maxima are enough."""
    return rows.groupBy(account).agg(F.round(F.max_by("balance", "id"), 2).alias("balance"), F.max("id").alias("last_id"))


def month_to_date(rows: DataFrame, at: str, as_of: Column) -> DataFrame:
    """Usage of the month of as_of: sum of absolute amounts (0 if none) and number."""
    used = rows.where((F.col("type") == "usage") & (F.col(at) >= F.date_trunc("month", as_of)) & (F.col(at) <= as_of))
    return used.agg(F.coalesce(F.sum(F.abs("amount")), F.lit(0.0)).alias("used"), F.count("*").alias("n"))


def next_sequence(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    return rows.groupBy(key).agg((F.coalesce(F.max(sequence), F.lit(0)) + 1).alias("next"))


def may_spend(balances: DataFrame, least: float = LEAST_BALANCE) -> DataFrame:
    return balances.where(F.col("balance") >= least)


def history(rows: DataFrame, n: int = 50) -> DataFrame:
    return rows.orderBy(F.col("id").desc()).limit(n)
