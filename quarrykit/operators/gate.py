"""Analyses that an account has to be able to pay: an ordered fold over each account's notices.

What an analysis costs is known only after it was made, so whether the next one may
start depends on all before it.  An account's notices pass one after another through a
task that holds nothing but the balance; accounts are dealt over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quarrykit.operators import extraction, ledger

INSUFFICIENT = "credit_insufficient"


def gated(notices: DataFrame, balances: DataFrame, analyse: Callable[[dict], dict], account: str = "account", order: str = "id", least: float = ledger.LEAST_BALANCE) -> DataFrame:
    """notices with state, answer, cost and the balance after each.

    analyse takes a row and returns answer and cost (of a failed call, error and the
    cost that it had all the same).  A notice whose account has less than least, or none
    at all, is not analysed; its state says so, as does that of a call that fails.
    """
    rows = notices.join(balances.select(account, F.col("balance").alias("_balance")), account, "left")
    added = [StructField("state", StringType()), StructField("answer", StringType()), StructField("cost", DoubleType()), StructField("balance", DoubleType())]
    schema = StructType([*notices.schema, *added])
    names = notices.columns

    def fold(parts):
        now, left = None, 0.0
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                if now is None or r["_key"] != now:
                    now, left = r["_key"], 0.0 if pd.isna(r["_balance"]) else float(r["_balance"])
                row = {c: r[c] for c in names}
                if left < least:
                    out.append((*row.values(), INSUFFICIENT, None, 0.0, round(left, 2)))
                    continue
                try:
                    got = analyse(row)
                except Exception as error:
                    got = {"error": f"{type(error).__name__}: {error}"[:500]}
                cost = float(got.get("cost") or 0.0)
                left -= cost
                failed = got.get("error")
                out.append((*row.values(), "failed" if failed else "completed", failed or got.get("answer"), cost, round(left, 2)))
            yield pd.DataFrame(out, columns=[*names, "state", "answer", "cost", "balance"], dtype=object)

    keyed = rows.withColumn("_key", F.coalesce(F.col(account).cast("string"), F.lit("\x00")))
    return keyed.repartition("_key").sortWithinPartitions("_key", order).mapInPandas(fold, schema)


def analyses(gated_rows: DataFrame, done: DataFrame, text: Column, kind: Column, size: Column, notice: str = "notice_id", order: str = "id") -> DataFrame:
    """Stored analyses of the rows that completed: their place among their notice's analyses (after those done), the route of their input, cost."""
    last = done.groupBy(notice).agg(F.max("analysis_seq").alias("_last"))
    rows = gated_rows.where("state = 'completed'").join(last, notice, "left")
    seq = F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy(notice).orderBy(order))
    route = extraction.input_route(text, kind, size)
    return rows.select(notice, seq.cast("int").alias("analysis_seq"), F.when(route == "simple", "simple").otherwise("full").alias("mode"), route.alias("route"), "answer", "cost")


def usage_entries(gated_rows: DataFrame, account: str = "account") -> DataFrame:
    """Ledger rows of the analyses that cost something: what was used, and the balance after it."""
    used = gated_rows.where(F.col("cost") > 0)
    return ledger.entries(used.select(account, F.lit("usage").alias("type"), F.col("cost").alias("amount"), "balance", "id"))
