"""Order-dependent operators as window functions, always within a partition key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k(rows: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def section_ends(rows: DataFrame, keys: list[str], start: str, length: str) -> DataFrame:
    """end: where the next section of the document starts, its length after the last."""
    w = Window.partitionBy(*keys).orderBy(start)
    return rows.withColumn("end", F.coalesce(F.lead(start).over(w), F.col(length)))


def next_present(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """next: the following non-null value, misses passed over."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("next", F.first(value, ignorenulls=True).over(w))


def carried(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def numbered_groups(rows: DataFrame, keys: list[str], order: str, opens: Column, name: str = "group") -> DataFrame:
    """Running number of the rows that open a group (0 before the first)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(opens.cast("int")).over(w))


def cut_at_streak(rows: DataFrame, keys: list[str], order: str, value: str, drop: float, streak: int = 2) -> DataFrame:
    """Rows before the value has fallen by more than drop so many times in a row."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    falls = rows.withColumn("_fall", F.coalesce((F.col(value) < F.lag(value).over(w) - drop).cast("int"), F.lit(0)))
    runs = falls.withColumn("_run", F.sum(1 - F.col("_fall")).over(run))
    length = F.sum("_fall").over(Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    lengths = runs.withColumn("_len", length)
    return lengths.withColumn("_cut", F.max((F.col("_len") >= streak).cast("int")).over(run)).where("_cut = 0").drop("_fall", "_run", "_len", "_cut")


def take_pages(rows: DataFrame, keys: list[str], page: str, old: Column) -> DataFrame:
    """Pages up to and with the first that has an old row; old rows themselves go."""
    w = Window.partitionBy(*keys).orderBy(page).rangeBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_old", old.cast("int"))
    return marked.withColumn("_before", F.coalesce(F.max("_old").over(w), F.lit(0))).where("_before = 0 and _old = 0").drop("_old", "_before")


def preferred_or_all(rows: DataFrame, keys: list[str], preferred: Column) -> DataFrame:
    """Preferred rows of each key; all of its rows where it has none."""
    marked = rows.withColumn("_p", preferred)
    w = Window.partitionBy(*keys)
    return marked.withColumn("_any", F.bool_or("_p").over(w)).where(F.col("_p") | ~F.col("_any")).drop("_p", "_any")


def first_position(rows: DataFrame, keys: list[str], position: str, match: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(F.when(match, F.col(position))).alias("first"))


def until_blank_run(rows: DataFrame, keys: list[str], order: str, blank: Column, run: int = 3) -> DataFrame:
    """Rows before the end of the first run of so many blank ones."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = w.rowsBetween(-(run - 1), 0)
    marked = rows.withColumn("_b", blank.cast("int")).withColumn("_stop", (F.sum("_b").over(last) == run).cast("int"))
    so_far = F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_stopped", so_far).where("_stopped = 0").drop("_b", "_stop", "_stopped")
