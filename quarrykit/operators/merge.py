"""Mutations as merges: a new state is computed from the old one and a change set.

Files are immutable, so each function returns the table after the change; the
caller overwrites a staging table and swaps it in (:func:`replace_table`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One change a key, the last by order."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base after changes (unique by keys), with _action: insert, update or keep.

    Columns that only the changes have are added; where both have one, a change's
    value wins unless it is null.
    """
    b = base.withColumn("_old", F.lit(True))
    c = changes.select(*keys, *[F.col(x).alias(f"_new_{x}") for x in changes.columns if x not in keys], F.lit(True).alias("_is_new"))
    out = b.join(c, keys, "full_outer")
    names = [x for x in dict.fromkeys([*base.columns, *changes.columns]) if x not in keys]
    value = lambda x: F.coalesce(F.col(f"_new_{x}"), F.col(x)) if x in base.columns and x in changes.columns else F.col(f"_new_{x}") if x in changes.columns else F.col(x)
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_is_new").isNull(), "keep").otherwise("update")
    return out.select(*keys, *[value(x).alias(x) for x in names], action.alias("_action"))


def upsert_counts(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """How many changes insert and how many update; base's other columns are not read."""
    c = changes.select(*keys).distinct().join(base.select(*keys).distinct().withColumn("_old", F.lit(True)), keys, "left")
    return c.agg(F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_old").isNotNull()).alias("updated"))


def insert_if_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table with the new rows, the rows added and the rows skipped."""
    known = base.select(*keys).distinct()
    one = rows.dropDuplicates(keys)
    added, skipped = one.join(known, keys, "left_anti"), one.join(known, keys, "left_semi")
    return base.unionByName(added, allowMissingColumns=True), added, skipped


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows a key, failing on the first key that has two."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("_ok", F.assert_true(F.col("n") == 1, F.lit("duplicate key"))).drop("_ok")


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: non-null columns of a change replace the row's."""
    names = [c for c in changes.columns if c != key]
    p = changes.select(key, *[F.col(c).alias(f"_p_{c}") for c in names])
    return base.join(p, key, "left").select(*[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in base.columns])


def toggle(base: DataFrame, flag: str, where: Column) -> DataFrame:
    return base.withColumn(flag, F.when(where, F.when(F.col(flag) == 1, 0).otherwise(1)).otherwise(F.col(flag)))


def set_tag(tags: DataFrame, changes: DataFrame, keep_memo: bool = True) -> DataFrame:
    """Tags after changes; with keep_memo a change without memo keeps the old one."""
    new = changes.select("notice_id", F.col("tag").alias("_tag"), F.col("memo").alias("_memo"))
    memo = F.coalesce(F.nullif("_memo", F.lit("")), F.col("memo")) if keep_memo else F.when(F.col("_tag").isNull(), F.col("memo")).otherwise(F.col("_memo"))
    return tags.select("notice_id", "tag", "memo").join(new, "notice_id", "full_outer").select("notice_id", F.coalesce("_tag", "tag").alias("tag"), memo.alias("memo"))


def increment(base: DataFrame, seen: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """Insert with counter 1, or add one for each further time a key is seen."""
    n = seen.groupBy(*keys).agg(F.count("*").alias("_n"))
    return base.join(n, keys, "full_outer").select(*keys, (F.coalesce(F.col(counter), F.lit(0)) + F.coalesce("_n", F.lit(0))).alias(counter))


def delete_keys(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


def cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the parents gone."""
    ids = gone.select(F.col(parent_key).alias("_k"))
    return parents.join(ids, parents[parent_key] == ids["_k"], "left_anti"), children.join(ids, children[child_key] == ids["_k"], "left_anti")


def bulk_set(base: DataFrame, column: str, value, where: Column, ids: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Set a column on explicit ids where given, else by the filter."""
    if ids is None:
        return base.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return base.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))).select(*base.columns)


def evolve(rows: DataFrame, schema) -> DataFrame:
    """Rows with the columns of schema added as nulls where they lack them."""
    empty = rows.sparkSession.createDataFrame([], schema)
    return rows.unionByName(empty, allowMissingColumns=True)


def replace_table(rows: DataFrame, path: str) -> None:
    """Write beside the table, then swap.

    A rename that fails (some file systems only say false) undoes the swap and raises;
    the old table is deleted last, once the new one is in place.  Between the two
    renames a reader finds no table and has to try again; it never finds half of one.
    """
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old, live = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", f"{path}.old", path))
    rows.write.mode("overwrite").parquet(f"{path}.new")
    swap(live.getFileSystem(conf), new, old, live)


def swap(fs, new, old, live) -> None:
    """Put new in the place of live, by way of old; live is back in place if that fails."""
    if fs.exists(old) and not fs.exists(live):  # an earlier swap broke off here
        fs.rename(old, live)
    fs.delete(old, True)
    had = fs.exists(live)
    if had and not fs.rename(live, old):
        raise OSError(f"cannot move {live} away; it is unchanged")
    if not fs.rename(new, live):
        if had and not fs.rename(old, live):
            raise OSError(f"cannot put the new table in place; the old one is at {old}")
        raise OSError(f"cannot put the new table in place; {live} is unchanged")
    fs.delete(old, True)
