"""Chosen hints and claims taken over into profiles.

A profile has projects (items) and certificates (lines of a text).  Hints are taken in
order: a project is known if its name equals, holds or lies in a name that the profile
has *by then*; a certificate's line if it equals or resembles a line that it has by then.
Hints whose normalised names are equal always end as the first of them does or as
duplicates, so only the first one is compared.

A hint is added if no name *added* before it is like it.  What is like what does not
depend on the order, so it is joined first and the order only decides on the links:

* names that hold each other share the rarest six letters of the shorter one: joined by
  those, then compared;
* lines are taken in blocks of growing size: a block's lines are compared in tiles with
  all that have been added by then, what is left with each other (so copies of a line
  that is there are never paired with each other);
* of the links, names without an earlier link are in and what they link to is out,
  again and again; the last few links are followed in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions import text
from quarrykit.operators import claims, merge, resemblance
from quarrykit.storage import discard, saved

ITEM = "struct<name: string, client: string, amount: string, period: string, role: string>"
_FIELDS = ("name", "client", "amount", "period", "role")
MODES = ("append_only", "fill_empty")
GRAM = 6  # letters of a name that may hold or lie in another
BLOCK, GROWTH = 4096, 4  # places of the first block of lines, and how much larger each next end is
FEW = 200_000  # links that are followed in order


def certificate_line(name: Column, year: Column) -> Column:
    """A certificate as its line: the name, with the year where there is one."""
    return F.when(F.coalesce(year.cast("int"), F.lit(0)) != 0, F.concat(name, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(name)


def _out(links: DataFrame, few: int | None = None) -> DataFrame:
    """_key and at of the places that are not added, by links (_key, a, b) of a place to a later one like it; places up to 0 are there."""
    few = FEW if few is None else few
    left = saved(links.where("b > 0").distinct(), "links")
    gone: DataFrame | None = None
    while (n := left.count()) > few:
        free = left.select("_key", "a").distinct().join(left.select("_key", F.col("b").alias("a")).distinct(), ["_key", "a"], "left_anti")
        now = saved(left.join(free, ["_key", "a"], "left_semi").select("_key", F.col("b").alias("at")).distinct(), "out")
        gone = now if gone is None else gone.unionByName(now)
        before, left = left, left.join(now.withColumnRenamed("at", "b"), ["_key", "b"], "left_anti").join(now.withColumnRenamed("at", "a"), ["_key", "a"], "left_anti")
        left = saved(left.select("_key", "a", "b"), "links")
        discard(before)
    if n:
        last = left.groupBy("_key").applyInPandas(_followed, "_key string, at long")
        gone = last if gone is None else gone.unionByName(last)
    return left.select("_key", F.col("b").alias("at")).limit(0) if gone is None else gone


def _followed(pdf: pd.DataFrame) -> pd.DataFrame:
    out: set[int] = set()
    for a, b in sorted(zip(pdf["a"].tolist(), pdf["b"].tolist()), key=lambda x: x[::-1]):
        if a not in out:  # all links to a came before those to b
            out.add(b)
    return pd.DataFrame({"_key": [pdf["_key"].iloc[0]] * len(out), "at": sorted(out)}).astype({"at": "int64"})


def _names_out(rows: DataFrame) -> DataFrame:
    """Places of names (_key, at, norm) that hold, lie in or equal one added before them; places up to 0 are there."""
    # What equals a name that is there; names of hints differ from each other.
    equal = rows.where("at > 0").join(rows.where("at <= 0").select("_key", "norm").distinct(), ["_key", "norm"], "left_semi").select("_key", F.lit(0).cast("long").alias("a"), F.col("at").alias("b"))
    long = rows.where(F.length("norm") >= GRAM).groupBy("_key", "norm").agg(F.min("at").alias("at"))
    each = F.transform(F.sequence(F.lit(1), F.length("norm") - (GRAM - 1)), lambda i: F.substring(F.col("norm"), i, F.lit(GRAM)))
    grams = saved(long.select("_key", "at", F.explode(F.array_distinct(each)).alias("gram")), "grams")
    often = grams.groupBy("_key", "gram").agg(F.count("*").alias("n"))
    rarest = grams.join(often, ["_key", "gram"]).groupBy("_key", "at").agg(F.min(F.struct("n", "gram")).alias("r"))
    # A gram that no other name has shows that none holds this one.
    asked = saved(rarest.where("r.n > 1").select("_key", "at", F.col("r.gram").alias("gram")), "asked")
    pairs = asked.join(grams.withColumnRenamed("at", "of"), ["_key", "gram"]).where("at <> of").select("_key", "at", "of")
    pairs = pairs.join(long.select("_key", "at", F.col("norm").alias("part")), ["_key", "at"]).join(long.select("_key", F.col("at").alias("of"), F.col("norm").alias("whole")), ["_key", "of"])
    links = pairs.where(F.contains("whole", "part")).select("_key", F.least("at", "of").alias("a"), F.greatest("at", "of").alias("b"))
    out = saved(_out(links.unionByName(equal)), "names")
    discard(grams, asked)
    return out


def _lines_out(rows: DataFrame, threshold: float) -> DataFrame:
    """Places of lines (_key, at, norm) that equal or resemble one added before them; places up to 0 are there."""
    have = rows.where("at <= 0").select("_key", "norm").distinct()
    last, end, start = rows.agg(F.max("at")).first()[0] or 0, BLOCK, 0
    out = rows.where("false").select("_key", "at")
    while start < last:
        block = rows.where((F.col("at") > start) & (F.col("at") <= end))
        hit = saved(resemblance.resembling(block, have, "_key", "norm", threshold), "hits")
        rest = saved(block.join(hit, ["_key", "norm"], "left_anti"), "rest")
        also = saved(_out(resemblance.ordered_pairs(rest, "_key", "at", "norm", threshold)), "also")
        out = out.unionByName(block.join(hit, ["_key", "norm"], "left_semi").select("_key", "at")).unionByName(also)
        have = have.unionByName(rest.join(also, ["_key", "at"], "left_anti").select("_key", "norm"))
        start, end = end, end * GROWTH
    return out


def applied(profiles: DataFrame, hints: DataFrame, key: str = "source_id", order: str = "id", mode: str = "append_only", threshold: float = claims.THRESHOLD) -> DataFrame:
    """key, projects, certificates and how many of each were added and skipped, of every profile (key, projects, certificates) and of every key with hints.

    hints: key, order, type, name, year, organization; those without a name or of a type
    that goes nowhere are passed over.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    named = F.trim(F.coalesce("name", F.lit("")))
    rows = claims.routed(hints).where((F.col("target") != "ignored") & (named != ""))
    item = F.struct(named.alias("name"), F.trim(F.coalesce("organization", F.lit(""))).alias("client"), F.lit("").alias("amount"), F.coalesce(F.nullif(F.col("year").cast("string"), F.lit("0")), F.lit("")).alias("period"), F.lit("").alias("role"))
    line = F.when(F.col("target") == "certificate", certificate_line(named, F.col("year")))
    rows = rows.select(key, F.col(order).alias("_at"), "target", item.alias("_item"), line.alias("_line"), text.norm_key(F.coalesce(line, named)).alias("_norm"))
    # Of equal keys the first is compared, the others are counted with it; a blank key is like no other.
    named = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    same = Window.partitionBy("_key", "target", "_norm")
    blank = F.col("_norm") == ""
    ranked = rows.withColumn("_key", named).withColumn("_n", F.row_number().over(same.orderBy("_at"))).withColumn("_all", F.when(blank, 1).otherwise(F.count("*").over(same)))
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_at", "target", "_norm", "_n")).cast("long")
    firsts = saved(ranked.where((F.col("_n") == 1) | blank).withColumn("at", place).drop("_n"), "firsts")

    own = profiles.select(key, named.alias("_key"), F.coalesce("projects", F.array().cast(f"array<{ITEM}>")).alias("_projects"), F.coalesce("certificates", F.lit("")).alias("_lines")).dropDuplicates(["_key"])
    own = saved(own, "own")
    old = lambda values: own.select("_key", F.posexplode(values)).select("_key", (-F.col("pos")).cast("long").alias("at"), text.norm_key(F.col("col")).alias("norm"))
    both = lambda target, values: firsts.where(F.col("target") == target).select("_key", "at", F.col("_norm").alias("norm")).unionByName(old(values)).where("norm <> ''")
    out = [_names_out(both("project", F.col("_projects.name"))).withColumn("target", F.lit("project")), _lines_out(both("certificate", F.split("_lines", "\n")), threshold).withColumn("target", F.lit("certificate"))]
    taken = firsts.join(out[0].unionByName(out[1]).withColumn("_gone", F.lit(True)), ["_key", "target", "at"], "left").withColumn("_in", F.col("_gone").isNull())

    listed = lambda target, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("_in") & (F.col("target") == target), F.struct("at", c)))), lambda x: x[c])
    added = lambda target: F.count_if(F.col("_in") & (F.col("target") == target))
    skipped = lambda target: F.sum(F.when(F.col("target") == target, F.col("_all") - F.col("_in").cast("int")).otherwise(0))
    counts = {"projects_added": added("project"), "projects_skipped": skipped("project"), "lines_added": added("certificate"), "lines_skipped": skipped("certificate")}
    new = taken.groupBy("_key").agg(F.first(key).alias("_value"), listed("project", "_item").alias("_items"), listed("certificate", "_line").alias("_new"), *[c.alias(n) for n, c in counts.items()])
    joined = own.join(new, "_key", "full_outer")
    lines, more = F.coalesce("_lines", F.lit("")), F.array_join(F.coalesce("_new", F.array().cast("array<string>")), "\n")
    ended = F.when((lines == "") | F.endswith(lines, F.lit("\n")), lines).otherwise(F.concat(lines, F.lit("\n")))
    text_ = F.when(F.coalesce(F.size("_new"), F.lit(0)) <= 0, lines).when(F.lit(mode == "fill_empty") & lines.rlike(r"(?U)^\s*\z"), more).otherwise(F.concat(ended, more))
    items = lambda c: F.transform(F.coalesce(c, F.array().cast(f"array<{ITEM}>")), lambda p: F.struct(*[p[n].alias(n) for n in _FIELDS]))
    return joined.select(F.coalesce(key, "_value").alias(key), F.concat(items("_projects"), items("_items")).alias("projects"), text_.alias("certificates"), *[F.coalesce(n, F.lit(0)).cast("int").alias(n) for n in counts])


def marked(hints: DataFrame, chosen: DataFrame, key: str = "source_id") -> DataFrame:
    """hints with the chosen ones (key, id) of their own source as imported."""
    hit = chosen.select(key, "id").distinct().withColumn("_hit", F.lit(True))
    return hints.join(hit, [key, "id"], "left").withColumn("user_action", F.when(F.col("_hit"), "imported").otherwise(F.col("user_action"))).select(*hints.columns)


def approved(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Claims with the chosen ones (claim_id) verified."""
    return merge.bulk_set(rows, "user_verified", 1, F.lit(True), chosen, "claim_id")
