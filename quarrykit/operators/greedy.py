"""Greedy merging of claims in order, as joins around a small fold.

The definition is sequential: in its category, a claim joins the first representative
that it resembles *as that stands by then* and may replace its statement by a longer
one; else it becomes a representative.  What Spark runs:

1. Statements are made distinct and linked where they may resemble each other
   (:mod:`resemblance`).  A claim can only meet representatives of its component, as a
   representative's statement is always one of the claims' own.
2. A component is folded in order over the *first* claim of each statement.  Later
   claims of a statement do as the one before them did, unless a representative has
   changed between them in a way that matters to them; the fold says where.
3. For those places the next claim of the statement is looked up and the folds of those
   components run again with it, until they ask for nothing new (usually at once).
4. Every claim finds the last folded claim of its statement before it, takes over
   its representative, and the columns are aggregated by representative.

So a group holds a component's distinct statements, never its claims: a statement on a
third of all rows is one row of the fold.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from quarrykit.operators import graph
from quarrykit.operators import resemblance as R
from quarrykit.storage import discard, saved


class _Fold:
    """One component: representatives in order, and whom each statement joined last."""

    def __init__(self, texts: list[str], threshold: float):
        self.of, self.threshold = R.Texts(texts, fine=False), threshold
        self.reps: list[int] = []  # place of the statement that each has now
        self.joined: dict[int, int | None] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.match = SequenceMatcher(None)

    def resembles(self, rep: int, statement: int) -> bool:
        """Whether the ratio of two statements (in this order) reaches the threshold."""
        if rep == statement:
            return True
        key = rep, statement
        if key not in self.known:
            a, b = self.of.texts[rep], self.of.texts[statement]
            # In a long second text difflib starts few blocks, so they are found sooner than a common subsequence.
            self.known[key] = (len(b) >= R._JUNKED or R.alike(a, b, self.threshold)) and R._reaches(self.match, a, b, self.threshold)
        return self.known[key]

    def first(self, statement: int) -> int | None:
        have = np.array(self.reps, np.int64)
        some = set(R.possible(self.of, statement, self.of, np.unique(have[have != statement]), self.threshold).tolist()) | {statement}
        return next((r for r, s in enumerate(self.reps) if s in some and self.resembles(s, statement)), None)

    def meet(self, statement: int) -> tuple[int, list[int]]:
        """The representative that a claim joins or becomes, and the statements whose next claim will do otherwise."""
        rep, moved = self.first(statement), []
        if rep is None:
            rep = len(self.reps)
            self.reps.append(statement)
        elif self.of.size[statement] > self.of.size[self.reps[rep]]:
            self.reps[rep] = statement
            others = np.array([s for s, r in self.joined.items() if r is not None and s != statement], np.int64)
            near = set(R.possible(self.of, statement, self.of, others, self.threshold).tolist())
            for s in others.tolist():
                now = self.joined[s]
                still = now >= rep and s in near and self.resembles(statement, s)
                if (now == rep and not still) or (now > rep and still):
                    moved.append(s)
                    self.joined[s] = None  # until its next claim
        self.joined[statement] = rep
        return rep, moved


def _fold(threshold: float, order: list[str]):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*order, "_text"], kind="stable").reset_index(drop=True)
        first = pdf.drop_duplicates("_sid")
        number = {s: i for i, s in enumerate(first["_sid"])}
        state, founders, out = _Fold(first["_text"].tolist(), threshold), [], []
        sids = first["_sid"].tolist()
        for row, sid in enumerate(pdf["_sid"].tolist()):
            rep, moved = state.meet(number[sid])
            if rep == len(founders):
                founders.append(row)
            out.append((row, sid, founders[rep], None))
            out += [(row, sids[m], None, True) for m in moved]
        ends = dict(zip(founders, (state.of.texts[s] for s in state.reps)))
        rows, sid, founder, asked = zip(*out)
        made = pdf.iloc[list(rows)][["_component", *order]].reset_index(drop=True).astype(object)
        text = lambda values: pd.Series(values, dtype=object)
        keys = pdf["_key"].tolist()
        made["_sid"] = text(sid)
        made["_rep"] = text([None if f is None else keys[f] for f in founder])
        made["_final"] = text([ends.get(f) if f == r else None for f, r in zip(founder, rows)])
        made["_asked"] = [a is not None for a in asked]
        return made

    return fold


def merge(claims: DataFrame, threshold: float, order: list[str]) -> DataFrame:
    """See :func:`quarrykit.operators.claims.greedy_merge`."""
    rows = claims if "recurrence" in claims.columns else claims.withColumn("recurrence", F.lit(1).cast("long"))
    schema = rows.schema
    text, group = F.coalesce(F.col("statement"), F.lit("")), F.coalesce(F.col("category").cast("string"), F.lit("\x00"))
    at = F.struct(*order)
    base = saved(rows.withColumn("_group", F.md5(group)).withColumn("_text", text).withColumn("_sid", F.md5(F.concat_ws("\x00", "_group", "_text"))), "claims")
    names = ["_group", "_sid", "_text"]
    first = base.groupBy(*names).agg(F.min(at).alias("_at"))
    statements = saved(first.select(*names, "_at.*").withColumn("_node", F.xxhash64("_sid")), "statements")

    links = saved(R.linked(statements, "_group", "_node", "_text", threshold), "links")
    part = graph.components(links).select(F.col("id").alias("_node"), F.col("component"))
    # A component's least node is no row of components(); nodes that share a number share a component.
    folded = saved(statements.join(part, "_node", "left").withColumn("_component", F.coalesce("component", "_node")).drop("component"), "folded")
    many = folded.groupBy("_component").agg(F.count("*").alias("_n")).where("_n > 1").select("_component")
    alone = folded.join(many, "_component", "left_anti")
    key = F.md5(F.concat_ws("\x00", "_sid", F.to_json(F.struct(*order))))
    together = folded.join(many, "_component", "left_semi").select("_component", "_sid", "_text", *order, key.alias("_key"))

    met = saved(together, "met")
    made_schema = StructType([*met.select("_component", *order, "_sid").schema, StructField("_rep", StringType()), StructField("_final", StringType()), StructField("_asked", BooleanType())])
    spread, settled, used = 4 * base.sparkSession.sparkContext.defaultParallelism, [], [met]
    while True:
        # Components are few rows but much work each: dealt out by number, so that they are not put together by their bytes.
        made = saved(met.repartition(spread, "_component").groupBy("_component").applyInPandas(_fold(threshold, order), made_schema), "made")
        asked = made.where("_asked").select("_sid", F.struct(*order).alias("_after")).distinct()
        claim = base.select("_sid", "_text", F.struct(*order).alias("_at"))
        found = asked.join(claim, "_sid").where("_at > _after").groupBy("_sid", "_after").agg(F.min("_at").alias("_at"), F.first("_text").alias("_text"))
        found = found.select("_sid", "_text", "_at.*").distinct().join(folded.select("_sid", "_component"), "_sid")
        new = found.select("_component", "_sid", "_text", *order, key.alias("_key")).join(met.select("_key"), "_key", "left_anti").select(*met.columns)
        new = saved(new, "found")
        used += [made, new]
        if not new.count():
            settled.append(made)
            break
        # Only components with new claims are folded again.
        again = new.select("_component").distinct()
        settled.append(made.join(again, "_component", "left_anti"))
        met = saved(met.join(again, "_component", "left_semi").unionByName(new), "met")
        used.append(met)

    made = reduce(DataFrame.unionByName, settled)
    # The last folded claim of a statement at or before each claim says where it goes.
    places = made.where("not _asked").select("_sid", F.struct(*order).alias("_from"), "_rep", "_final")
    places = places.unionByName(alone.select("_sid", F.struct(*order).alias("_from"), key.alias("_rep"), F.col("_text").alias("_final")))
    places = places.withColumn("_until", F.lead("_from").over(Window.partitionBy("_sid").orderBy("_from")))
    now = base.withColumn("_at", at).join(places.select("_sid", "_from", "_until", "_rep"), "_sid").where((F.col("_at") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("_at") < F.col("_until"))))
    out = _aggregated(saved(now.drop("_from", "_until"), "joined"), places.where("_final is not null").select("_rep", "_final"), schema, order)
    out = saved(out, "merged")
    discard(base, statements, links, folded, *used)
    return out


def _union(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """_rep and the distinct values of its claims' arrays in the order in which they first come; the first claim's array where it is alone."""
    each = rows.select("_rep", "_at", F.posexplode(column).alias("_p", "_v"))
    first = each.groupBy("_rep", "_v").agg(F.min(F.struct("_at", "_p")).alias("_o"))
    return first.groupBy("_rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias(name))


def _aggregated(now: DataFrame, finals: DataFrame, schema: StructType, order: list[str]) -> DataFrame:
    own = [f.name for f in schema]
    total = [F.sum("recurrence").alias("_recurrence"), F.count("*").alias("_n"), F.min_by(F.struct(*own), "_at").alias("_first")]
    total += [F.max("confidence").alias("_confidence")] if "confidence" in own else []
    out = now.groupBy("_rep").agg(*total).join(finals, "_rep")
    empty = lambda t: F.array().cast(t)
    made: dict[str, Column] = {"recurrence": F.col("_recurrence").cast(schema["recurrence"].dataType), "statement": F.col("_final")}
    if "confidence" in own:
        made["confidence"] = F.col("_confidence")

    def union(column: str, path: str, kind) -> Column:
        """The union of an array column or field, joined to out."""
        nonlocal out
        name = f"_u_{path.replace('.', '_')}"
        out = out.join(_union(now, name, F.col(path)), "_rep", "left")
        return F.when(F.col("_n") == 1, F.coalesce(F.col(f"_first.{path}"), empty(kind))).otherwise(F.coalesce(F.col(name), empty(kind)))

    for column in ("tags", "sections"):
        if column not in own:
            continue
        kind = schema[column].dataType
        if isinstance(kind, StructType):
            made[column] = F.struct(*[union(column, f"{column}.{f.name}", f.dataType).alias(f.name) for f in kind])
        else:
            made[column] = union(column, column, kind)
    if "variants" in own:
        # A representative's own entries, empty ones too; of others' the first that isn't.
        entry = now.select("_rep", "_at", F.explode("variants").alias("_k", "_v")).join(out.select("_rep", F.struct(*[F.col(f"_first.{c}") for c in order]).alias("_start")), "_rep")
        entry = entry.where((F.col("_at") == F.col("_start")) | (F.coalesce("_v", F.lit("")) != "")).groupBy("_rep", "_k").agg(F.min(F.struct("_at", "_v")).alias("_e"))
        entry = entry.groupBy("_rep").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("_k"), F.col("_e._v"))))).alias("_variants"))
        out = out.join(entry, "_rep", "left")
        made["variants"] = F.coalesce("_variants", F.create_map().cast(schema["variants"].dataType))
    return out.select(*[made.get(c, F.col(f"_first.{c}")).alias(c) for c in own])
