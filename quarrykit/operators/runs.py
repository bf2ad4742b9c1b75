"""Runs of collectors, extractions and analyses: their states, markers, counters and stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

STATES = ("pending", "processing", "completed", "failed")
MOST_NAME = 500
RECORD = "array<map<string,string>>"


def latest_state(events: DataFrame, key: str, order: str = "at") -> DataFrame:
    """State of each run from its appended log: the last event's state, progress and message, and when it was completed.

    The log is append-only (a run writes a row per step), so any reader can follow a
    run's progress; unknown states are refused.
    """
    known = F.when(F.col("state").isin(*STATES), F.col("state")).otherwise(F.raise_error(F.concat(F.lit("unknown state: "), F.coalesce("state", F.lit("null")))))
    last = F.max_by(F.struct(known.alias("state"), "progress", "message"), order)
    ended = F.max(F.when(F.col("state").isin("completed", "failed"), F.col(order)))
    return events.groupBy(key).agg(last.alias("_s"), ended.alias("completed_at"), F.count("*").alias("steps")).select(key, "_s.*", "completed_at", "steps")


def last_collected(runs: DataFrame, source: str = "source", at: str = "at", count: str = "collected") -> DataFrame:
    """Marker of each source: when it was last collected, and how many rows came."""
    return runs.groupBy(source).agg(F.max(at).alias("last_collected_at"), F.max_by(F.coalesce(count, F.lit(0)), at).alias("last_collected_count"))


def counters(collected: DataFrame, matched: Column, known: DataFrame, key: str, source: str = "source") -> DataFrame:
    """Per source: rows collected, matched, and of the matched ones new (inserted) and known (updated)."""
    have = known.select(key).distinct().withColumn("_known", F.lit(True))
    rows = collected.join(have, key, "left").withColumns({"_known": F.coalesce("_known", F.lit(False)), "_m": F.coalesce(matched, F.lit(False))})
    return rows.groupBy(source).agg(
        F.count("*").alias("collected"), F.count_if("_m").alias("matched"), F.count_if(F.col("_m") & ~F.col("_known")).alias("inserted"), F.count_if(F.col("_m") & F.col("_known")).alias("updated")
    )


def hint_rows(hints: DataFrame) -> DataFrame:
    """Hints as stored: the name cut to its bound, org before organization, the model as extractor where none is named."""
    return hints.select(
        "source_id", "type", F.substring(F.coalesce("name", F.lit("")), 1, MOST_NAME).alias("name"), "year", F.coalesce(F.nullif("org", F.lit("")), F.col("organization")).alias("organization"),
        "section", F.coalesce("extractor", F.lit("llm")).alias("extractor"),
    )


def analysis_rows(analyses: DataFrame) -> DataFrame:
    """Results as stored, by how far an analysis came: full, parsed only (no match), or simple."""
    full = F.col("mode") == "full"
    matched = full & F.col("match_rate").isNotNull()
    only = lambda when, c: F.when(when, F.col(c))
    return analyses.select(
        "notice_id", "analysis_seq", "mode", F.when(~full, "simple").when(matched, "full").otherwise("parsed").alias("kind"), only(full, "parsed_criteria").alias("parsed_criteria"),
        only(full, "parsed_summary").alias("parsed_summary"), only(matched, "match_rate").alias("match_rate"), only(matched, "match_detail").alias("match_detail"),
        only(~full, "simple_grade").alias("simple_grade"), only(~full, "simple_reason").alias("simple_reason"),
    )


def shown(analyses: DataFrame) -> DataFrame:
    """What a reader gets: summary, items and criteria of a full analysis, grade and reason of a simple one."""
    full = F.col("mode") == "full"
    # A text that is not JSON reads as no items.
    parsed = lambda c: F.coalesce(F.from_json(F.coalesce(c, F.lit("[]")), RECORD), F.array().cast(RECORD))
    return analyses.select(
        "notice_id", "analysis_seq", "mode",
        F.when(full, F.struct(F.col("parsed_summary").alias("summary"), parsed("match_detail").alias("items"), parsed("parsed_criteria").alias("criteria"))).alias("full"),
        F.when(~full, F.struct(F.col("simple_grade").alias("grade"), F.col("simple_reason").alias("reason"))).alias("simple"),
    )


def with_attachments(notices: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """Notices with the JSON text of their attachments (name, url; by place), as written back; null where none was fetched."""
    per = files.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", "name", "url"))), lambda x: F.struct(x["name"].alias("name"), x["url"].alias("url")))).alias("attachments"))
    return notices.join(per, key, "left")


def wants_attachments(tag: Column, source_kind: Column, attachments: Column, url: Column) -> Column:
    """A notice whose files are to be fetched now."""
    return tag.isin("review", "bid") & (source_kind != "procurement") & F.coalesce(F.trim(attachments).isin("", "[]"), F.lit(True)) & (F.coalesce(url, F.lit("")) != "")


def export(sources: DataFrame, claims: DataFrame, hints: DataFrame, key: str = "source_id") -> DataFrame:
    """One nested row per source, ready for write.json: the source, its claims and hints by id.

    A source's own rows are one array, as the document is; sources without any have empty ones.
    """
    nested = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in df.columns if c not in (key, "id")]))).alias(name))
    out = sources.join(nested(claims, "claims"), key, "left").join(nested(hints, "hints"), key, "left")
    return out.withColumns({"n_claims": F.coalesce(F.size("claims"), F.lit(0)), "n_hints": F.coalesce(F.size("hints"), F.lit(0))})


def with_flag(rows: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """rows with whether known has their key."""
    return rows.join(known.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def claim_record(claims: DataFrame) -> DataFrame:
    """Stored claims with their JSON columns read and defaults for what is missing."""
    words = "array<string>"
    tags = "struct<domain: array<string>, audience: array<string>, method: array<string>>"
    none = F.from_json(F.lit('{"domain":[],"audience":[],"method":[]}'), tags)
    listed = lambda c: F.coalesce(F.from_json(c, words), F.array().cast(words))
    return claims.select(
        "claim_id", F.coalesce(F.nullif("user_edited_statement", F.lit("")), F.col("statement")).alias("statement"), F.col("statement").alias("statement_original"),
        F.coalesce(F.from_json("tags", tags), none).alias("tags"), listed("proposal_sections").alias("proposal_sections"), F.coalesce(F.from_json("length_variants", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("length_variants"),
        listed("merged_from").alias("merged_from"),
    )


def page_plan(keywords: DataFrame, kinds: list[str], first: Column, last: Column, days: int = 7) -> DataFrame:
    """Requests of a collection run: kind x keyword x piece of at most days days, from first to last."""
    starts = F.sequence(first, last, F.make_interval(days=F.lit(days)))
    end = F.least(F.date_add(F.col("start"), days - 1), last)
    return keywords.select("keyword").distinct().select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"), "keyword", F.explode(starts).alias("start")).withColumn("end", end)


# What a run may do after each state; a run begins as pending, or processing where nothing waits.
NEXT = {"": ("pending", "processing"), "pending": ("processing", "failed"), "processing": ("processing", "completed", "failed"), "completed": (), "failed": ("pending", "processing")}


def checked(events: DataFrame, key: str, order: str = "at", graph: dict[str, tuple[str, ...]] = NEXT) -> DataFrame:
    """events with before (the run's state until then) and error (null, or what is wrong); a refused event changes nothing.

    A run's events are its steps, so they fit an array; they are folded by built-ins.
    """
    allowed = F.create_map(*[x for s, after in graph.items() for x in (F.lit(s), F.array(*map(F.lit, after)).cast("array<string>"))])
    rest = [c for c in events.columns if c not in (key, order, "state")]
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.col("state").alias("_state"), F.struct(*rest, F.lit(0).alias("_")).alias("_rest")))).alias("_e"))
    step = lambda acc, e: F.struct(
        F.when(F.coalesce(F.array_contains(allowed[acc["now"]], e["_state"]), F.lit(False)), e["_state"]).otherwise(acc["now"]).alias("now"),
        F.array_append(acc["before"], acc["now"]).alias("before"),
    )
    folded = F.aggregate("_e", F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("before")), step, lambda acc: acc["before"])
    rows = listed.select(key, F.explode(F.arrays_zip(F.col("_e").alias("e"), folded.alias("before"))).alias("x"))
    state, before = F.col("x.e._state"), F.col("x.before")
    fine = F.coalesce(F.array_contains(allowed[before], state), F.lit(False))
    error = F.when(~fine, F.concat(F.coalesce(F.nullif(before, F.lit("")), F.lit("nothing")), F.lit(" to "), F.coalesce(state, F.lit("null"))))
    return rows.select(key, F.col("x.e._at").alias(order), state.alias("state"), *[F.col(f"x.e._rest.{c}").alias(c) for c in rest], before.alias("before"), error.alias("error"))


def observed(sources: dict[str, DataFrame], matched: Column | None = None) -> tuple[DataFrame, dict[str, Observation]]:
    """All sources' rows with their source, and an observation of each: rows collected and matched, known once the rows were written, without a scan of their own."""
    seen = {name: Observation(f"collected {name}") for name in sources}
    count = F.count_if(F.coalesce(matched, F.lit(False))) if matched is not None else F.count(F.lit(1))
    parts = [df.observe(seen[name], F.count(F.lit(1)).alias("collected"), count.alias("matched")).withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out, seen
