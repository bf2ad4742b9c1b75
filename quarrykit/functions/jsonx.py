"""JSON in text columns and in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(text: Column, schema: str) -> Column:
    """Parsed value, null where the text is blank or malformed."""
    return F.from_json(F.nullif(F.trim(text), F.lit("")), schema)


def valid_json(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def json_in_text(text: Column) -> Column:
    """JSON text from a model's answer: a fenced block, the whole text, the outermost braces, else {}."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1), F.lit(""))
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((start > 0) & (F.instr(text, "}") > 0) & (end > start), F.substring(text, start, end - start + 1))
    return F.coalesce(valid_json(fenced), valid_json(text), valid_json(braces), F.lit("{}"))


def map_of(key: Column, value: Column) -> Column:
    """Aggregate: key/value rows as one map, in key order."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), value.alias("value")))))
