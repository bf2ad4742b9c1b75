"""Dates as text: normalising, finding, open/closed status, request ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_date(text: Column) -> Column:
    """yyyy-MM-dd from dashed, dotted, 8-digit and 12-digit forms; else the trimmed input ('' for null)."""
    t = F.trim(F.coalesce(text, F.lit("")))
    digits = F.regexp_replace(t, "[- :]", "")
    long_form = F.to_date(F.try_to_timestamp(F.substring(digits, 1, 12), F.lit("yyyyMMddHHmm")))
    short_form = F.when(digits.rlike("^[0-9]{8}"), F.to_date(F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd"))))
    parsed = F.when(F.length(digits) >= 12, long_form).when(F.length(digits) >= 8, short_form)
    return (
        F.when(t == "", F.lit(""))
        .when((F.length(t) >= 10) & (F.substring(t, 5, 1) == "-") & (F.substring(t, 8, 1) == "-"), F.substring(t, 1, 10))
        .when((F.length(t) >= 10) & (F.substring(t, 5, 1) == "."), F.translate(F.substring(t, 1, 10), ".", "-"))
        .otherwise(F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), t))
    )


def _dashed(year: Column, month: Column, day: Column) -> Column:
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day))


def find_date(text: Column) -> Column:
    """First date-like run in a text as yyyy-MM-dd (unvalidated), null if there is none.

    Forms in order: four-digit year, two-digit year (from 80 on: 19xx), eight
    digits, year-month-day marked by 년, 월, 일.
    """
    t = F.trim(text)
    get = lambda p, i: F.regexp_extract(t, p, i)
    four = r"(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})"
    two = r"(\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})"
    eight = r"(\d{4})(\d{2})(\d{2})"
    marked = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
    year2 = get(two, 1).cast("int")
    century = F.when(year2 < 80, 2000 + year2).otherwise(1900 + year2).cast("string")
    return (
        F.when(t.rlike(four), _dashed(get(four, 1), get(four, 2), get(four, 3)))
        .when(t.rlike(two), _dashed(century, get(two, 2), get(two, 3)))
        .when(t.rlike(eight), F.concat_ws("-", get(eight, 1), get(eight, 2), get(eight, 3)))
        .when(t.rlike(marked), _dashed(get(marked, 1), get(marked, 2), get(marked, 3)))
    )


def as_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def status(end: Column, as_of: Column) -> Column:
    """closed once the deadline's midnight has passed; ongoing if it is missing or unreadable."""
    return F.when(as_date(F.substring(end, 1, 10)).cast("timestamp") < as_of.cast("timestamp"), F.lit("closed")).otherwise(F.lit("ongoing"))


def in_last_days(start: Column, as_of: Column, days: int | Column) -> Column:
    """start (yyyy-MM-dd text) within days of as_of; blank or null fails."""
    n = F.lit(days) if isinstance(days, int) else days
    return start >= F.date_format(F.date_sub(as_of.cast("date"), n), "yyyy-MM-dd")


def days_back(start: Column, as_of: Column) -> Column:
    """Whole days from start to as_of, counting both; 1 at least and where start is unreadable."""
    return F.greatest(F.coalesce(F.datediff(as_of.cast("date"), as_date(start)) + 1, F.lit(1)), F.lit(1))


def date_chunks(start: Column, end: Column, days: int = 7) -> Column:
    """array<struct<lo, hi>> of stretches of at most so many days; the next begins a second later."""
    cuts = F.sequence(start.cast("timestamp"), end.cast("timestamp"), F.expr(f"interval {days} days"))
    hi = lambda lo, i: F.least(lo + F.expr(f"interval {days} days"), end.cast("timestamp"))
    pieces = F.transform(cuts, lambda lo, i: F.struct(F.when(i == 0, lo).otherwise(lo + F.expr("interval 1 second")).alias("lo"), hi(lo, i).alias("hi")))
    return F.filter(pieces, lambda p: p["lo"] <= p["hi"])


def month_start(day: Column) -> Column:
    return F.trunc(day.cast("date"), "MM")
