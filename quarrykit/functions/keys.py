"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(title: Column, link: Column) -> Column:
    """First ten hex digits of md5(title + link)."""
    return F.substring(F.md5(F.concat(F.coalesce(title, F.lit("")), F.coalesce(link, F.lit(""))).cast("binary")), 1, 10)


def claim_id(source_id: Column, statement: Column) -> Column:
    return F.concat(F.lit("cl_"), F.substring(F.md5(F.concat_ws(":", source_id, statement).cast("binary")), 1, 8))


def padded_id(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def composite_key(number: Column, order: Column) -> Column:
    """number-order, or the number alone where there is no order."""
    return F.when(F.coalesce(order, F.lit("")) == "", number).otherwise(F.concat(number, F.lit("-"), order))
