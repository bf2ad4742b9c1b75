"""Usage cost in local currency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars for a million tokens in and out, by model family; exchange rate.
PRICES = {"small": (1.0, 5.0), "large": (3.0, 15.0)}
RATE = 1400.0
CACHE_WRITE, CACHE_READ = 1.25, 0.1


def token_cost(price_in: Column, price_out: Column, tokens_in: Column, tokens_out: Column, rate: float = RATE, cache_write: Column | None = None, cache_read: Column | None = None) -> Column:
    """Rounded to one decimal; 0 where the model has no price."""
    m = 1_000_000
    usd = tokens_in / m * price_in + tokens_out / m * price_out
    if cache_write is not None:
        usd = usd + cache_write / m * (price_in * CACHE_WRITE)
    if cache_read is not None:
        usd = usd + cache_read / m * (price_in * CACHE_READ)
    return F.coalesce(F.round(usd * rate, 1), F.lit(0.0))


def prices_of(model: Column, prices: dict[str, tuple[float, float]] = PRICES) -> tuple[Column, Column]:
    """Exact model name first, else the family its name contains, else null."""
    exact_in = exact_out = family_in = family_out = F.lit(None).cast("double")
    for name, (p_in, p_out) in reversed(prices.items()):  # of several families the first counts
        exact_in, exact_out = F.when(model == name, p_in).otherwise(exact_in), F.when(model == name, p_out).otherwise(exact_out)
        family_in, family_out = F.when(model.contains(name), p_in).otherwise(family_in), F.when(model.contains(name), p_out).otherwise(family_out)
    return F.coalesce(exact_in, family_in), F.coalesce(exact_out, family_out)


def progress(done: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(done - 1, total), F.lit(0.0))


def rate(hits: Column, total: Column, digits: int = 3) -> Column:
    return F.coalesce(F.round(F.try_divide(hits, total), digits), F.lit(0.0))


def pages(total: Column, size: int) -> Column:
    return F.ceil(total / size).cast("long")
