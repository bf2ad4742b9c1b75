"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrykit.plans import changes, forms, records, runs, search, sequences, sites, state, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (search, changes, sequences, texts, records, runs, forms, sites, state):
    QUERIES |= _module.REGISTRY.queries
    ORACLES |= _module.REGISTRY.oracles
