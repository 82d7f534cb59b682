"""The named queries of the engine's own operators, each beside the SQL it is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import labels, profiles, ranking, sampled, stores

PARTS = (ranking, sampled, labels, profiles, stores)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: q for part in PARTS for n, q in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {n: s for part in PARTS for n, s in part.ORACLE_SQL.items()}
