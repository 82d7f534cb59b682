"""Checks that the optimizer can't leave out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def asserted(good: Column, message: Column) -> Column:
    """A filter condition: true where ``good`` is, and an error with ``message`` otherwise. As a filter it counts whatever is read."""
    return F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
