"""Row keys and the engine's only source of randomness: uniform numbers and orders derived from MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def seeded(seed: str, key) -> Column:
    """MD5 of ``seed|key``: a reproducible shuffle order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), _column(key).cast("string")).cast("binary"))


def hash01(seed: str, key) -> Column:
    """A reproducible uniform number in [0, 1) for each key."""
    return F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pair_key(query="query", document="document") -> Column:
    """SHA-256 of query and document, a line break between; null counts as empty."""
    return F.sha2(F.concat_ws("\n", F.coalesce(_column(query), F.lit("")), F.coalesce(_column(document), F.lit(""))).cast("binary"), 256)


def annotator_key(query="query", document="document", model="model_name") -> Column:
    """The pair's key for one annotator."""
    parts = [F.coalesce(_column(c), F.lit("")) for c in (query, document, model)]
    return F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256)


def short_key(text) -> Column:
    """The first 16 hex digits of a text's SHA-256."""
    return F.substring(F.sha2(F.coalesce(_column(text), F.lit("")).cast("binary"), 256), 1, 16)


def row_key(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys; equal rows have equal keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
