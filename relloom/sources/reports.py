"""Small reports written by the driver from aggregates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def bar(n: int, most: int, width: int = 50) -> str:
    return "#" * (int(n / most * width) if most else 0)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small DataFrame as a Markdown table, at most ``limit`` rows."""
    rows = df.limit(limit).collect()
    show = lambda x: f"{x:.6f}" if isinstance(x, float) else "" if x is None else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def metrics_json(df: DataFrame) -> str:
    """One row of metrics as JSON."""
    return json.dumps(df.first().asDict(recursive=True), ensure_ascii=False, indent=2)


def pivot_csv(df: DataFrame, path: str) -> None:
    """A report table as one CSV file with a header; a report has a row for each dataset."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
