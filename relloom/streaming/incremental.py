"""Incremental work as Structured Streaming: resume, event-time windows, rolling rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.sampling import null_safe
from ..session import exists

SPANS = 60


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: list[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """All new files of a folder, once, through ``transform`` to Parquet; rows with a known key are dropped, restarts included.

    No key is held as state: each micro-batch is joined against the keys of the sink, and goes to a folder of its own
    (``batch=number``), which a repeated batch overwrites. Null keys count as equal, as in a distinct.
    """
    rows = spark.readStream.schema(schema).json(source)

    def add(some: DataFrame, number: int) -> None:
        some = some.dropDuplicates(key)
        if exists(some.sparkSession, sink):
            kind = T.StructType([*[some.schema[k] for k in key], T.StructField("batch", T.LongType())])
            known = some.sparkSession.read.schema(kind).parquet(sink).where(F.col("batch") != number).select(*key)
            some = null_safe(some, known, key, "left_anti")
        some.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return micro_batches(transform(rows), add, checkpoint)


def micro_batches(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch to ``write`` with its number, so that a repeated batch can be recognised."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", size: str = "1 hour", late: str | None = None) -> DataFrame:
    """by, start, n, total of each window; ``late`` sets a watermark, for streams."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(by, F.window(ts, size).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(by, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, ts: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """by, start, n of each run of events with gaps below ``gap``."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def trailing(events: DataFrame, seconds: int = 60, ts: str = "ts", by: str = "user_id", value: str = "value") -> DataFrame:
    """Each event with the number and sum of its key's events in the trailing seconds, itself included.

    A key's events are dealt by spans of SPANS times that long, so that no task holds all of one key; those of a span's last
    seconds go to the next span too, to be counted there.
    """
    span = SPANS * seconds * 1_000_000
    rows = events.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_own", F.floor(F.col("_at") / span))
    late = F.col("_at") >= (F.col("_own") + 1) * span - seconds * 1_000_000
    rows = rows.withColumn("_span", F.explode(F.when(late, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    frame = Window.partitionBy(by, "_span").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    rows = rows.withColumn("n_trailing", F.count("*").over(frame)).withColumn("sum_trailing", F.sum(value).over(frame))
    return rows.where(F.col("_span").eqNullSafe(F.col("_own"))).drop("_at", "_own", "_span")
