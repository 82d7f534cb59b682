"""Shared parts of the training-data operators: splits, scratch tables, Arrow batches and bounded worker caches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch carries to a Python worker, and its target bytes; long documents keep batches small.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def held(key: str | Column, mod: int, rest: int) -> Column:
    """True for rows held out of fitting: crc32 of the id's text leaves ``rest``; a null id is held out."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % mod == rest, F.lit(True))


def held_id(key, mod: int, rest: int) -> bool:
    """The same rule for a Python value."""
    return key is None or zlib.crc32(str(key).encode()) % mod == rest


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return memory that a worker has freed to the system: workers stay alive between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over Arrow batches of ``df``, in batches of bounded size."""
    small_batches(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


class _Written(threading.local):
    """The tables that ``materialize`` has written inside each open ``scratch``."""

    def __init__(self):
        self.open: list[list[str]] = []


_written = _Written()


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder; it goes when the application ends.

    Where no such folder is set, a session on one machine (as in tests) uses a temporary one; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/relloom-checkpoints"
    path = f"{root.rstrip('/')}/relloom-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.mode("append").parquet(path)
    if _written.open:
        _written.open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(make):
    """A function that returns a DataFrame, so that the tables it has written go unless its result still reads them.

    What the result reads stays until the application ends: nobody can tell when it has been read for the last time.
    """

    def run(df: DataFrame, *args, **more) -> DataFrame:
        _written.open.append([])
        try:
            out = make(df, *args, **more)
        finally:
            paths = _written.open.pop()
        read = {f.rpartition("/")[0].rpartition("/")[2] for f in out.inputFiles()}
        for path in paths:
            if path.rpartition("/")[2] not in read:
                remove(df.sparkSession, path)
            elif _written.open:
                _written.open[-1].append(path)
        return out

    run.__name__, run.__doc__ = make.__name__, make.__doc__
    return run


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


class Cache(dict):
    """A bounded worker cache: at ``cap`` entries the present generation becomes the old one, and the one before goes."""

    def __init__(self, make, cap: int):
        super().__init__()
        self.make, self.cap, self.old = make, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.cap:
            self.old = dict(self)
            self.clear()


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with the columns in the schema's order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, per_class: int, max_chars: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most ``per_class`` training documents of each label 0 and 1, taken in hash order.

    Only this bounded sample reaches the driver: one text for each chosen id, of several the one with the smallest hash. Ids
    are chosen from the narrow label table alone; texts longer than ``max_chars`` are left out of fitting (never out of
    scoring). A document with several labels counts as 1.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held("doc_id", mod, rest)).groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect() for y in (0, 1)]
    chosen = [(r["doc_id"], r["label"]) for part in parts for r in part]
    if not chosen:
        return []
    wanted = spark.createDataFrame(chosen, "doc_id long, label int")  # at most 2 * per_class rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    rows = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first"))
    return sorted((r["doc_id"], r["text"], r["label"]) for r in rows.select("doc_id", "label", "first.text").collect())


class WordRows(dict):
    """Words to rows of a float32 matrix that ``make`` fills for many new words at a time; at ``cap`` words it starts anew."""

    #: Words that are looked up at a time, so that a very long text can't outgrow the matrix.
    STEP = 1 << 17

    def __init__(self, make, width: int, cap: int = 250_000):
        super().__init__()
        self.make, self.cap = make, cap
        self.matrix = np.zeros((1 << 12, width), np.float32)

    def at(self, words: list) -> np.ndarray:
        """Row numbers of at most STEP words."""
        fresh = set(words).difference(self)
        if fresh:
            if len(self) + len(fresh) > self.cap:
                self.clear()
                fresh = set(words)
            fresh, first = list(fresh), len(self)
            while first + len(fresh) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[first : first + len(fresh)] = self.make(fresh)
            self.update(zip(fresh, range(first, first + len(fresh))))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
