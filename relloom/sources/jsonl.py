"""JSON lines in and out: strict, lenient, validating and sniffing scans; durable, atomic and side sinks."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import asserted

GRADED = "query string, documents array<struct<content:string, relevance_score:double, relevance:double>>, pos_list array<string>, neg_list array<string>"


def strict(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Malformed lines raise; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient(spark: SparkSession, path: str | list[str], schema: str, keep_bad: bool = False) -> DataFrame:
    """Malformed lines are dropped, or kept in ``_corrupt_record`` for counting."""
    if not keep_bad:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    kind = T._parse_datatype_string(schema).add("_corrupt_record", "string")
    return spark.read.schema(kind).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def validated(df: DataFrame, rules: dict[str, Column], shown: str | None = None) -> DataFrame:
    """Rows that meet every rule; one that doesn't raises an error with the rule, the file and, if there is one, column ``shown``.

    The rules are filters, so they hold whichever columns are read and when rows are only counted.
    """
    told = F.concat(F.lit(": "), F.substring(F.coalesce(F.col(shown).cast("string"), F.lit("")), 1, 200)) if shown else F.lit("")
    for name, rule in rules.items():
        df = df.where(asserted(rule, F.concat(F.lit(f"{name} in "), F.col("_file"), told)))
    return df


def triples(spark: SparkSession, path: str) -> DataFrame:
    """query, pos_list (not empty), neg_list."""
    rows = lenient(spark, path, "query string, pos_list array<string>, neg_list array<string>", keep_bad=True).withColumn("_file", F.col("_metadata.file_path"))
    full = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull())
    rows = validated(rows, {"malformed line": F.col("_corrupt_record").isNull()}, "_corrupt_record")
    rules = {"query": F.col("query").isNotNull(), "pos_list": full("pos_list") & (F.size("pos_list") > 0), "neg_list": full("neg_list")}
    return validated(rows, rules, "query").select("query", "pos_list", "neg_list")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line (from 1), text of every line that isn't an object of ``schema``: what to mend after a scan has raised.

    Files are numbered whole, each in one task; this is a tool for the error path, not for a scan.
    """
    rows = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                lines = content.as_py().decode("utf-8", "replace").split("\n")
                shown = [(k + 1, x) for k, x in enumerate(lines) if x.strip()]
                for at in range(0, len(shown), 4096):
                    some = shown[at : at + 4096]
                    yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(some), pa.string()), "line": pa.array([k for k, _ in some], pa.int64()), "text": pa.array([x for _, x in some], pa.string())})

    numbered = rows.mapInArrow(run, "file string, line long, text string")
    kind = T._parse_datatype_string(schema).add("_corrupt_record", "string")
    return numbered.withColumn("_x", F.from_json("text", kind, {"mode": "PERMISSIVE"})).where(F.col("_x._corrupt_record").isNotNull()).drop("_x")


def sniffed(spark: SparkSession, path: str) -> str:
    """'documents' or 'pos_neg', by the first record; an empty file raises."""
    first = spark.read.schema(GRADED).json(path).select(F.col("documents").isNotNull().alias("d")).head(1)
    if not first:
        raise ValueError(f"{path} has no record")
    return "documents" if first[0]["d"] else "pos_neg"


def samples(spark: SparkSession, path: str) -> DataFrame:
    """query, documents array<string>, relevance array<double> of either format; both names of the grade are read."""
    rows = spark.read.schema(GRADED).json(path)
    if sniffed(spark, path) == "documents":
        rows = validated(rows.withColumn("_file", F.col("_metadata.file_path")), {"query": F.col("query").isNotNull(), "documents": F.coalesce(F.size("documents") > 0, F.lit(False))}, "query")
        grade = F.transform("documents", lambda d: F.coalesce(d["relevance_score"], d["relevance"]))
        return rows.select("query", F.transform("documents", lambda d: d["content"]).alias("documents"), grade.alias("relevance"))
    rows = triples(spark, path)
    grades = F.concat(F.transform("pos_list", lambda x: F.lit(1.0)), F.transform("neg_list", lambda x: F.lit(0.0)))
    return rows.select("query", F.concat("pos_list", "neg_list").alias("documents"), grades.alias("relevance"))


def _system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def datasets(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's ``*.jsonl``, sorted; each is a file or a folder of part files."""
    system, path = _system(spark, folder)
    names = [s.getPath().getName() for s in system.listStatus(path)]
    return sorted(n[: -len(".jsonl")] for n in names if n.endswith(".jsonl"))


def merged(spark: SparkSession, folder: str, names: list[str], schema: str) -> DataFrame:
    """The named files that exist, with their name in ``src``."""
    there = set(datasets(spark, folder))
    found = [f"{folder}/{n}.jsonl" for n in names if n in there]
    if not found:
        return spark.createDataFrame([], schema).withColumn("src", F.lit(None).cast("string"))
    return spark.read.schema(schema).json(found).withColumn("src", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl(?:/[^/]*)?$", 1))


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_array(df: DataFrame, path: str, order: str) -> None:
    """A small DataFrame as one JSON array in one file, in ``order``; the elements are written as they stream by."""
    spark = df.sparkSession
    system, target = _system(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(b"[")
        for k, r in enumerate(encoded(df.orderBy(order)).toLocalIterator()):
            stream.write((",\n" if k else "\n").encode() + r["value"].encode())
        stream.write(b"\n]\n")
    finally:
        stream.close()


def encoded(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def append(df: DataFrame, path: str) -> None:
    """New files beside the old ones; the commit protocol shows all of a job's rows or none."""
    encoded(df).write.mode("append").text(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that ``replace`` has committed and not yet removed."""
    system, target = _system(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []
    return sorted(int(n[len("version=") :]) for n in names if n.startswith("version=") and n[len("version=") :].isdigit())


def current(spark: SparkSession, path: str) -> str:
    """Where the rows of ``path`` are read: the last version that ``replace`` committed, or the folder that was appended to."""
    found = versions(spark, path)
    return f"{path}/version={found[-1]}" if found else path


def replace(df: DataFrame, path: str, kept: int = 2) -> None:
    """New rows as the next version of ``path``, which may have been read from its present one; read it at ``current``.

    A version appears complete, by one rename, beside the one before, so there is always one to read. The last ``kept``
    versions stay for readers under way. Of two writers at once the second raises and can try again.
    """
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    found = versions(spark, path)
    encoded(df).write.text(aside)
    system, target = _system(spark, path)
    system.mkdirs(target)
    number = found[-1] + 1 if found else 1
    new, goal = _system(spark, aside)[1], _system(spark, f"{path}/version={number}")[1]
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(new, goal, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:
        system.delete(new, True)
        raise
    for status in system.listStatus(target):
        name = status.getPath().getName()
        old = int(name[len("version=") :]) <= number - kept if name.startswith("version=") and name[len("version=") :].isdigit() else True
        if old:
            system.delete(status.getPath(), True)


def upsert(spark: SparkSession, rows: DataFrame, path: str, key: str) -> DataFrame:
    """A key-value cache in Parquet: appended with an increasing batch number; the last value of a key counts."""
    system, target = _system(spark, path)
    known = spark.read.parquet(path) if system.exists(target) else None
    batch = 0 if known is None else (known.agg(F.max("batch")).first()[0] or 0) + 1
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(path)
    every = spark.read.parquet(path)
    rest = [c for c in every.columns if c not in (key, "batch")]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(key, "x.*")


def preview(df: DataFrame, query: str, keywords: str, path: str) -> None:
    """Text lines of rows with keywords."""
    df.where(F.col(keywords).isNotNull()).select(F.concat(F.lit("Q: "), query, F.lit("\nK: "), keywords, F.lit("\n")).alias("value")).write.text(path)
