"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable files. Files fall in tiers by size, each tier FAN times the one below; once a tier
holds FAN files, all of them are merged, without a shuffle, into files near the target size. Every change is one new manifest
version: its file list is written aside and renamed to the next number, which fails if another writer has taken it; the loser
puts its change on top of the winner's version, and a merge whose files are gone by then is given up. Readers see the last
complete version; a crash leaves only files that no manifest names. ``vacuum`` removes these, and those of versions that are no
longer kept, once they are old enough that no writer can still be about to commit them. The rename is atomic on HDFS and local
file systems; on an object store without atomic renames one writer at a time must be seen to from outside.

A store keeps whole rows, all columns, and repeated rows; nulls and empty texts are rows like others; an empty arrival adds a
version but no file. Files of half the target or more are never merged again.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove, shared_dir

#: Bytes of a full file and of the lowest tier; files of a tier that are merged.
TARGET, BASE, FAN = 64 << 20, 1 << 20, 4
#: Tries to commit; versions that ``vacuum`` keeps, and seconds before it takes files for abandoned; files whose list is broadcast.
TRIES, KEPT, AGE, FEW = 20, 2, 86_400.0, 100_000


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, base: int = BASE, fan: int = FAN):
        self.spark, self.root, self.target, self.base, self.fan = spark, root.rstrip("/"), target, base, fan
        self.hadoop = spark._jvm.org.apache.hadoop.fs

    def path(self, *parts: str):
        return self.hadoop.Path("/".join([self.root, *parts]))

    def system(self):
        return self.path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self.path("manifest")
        if not self.system().exists(folder):
            return []
        names = [s.getPath().getName() for s in self.system().listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "files": [{"path", "bytes"}]} of a version, the last by default."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "files": []}
        stream = self.system().open(self.path("manifest", f"v{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, before: dict, files: list[dict], schema: str) -> dict:
        """Write the next version; fails if it exists by then."""
        after = {"version": before["version"] + 1, "schema": schema, "files": sorted(files, key=lambda f: f["path"])}
        aside = self.path("manifest", f".{uuid.uuid4().hex}")
        stream = self.system().create(aside, False)
        stream.write(json.dumps(after).encode())
        stream.close()
        context = self.hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(aside, self.path("manifest", f"v{after['version']:012d}.json"), options)
        return after

    def written(self, rows: DataFrame) -> list[dict]:
        """New immutable files with these rows."""
        run = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{run}")
        found = self.system().listStatus(self.path(run))
        return [{"path": f"{run}/{s.getPath().getName()}", "bytes": int(s.getLen())} for s in found if s.getPath().getName().startswith("part-")]

    def changed(self, make, schema: str | None = None) -> dict:
        """The next version with the files that ``make`` puts in place of the present ones; None from it gives the change up."""
        for _ in range(TRIES):
            now = self.manifest()
            files = make(now["files"])
            if files is None:
                return now
            try:
                return self.commit(now, files, schema or now["schema"])
            except Py4JJavaError as lost:
                if "Exist" not in lost.java_exception.getClass().getSimpleName():
                    raise
        raise RuntimeError(f"{self.root}: {TRIES} versions were taken by other writers")

    def append(self, rows: DataFrame) -> dict:
        files = self.written(rows)
        return self.changed(lambda now: now + files, rows.schema.json())

    def tier(self, size: int) -> int:
        return 0 if size < self.base else 1 + int(math.log(size / self.base, self.fan) + 1e-9)

    def due(self, files: list[dict]) -> list[dict]:
        """The files of the lowest tier that is to be merged."""
        tiers: dict[int, list[dict]] = {}
        for f in files:
            if 2 * f["bytes"] < self.target:
                tiers.setdefault(self.tier(f["bytes"]), []).append(f)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan), [])

    def compact(self) -> dict:
        """Merge until no tier is due; each merge is a version of its own."""
        now = self.manifest()
        while merged := self.due(now["files"]):
            count = max(1, round(sum(f["bytes"] for f in merged) / self.target))
            gone = {f["path"] for f in merged}
            files = self.written(self.opened(merged, now["schema"]).coalesce(count))
            now = self.changed(lambda there: [f for f in there if f["path"] not in gone] + files if gone <= {f["path"] for f in there} else None)
        return now

    def opened(self, files: list[dict], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.root}/{f['path']}" for f in files))

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if not found["version"]:
            raise ValueError(f"{self.root} has no version")
        return self.opened(found["files"], found["schema"])

    def vacuum(self, keep: int = KEPT, age: float = AGE) -> int:
        """Delete the runs that none of the last ``keep`` versions names, if they are older than ``age`` seconds; how many went.

        A writer commits its files within ``age`` of their making. Manifests stay; versions before the kept ones can't be read.
        """
        named = {f["path"].split("/")[1] for v in self.versions()[-keep:] for f in self.manifest(v)["files"]}
        folder, gone = self.path("data"), 0
        if not self.system().exists(folder):
            return 0
        last = 1000 * (time.time() - age)
        for s in self.system().listStatus(folder):
            name = s.getPath().getName()
            if name in named:
                continue
            made = max([s.getModificationTime(), *(f.getModificationTime() for f in self.system().listStatus(s.getPath()))])
            if made <= last:
                remove(self.spark, f"{self.root}/data/{name}")
                gone += 1
        return gone


def sharded(docs: DataFrame, arrivals: int = 4) -> DataFrame:
    """doc_id, shard (its number in the manifest), shard_bytes and version of every row, after all arrivals are compacted.

    The table is dealt to its arrivals in one pass. Nobody else writes to this store, so what a merge has replaced goes at once.
    """
    spark = docs.sparkSession
    store, dealt = Store(spark, shared_dir(spark)), shared_dir(spark)
    docs.withColumn("relloom_arrival", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(arrivals)).cast("int")).write.mode("append").partitionBy("relloom_arrival").parquet(dealt)
    for k in range(arrivals):
        arrived = f"{dealt}/relloom_arrival={k}"
        there = store.system().exists(store.hadoop.Path(arrived))
        store.append(spark.read.schema(docs.schema).parquet(arrived) if there else docs.limit(0))
        store.compact()
        store.vacuum(keep=1, age=0)
    remove(spark, dealt)
    last = store.manifest()
    names = {f["path"].rsplit("/", 1)[1]: (i, f["bytes"]) for i, f in enumerate(last["files"])}
    rows = store.read().select(F.col("doc_id").cast("long").alias("doc_id"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    files = spark.createDataFrame([(n, i, b) for n, (i, b) in names.items()], "file string, shard int, shard_bytes long")  # as many rows as files
    files = F.broadcast(files) if len(names) <= FEW else files
    return rows.join(files, "file").select("doc_id", "shard", "shard_bytes", F.lit(last["version"]).alias("version"))
