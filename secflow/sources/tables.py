"""Tables that batches change: copy-on-write by bucket, versions, and batches that count once.

A table is a folder: ``data/<version>/bucket=<b>`` and ``versions/<n>``, one small JSON file each, which names for every bucket the
data version it is read from, and the last batch applied of each stream. A batch rewrites only the buckets its keys fall into, then
adds the next version file; the others go on being read from where they are. The version file is written aside and renamed, which
fails if that version exists: a reader sees a whole version or the one before, a job that is lost in between leaves data that
nothing names, and two writers can't both win. A batch that was applied before changes nothing, so ``foreachBatch`` may repeat it.

Files go through the session's own file system, so the folder may be in any store that Spark writes and renames in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Change = Callable[[DataFrame, DataFrame], DataFrame]


class VersionedTable:
    """``key`` decides the bucket of a row; ``buckets`` bounds what a batch rewrites and the size of a version file."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: Any, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit())

    def state(self, version: int | None = None) -> dict:
        """A version: its number, buckets by data version, and batches by stream."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": {}, "batches": {}}
        version = known[-1] if version is None else version
        stream = self._fs.open(self._path(f"{self.path}/versions/{version}"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one; of some buckets on demand."""
        held = {int(b): v for b, v in self.state(version)["buckets"].items() if only is None or int(b) in only}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(held.items())])

    def apply(self, batch: DataFrame, change: Change, stream: str = "batch", batch_id: int | None = None) -> int:
        """Replaces the touched buckets by ``change(their rows, batch)``; the version that holds the batch.

        ``change`` must keep rows in their bucket, that is, it must not change keys."""
        state = self.state()
        if batch_id is not None and state["batches"].get(stream, -1) >= batch_id:
            return state["version"]
        touched = {r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()}  # at most ``buckets`` numbers
        number = state["version"] + 1
        held = dict(state["buckets"])
        if touched:
            rows = change(self.read(only=touched), batch).select(*[F.col(f.name) for f in self.read(only=set()).schema.fields])
            place = f"{number}-{uuid.uuid4().hex[:8]}"
            # buckets come out of as many tasks as Spark makes of the exchange; a bucket may have several files
            rows.withColumn("bucket", self.bucket()).repartition("bucket", F.col(self.key)).write.partitionBy("bucket").parquet(f"{self.path}/data/{place}")
            folder = self._path(f"{self.path}/data/{place}")
            left = {int(f.getPath().getName().partition("=")[2]) for f in self._fs.listStatus(folder) if f.getPath().getName().startswith("bucket=")}
            held = {b: v for b, v in held.items() if int(b) not in touched} | {str(b): place for b in left}
        batches = state["batches"] | ({stream: batch_id} if batch_id is not None else {})
        self._publish({"version": number, "buckets": held, "batches": batches})
        return number

    def _publish(self, state: dict) -> None:
        folder = self._path(f"{self.path}/versions")
        self._fs.mkdirs(folder)
        aside, goal = self._path(f"{self.path}/versions/_{uuid.uuid4().hex}"), self._path(f"{self.path}/versions/{state['version']}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            out.close()
        if self._fs.exists(goal) or not self._fs.rename(aside, goal):
            self._fs.delete(aside, False)
            raise RuntimeError(f"version {state['version']} was written by another job")

    def writer(self, change: Change, stream: str) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function."""
        return lambda batch, batch_id: self.apply(batch, change, stream, batch_id) and None

    def unnamed(self, keep: int = 2) -> list[str]:
        """Data folders that none of the newest ``keep`` versions reads: what may be removed when no older reader is left."""
        named = {v for n in self.versions()[-keep:] for v in self.state(n)["buckets"].values()}
        folder = self._path(f"{self.path}/data")
        every = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(f"{self.path}/data/{n}" for n in every if n not in named)
