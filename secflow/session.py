"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "secflow", extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the jobs assume. Cluster sizing is left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; without that setting a job on a cluster is refused, since a folder of
    one machine would be lost with it. A local session, as in tests, uses a folder in its warehouse.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    sc.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, for clusters where it isn't installed. Once a session."""
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), "secflow.zip")  # the driver's own copy, sent from there
    here = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage and drop its history (for iterative jobs)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read back, so that readers
    of one partition touch only that partition."""
    path = f"{checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
