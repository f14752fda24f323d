"""The detection job over a stream: events in; alerts, late and future rows out, each batch counted once.

A batch is read once and feeds all tables. Alerts go to a :class:`VersionedTable` keyed by alert id, so a repeated
batch changes nothing and an analyst's status stays; rows that came late or too far ahead are written by batch number, over what a lost attempt left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from secflow.plans import detect
from secflow.plans.rules import RULES, Rule
from secflow.sources import sinks
from secflow.sources.tables import VersionedTable
from secflow.streaming.windows_stream import rule_windows

ALERTS = "alert_id string, time bigint, rule_id string, tenant string, grp string, n bigint, status string, note string"


def alert_rows(out: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Alerts of rows of :func:`rule_windows`: windows over their rule's limit, and events of rules without a window. The newest of an alert counts."""
    over = detect.crossed(out.where("kind = 'window'"), rules).unionByName(out.where("kind = 'hit'"))
    keyed = detect.alert_ids(over)
    return (keyed.groupBy("alert_id").agg(F.max_by(F.struct(F.col("t").alias("time"), "rule_id", "tenant", "grp", "n"), F.struct("t", "n")).alias("x"))
            .select("alert_id", "x.*", F.lit("new").alias("status"), F.lit(None).cast("string").alias("note")))


def alert_table(spark: SparkSession, base: str, buckets: int = 64) -> VersionedTable:
    return VersionedTable(spark, f"{base}/alerts", "alert_id", ALERTS, buckets)


def side_rows(spark: SparkSession, base: str) -> DataFrame:
    """Late and future rows written so far."""
    return spark.read.parquet(f"{base}/aside")


def each_batch(base: str, rules: Sequence[Rule] = RULES, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of the job."""
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            alert_table(rows.sparkSession, base, buckets).apply(alert_rows(rows, rules), sinks.upsert_alerts, "stream", number)
            rows.where(F.col("kind").isin("late", "future")).write.mode("overwrite").parquet(f"{base}/aside/batch={number}")
        finally:
            rows.unpersist()

    return write


def start(events: DataFrame, base: str, rules: Sequence[Rule] = RULES, lateness: str = "10 minutes", mode: str = "clamp", **trigger) -> StreamingQuery:
    """The running job. ``trigger`` as for ``DataStreamWriter.trigger``. Needs the RocksDB state store."""
    out = rule_windows(events, rules, lateness, mode)
    writer = out.writeStream.foreachBatch(each_batch(base, rules)).option("checkpointLocation", f"{base}/log")
    return (writer.trigger(**trigger) if trigger else writer).start()
