"""Built-in stream forms: redelivery taken out, tumbling counts and session tracks. Sliding windows of rules are in ``windows_stream``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def redelivered_once(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """At-least-once input with each (tenant, ingest_id) kept once within the lateness bound. Needs ``ts``."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["tenant", "ingest_id"])


def tumbling_counts(events: DataFrame, keys: list[str], width: str, lateness: str = "10 minutes") -> DataFrame:
    return (events.withWatermark("ts", lateness).groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, F.unix_millis("window.start").alias("start_ms"), "n"))


def track_sessions(alerts: DataFrame, keys: list[str], gap: str = "24 hours", lateness: str = "1 hour") -> DataFrame:
    return (alerts.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
            .select(*keys, F.unix_millis("lo").alias("first_seen"), F.unix_millis("hi").alias("last_seen"), "n"))
