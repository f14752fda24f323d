"""Writers: routed tables, upserts that keep triage, create-only inserts, dead letter, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.functions import scalars as S
from secflow.functions.predicates import closed
from secflow.operators import sets

# Retention in days per family.
RETENTION_DAYS = {"events-bank": 400, "events-datacenter": 90, "events-common": 90, "alerts": 365, "incidents": 365, "reports": 365}
TRIAGE_STATES = ("new", "in_progress", "resolved", "false_positive")


def routed(df: DataFrame) -> DataFrame:
    """Documents plus family, tenant and day; ``family`` is null where a document cannot be placed.

    Routing rejects a malformed tenant (detection would read it as the default one).
    """
    tenant_ok = closed(F.col("tenant").rlike(r"\A[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\z"))
    family = (F.when(F.col("kind") == "event", F.when(F.col("sector").isin("bank", "datacenter", "common"), F.concat(F.lit("events-"), "sector")))
              .when(F.col("kind").isin("alert", "incident", "report"), F.concat("kind", F.lit("s"))))
    return df.withColumn("family", F.when(tenant_ok & F.col("time").isNotNull(), family)).withColumn("day", S.day_of(F.col("time")))


def write_routed(df: DataFrame, base: str) -> DataFrame:
    """Append placeable documents by (family, tenant, day); returns the others for the dead letter."""
    rows = routed(df)
    good = rows.where("family is not null")
    good.repartition("family", "tenant", "day").write.mode("append").partitionBy("family", "tenant", "day").parquet(base)
    return rows.where("family is null").withColumn("errors", F.array(F.lit("unroutable"))).withColumn("stage", F.lit("route"))


def upsert_alerts(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Current alerts with a batch applied: newest payload wins, the analyst's status and note stay."""
    new = sets.latest_by(batch, ["alert_id"], "time")
    # An older payload than the stored one changes nothing.
    stored = current.select("alert_id", F.col("time").alias("_t"))
    new = new.join(stored, "alert_id", "left").where(F.col("_t").isNull() | (F.col("time") >= F.col("_t"))).select(*new.columns)
    kept = current.select("alert_id", F.col("status").alias("_s"), F.col("note").alias("_n"))
    merged = new.join(kept, "alert_id", "left").select(*[c for c in new.columns if c not in ("status", "note")],
                                                      F.coalesce("_s", "status").alias("status"), F.coalesce("_n", "note").alias("note"))
    return current.join(new.select("alert_id"), "alert_id", "left_anti").unionByName(merged.select(*current.columns))


def insert_if_absent(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key is not stored yet, each key once."""
    return sets.earliest_by(batch, [key], "time").join(current.select(key), key, "left_anti")


def apply_triage(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """Last valid status and last given note per alert, each on its own, so an update without a note keeps the one before."""
    valid = updates.where(F.col("status").isin(*TRIAGE_STATES))
    last = valid.groupBy("alert_id").agg(F.max_by("status", F.struct("at", "status")).alias("_s"), F.max_by("note", F.when(F.col("note").isNotNull(), F.struct("at", "note"))).alias("_n"))
    return alerts.join(last, "alert_id", "left").withColumn("status", F.coalesce("_s", "status")).withColumn("note", F.coalesce("_n", "note")).select(*alerts.columns)


def write_dead_letter(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("stage").parquet(path)


def dead_letter_summary(dead: DataFrame) -> DataFrame:
    return dead.groupBy("stage", F.array_join("errors", "; ").alias("error")).agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("example"))


def replay(dead: DataFrame) -> DataFrame:
    """Dead-letter rows as bronze again."""
    return dead.select("source_type", "raw", "meta")


def drop_expired(df: DataFrame, today: str, days: dict[str, int] | None = None) -> DataFrame:
    """Rows within their family's retention (a filter on the day partition); families without one are kept."""
    table = F.create_map(*[F.lit(x) for kv in (days or RETENTION_DAYS).items() for x in kv])
    return df.where(F.datediff(F.lit(today).cast("date"), F.col("day").cast("date")) <= F.coalesce(F.try_element_at(table, F.col("family")), F.lit(2**31 - 1)))
