"""Assets, address history, new devices and per-entity baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.functions import scalars as S
from secflow.operators.joins import interval_lookup
from secflow.operators.sliding import beside, novelty, sliding_count


def validate_obs(obs: DataFrame) -> DataFrame:
    """Observations with typed time and the list of what is wrong with them."""
    t, mac, ip = S.coerce_ms(F.col("seen_at")), S.valid_mac(F.col("mac")), S.valid_ip(F.col("ip"))
    bad = {"time": t.isNull(), "mac": mac.isNull(), "ip": F.col("ip").isNotNull() & ip.isNull()}
    return obs.select("tenant_id", mac.alias("mac"), ip.alias("ip"), "hostname", t.alias("t"),
                      F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad.items()])).alias("errors"))


def assets(obs: DataFrame) -> DataFrame:
    """Current row per device: the newest known value of each field (nothing erases a known value)."""
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("t", c)))[c].alias(c)
    return obs.groupBy("tenant_id", "mac").agg(newest("ip"), newest("hostname"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))


def ip_history(obs: DataFrame) -> DataFrame:
    """Intervals [from_ts, to_ts) in which a device held an address; the last one is open."""
    rows = obs.where("ip is not null").groupBy("tenant_id", "mac", "t").agg(F.max("ip").alias("ip"))
    device = ["tenant_id", "mac"]
    changed = beside(rows, device, "t", "ip", "prev").where("prev is null or prev <> ip").drop("prev")
    return beside(changed, device, "t", "t", "to_ts", after=True).select("tenant_id", "mac", "ip", F.col("t").alias("from_ts"), "to_ts")


def resolve_ip_at(events: DataFrame, history: DataFrame, time: str = "t") -> DataFrame:
    """``events`` plus the device that held their ip at their time."""
    return interval_lookup(events, history, ["tenant_id", "ip"], time, "from_ts", "to_ts", ["mac"])


def new_devices(obs: DataFrame, baseline_ms: int) -> DataFrame:
    """Devices first seen after their tenant's learning period."""
    first = obs.groupBy("tenant_id", "mac").agg(F.min("t").alias("first_seen"))
    start = first.groupBy("tenant_id").agg(F.min("first_seen").alias("start"))
    return first.join(start, "tenant_id").where(F.col("first_seen") > F.col("start") + baseline_ms).select("tenant_id", "mac", "first_seen")


def list_assets(rows: DataFrame, limit: int, **equals: str) -> DataFrame:
    for column, value in equals.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("last_seen"), "mac").limit(limit)


def learned(events: DataFrame, key: str, warm_up_ms: int, min_events: int) -> DataFrame:
    """(key, t, learned): seen for at least the warm-up span, with enough events in the last one."""
    first = events.groupBy(key).agg(F.min("t").alias("t0"))
    level = sliding_count(events, [key], warm_up_ms)
    ready: Column = (F.col("t") - F.col("t0") >= warm_up_ms) & (F.col("n") >= min_events)
    return level.join(first, key).select(key, "t", ready.alias("learned"))


def deviations(events: DataFrame, key: str, features: list[str], warm_up_ms: int, min_events: int) -> DataFrame:
    """(key, t, event_id, reasons): features new to a learned entity."""
    rows = events.join(learned(events, key, warm_up_ms, min_events).where("learned"), [key, "t"])
    for f in features:
        seen = novelty(events, [key], f, warm_up_ms).where("novel").select(key, f, "t", F.lit(f"new {f}").alias(f"why_{f}"))
        rows = rows.join(seen, [key, f, "t"], "left")
    reasons = F.array_compact(F.array(*[F.col(f"why_{f}") for f in features]))
    return rows.select(key, "t", "event_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def baseline_snapshot(events: DataFrame, key: str, features: list[str], asof_ms: int, window_ms: int) -> DataFrame:
    """(key, feature, value, n): what an entity showed in the window, one row per value."""
    inside = events.where(F.col("t").between(asof_ms - window_ms, asof_ms))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]))
    return inside.select(key, pairs.alias("x")).select(key, "x.*").where("value is not null").groupBy(key, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
