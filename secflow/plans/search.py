"""Lists, search, overview, catalogue, health, evidence packages and pseudonyms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.operators import sets

LEVEL_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "informational": 1}


def list_alerts(alerts: DataFrame, limit: int, tenant: str, status: str | None = None, actor: str | None = None, ip: str | None = None) -> DataFrame:
    """Newest first within a tenant; an alert without a status counts as new."""
    rows = alerts.where(F.col("tenant_id") == tenant)
    if status:
        rows = rows.where(F.coalesce("status", F.lit("new")) == status)
    if actor:
        rows = rows.where(F.col("actor") == actor)
    if ip:
        rows = rows.where(F.col("ip") == ip)
    return sets.newest(rows, limit, "time", "alert_id")


def feed(rows: DataFrame, since_ms: int, tenant: str, limit: int) -> DataFrame:
    return sets.newest(rows.where((F.col("time") >= since_ms) & (F.col("tenant_id") == tenant)), limit, "time", "alert_id")


def active_alarms(alerts: DataFrame) -> DataFrame:
    """Unresolved alerts, worst level first, then newest."""
    rank = F.create_map(*[F.lit(x) for kv in LEVEL_RANK.items() for x in kv])
    open_ = ~F.coalesce("status", F.lit("new")).isin("resolved", "closed", "false_positive")
    return alerts.where(open_).withColumn("rank", F.coalesce(F.try_element_at(rank, F.col("level")), F.lit(0))).orderBy(F.desc("rank"), F.desc("time"), "alert_id")


def search(df: DataFrame, fields: dict[str, str], words: Sequence[str], text_columns: Sequence[str]) -> DataFrame:
    """All field tests and all words must hold; words may be in any text column, case-insensitively."""
    hay = F.lower(F.concat_ws(" ", *text_columns))
    tests = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(v.lower())), F.lit(False)) for c, v in fields.items()]
    tests += [F.contains(hay, F.lit(w.lower())) for w in words]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def tactic_heat(alerts: DataFrame) -> DataFrame:
    """(tactic, n, heat): h3 / h2 / h1 by share of the busiest tactic."""
    counts = alerts.where("tactic is not null").groupBy("tactic").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    share = F.col("n") / F.col("top")
    return counts.crossJoin(top).select("tactic", "n", F.when(share > 0.66, "h3").when(share > 0.33, "h2").otherwise("h1").alias("heat"))


def coverage(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per technique: its rules and whether any of them fired."""
    fired = alerts.select("rule_id").distinct().withColumn("hit", F.lit(True))
    return (rules.join(fired, "rule_id", "left").groupBy(F.coalesce("technique", F.lit("undeclared")).alias("technique"))
            .agg(F.count(F.lit(1)).alias("rules"), F.count_if(F.col("hit")).alias("fired")))


def latest_report(reports: DataFrame) -> DataFrame:
    return sets.latest_by(reports, ["alert_id"], "generated_at")


def rule_catalogue(rules: DataFrame, tenant_rules: DataFrame, tenants: DataFrame) -> DataFrame:
    """(tenant, rule_id, enabled): disabled wins, default-off needs opt-in, a companion follows its sibling."""
    off = tenant_rules.where("state = 'disabled'").select("tenant", "rule_id").distinct().withColumn("off", F.lit(True))
    on = tenant_rules.where("state = 'enabled'").select("tenant", "rule_id").distinct().withColumn("on", F.lit(True))
    rows = tenants.crossJoin(rules.select("rule_id", "companion_of", "default_enabled"))  # tenants x shipped rules: the output itself
    rows = rows.join(off, ["tenant", "rule_id"], "left").join(on, ["tenant", "rule_id"], "left")
    sibling = off.select("tenant", F.col("rule_id").alias("companion_of"), F.col("off").alias("s_off"))
    rows = rows.join(sibling, ["tenant", "companion_of"], "left")
    enabled = F.when(F.coalesce("off", "s_off", F.lit(False)), False).otherwise(F.col("default_enabled") | F.coalesce("on", F.lit(False)))
    return rows.select("tenant", "rule_id", enabled.alias("enabled"))


def source_health(events: DataFrame, now_ms: int, silent_ms: int = 900_000, top: int = 3) -> DataFrame:
    """Per source: events, last sighting, silent flag and its busiest senders."""
    base = events.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("last_seen"))
    sends = events.groupBy("source", "sender").agg(F.count(F.lit(1)).alias("c"))
    best = sets.cap_per_key(sends, ["source"], [F.desc("c"), F.asc("sender")], top)
    lists = best.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "sender"))), lambda x: x.sender).alias("top_senders"))
    return base.join(lists, "source").select("source", "n", "last_seen", (F.col("last_seen") < now_ms - silent_ms).alias("silent"), "top_senders")


def field_coverage(events: DataFrame, paths: dict[str, str], by: str) -> DataFrame:
    """(source, field, filled): how often each field a rule reads is present, from one pass."""
    counted = events.groupBy(by).agg(*[F.count(F.col(p)).alias(n) for n, p in paths.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("filled")) for n in paths]))
    return counted.select(by, pairs.alias("x")).select(by, "x.*")


# ---- evidence ----------------------------------------------------------------------------------

def evidence_chain(blocks: DataFrame) -> DataFrame:
    """(package_id, chain, digest): hash chain over the package's blocks in order.

    ``blocks``: (package_id, pos, body). A package is one incident: at most its capped members, their
    capped evidence and one graph, so its list is bounded.
    """
    hashed = blocks.select("package_id", "pos", F.sha2("body", 256).alias("h"))
    lists = hashed.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("l"))
    chain = F.aggregate("l", F.array().cast("array<string>"), lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(
        F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("genesis")), F.lit("|"), x.pos.cast("string"), F.lit("|"), x.h), 256))))
    return lists.select("package_id", chain.alias("chain")).withColumn("digest", F.sha2(F.array_join("chain", ","), 256))


def verify_chain(packages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(package_id, failures) of packages whose stored chain or digest is not what their blocks give."""
    now = evidence_chain(blocks).select("package_id", F.col("chain").alias("c"), F.col("digest").alias("d"))
    both = packages.join(now, "package_id", "full_outer")
    bad = F.array_compact(F.array(
        F.when(F.col("c").isNull(), F.lit("no blocks")), F.when(F.col("chain").isNull(), F.lit("no package")),
        F.when(F.size(F.filter(F.zip_with("chain", "c", lambda a, b: a.eqNullSafe(b)), lambda x: ~x)) > 0, F.lit("chain")),
        F.when(F.col("digest") != F.col("d"), F.lit("digest"))))
    return both.select("package_id", bad.alias("failures")).where(F.size("failures") > 0)


def provenance(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """(alert_id, resolved, missing): how many cited events exist, by event id or ingest id."""
    cited = alerts.select("alert_id", F.explode("event_ids").alias("handle")).distinct()
    handles = events.select(F.explode(F.array("event_id", "ingest_id")).alias("handle")).where("handle is not null").distinct().withColumn("known", F.lit(True))
    return cited.join(handles, "handle", "left").groupBy("alert_id").agg(F.count("known").alias("resolved"), F.count_if(F.col("known").isNull()).alias("missing"))


# ---- privacy -----------------------------------------------------------------------------------

# What counts as a private value in free text.
PRIVATE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "mac": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "sid": r"\bS-1-5(?:-[0-9]+){2,}\b",
}


def find_private(df: DataFrame, text: str, ident: str) -> DataFrame:
    """(ident, counts per kind) of private-looking values in a text."""
    return df.select(ident, *[F.size(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).alias(k) for k, p in PRIVATE_PATTERNS.items()])


def keyed_hash(value: Column, key: str) -> Column:
    """HMAC-SHA256 hex of text, built from sha2 (key up to 64 bytes)."""
    raw = key.encode().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(value, "UTF-8")), 256))), 256)


def pseudonymise(df: DataFrame, key: str, columns: dict[str, str], texts: Sequence[str]) -> DataFrame:
    """``columns`` (name -> kind) replaced by ``kind-<64 hex>``; private values inside ``texts`` likewise.

    The same value gives the same pseudonym everywhere under one key.
    """
    @F.pandas_udf(T.StringType())
    def mask(values: pd.Series) -> pd.Series:
        import hashlib
        import hmac
        import re

        def one(text):
            for kind, pattern in PRIVATE_PATTERNS.items():
                text = re.sub(pattern, lambda m, k=kind: f"{k}-" + hmac.new(key.encode(), m.group().encode(), hashlib.sha256).hexdigest(), text)
            return text

        return values.map(one, na_action="ignore")

    for name, kind in columns.items():
        df = df.withColumn(name, F.when(F.col(name).isNotNull(), F.concat(F.lit(kind + "-"), keyed_hash(F.col(name), key))))
    for name in texts:
        private = reduce(lambda a, b: a | b, [F.col(name).rlike(p) for p in PRIVATE_PATTERNS.values()])
        df = df.withColumn(name, F.coalesce(mask(F.when(private, F.col(name))), F.col(name)))
    return df
