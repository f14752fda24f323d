"""One account per person: realm spellings of a tenant closed into aliases, and accounts rewritten before rules and tracks see them.

Groups of spellings come as rows of (tenant, grp, pos, spelling, is_default). Groups that share a spelling are one realm (a chain of any
length); its name is the first spelling of its first group. Tenants never share a realm. A spelling is usable if it is not empty and holds
neither white space nor any of ``\\ @ : / *``. A bare account belongs to the tenant's default realm, if it names one. Without a listed realm an
account stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.functions import scalars as S
from secflow.functions.predicates import closed
from secflow.plans.correlate import components


def usable(groups: DataFrame) -> DataFrame:
    """Groups with ``realm``, the folded spelling, or null where it is not usable."""
    folded = S.fold_account(F.col("spelling"))
    return groups.withColumn("realm", F.when(closed(folded.rlike(r"\A[^\s\\@:/*]+\z")), folded))


def realm_aliases(groups: DataFrame) -> DataFrame:
    """(tenant, realm, canonical): each spelling's realm name; the default realm's name also under the empty spelling."""
    rows = usable(groups).where("realm is not null and tenant is not null")
    node = lambda *parts: F.to_json(F.array(*parts))
    spelling = node(F.lit("s"), F.col("tenant"), F.col("realm"))
    group = node(F.lit("g"), F.col("tenant"), F.col("grp").cast("string"))
    marked = rows.select("tenant", "grp", "pos", "realm", "is_default", spelling.alias("node"), group.alias("group"))
    roots = components(marked.select(F.col("group").alias("a"), F.col("node").alias("b")))
    named = marked.join(roots, "node")
    first = named.groupBy("root").agg(F.min_by("realm", F.struct("grp", "pos", "realm")).alias("canonical"))
    full = named.join(first, "root")
    listed = full.select("tenant", "realm", "canonical").distinct()
    default = full.where("is_default").groupBy("tenant").agg(F.min_by("canonical", F.struct("grp", "pos")).alias("canonical"))
    return listed.unionByName(default.select("tenant", F.lit("").alias("realm"), "canonical"))


def alias_conflicts(groups: DataFrame) -> DataFrame:
    """(tenant, spelling, reason): spellings that are not usable, and those that several groups list (which merges the groups)."""
    rows = usable(groups)
    bad = rows.where("realm is null").select("tenant", "spelling", F.lit("not a realm").alias("reason"))
    shared = rows.where("realm is not null").groupBy("tenant", F.col("realm").alias("spelling")).agg(F.countDistinct("grp").alias("n")).where("n > 1")
    return bad.unionByName(shared.select("tenant", "spelling", F.lit("in several groups").alias("reason")))


def folded_account(df: DataFrame, account: Column, tenant: Column, aliases: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: ``name@canonical`` of an account whose realm is listed for the tenant, else null."""
    parts = S.account_realm(S.fold_account(account))
    rows = df.withColumn("_a", parts).withColumn("_tenant", tenant)
    side = aliases.select(F.col("tenant").alias("_t"), F.col("realm").alias("_r"), "canonical")
    met = rows.join(side, (F.col("_tenant") == F.col("_t")) & (F.col("_a.realm") == F.col("_r")), "left")
    plain = (F.length("_a.name") > 0) & ~F.col("_a.name").rlike(r"[\\@]")
    return met.withColumn(out, F.when(plain & F.col("canonical").isNotNull(), F.concat(F.col("_a.name"), F.lit("@"), F.col("canonical")))).select(*df.columns, out)


def fold_events(events: DataFrame, aliases: DataFrame, tenant: Column) -> DataFrame:
    """Events with the acting and the target account rewritten where an alias applies, for rules that group by either."""
    out = folded_account(events, F.col("actor.user.name"), tenant, aliases, "_actor")
    out = folded_account(out, F.col("unmapped.target_user.name"), tenant, aliases, "_target")
    actor = F.when(F.col("_actor").isNotNull(), F.col("actor").withField("user.name", F.col("_actor"))).otherwise(F.col("actor"))
    target = F.when(F.col("_target").isNotNull(), F.col("unmapped").withField("target_user.name", F.col("_target"))).otherwise(F.col("unmapped"))
    return out.withColumn("actor", actor).withColumn("unmapped", target).select(*events.columns)


def fold_alerts(alerts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alert rows (see ``correlate``) with the actor rewritten where an alias applies, before tracks, graphs and entities."""
    return folded_account(alerts, F.col("actor"), F.col("tenant_id"), aliases, "_actor").withColumn("actor", F.coalesce("_actor", "actor")).drop("_actor")
