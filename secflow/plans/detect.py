"""From silver events to rule hits, scores, alerts and review requests.

All rules are evaluated in one scan: an event is turned into one row per rule it matches. Stateful
rows of all rules then share three window passes (count, distinct, regularity); the rule and its
window length are part of the window key, so adding a rule adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.functions import scalars as S
from secflow.functions.predicates import closed
from secflow.operators import sets
from secflow.operators.cooldown import cooldown
from secflow.operators.sliding import WORDS, sliding_count, sliding_measures
from secflow.session import cut_lineage
from secflow.plans.identity import fold_events
from secflow.plans.rules import (CRITICALITY_POINTS, ROUTE_DEEP, ROUTE_LIGHT, RULES, Rule, floor_of, listed_events, lists_from_column, rule_table)

DEFAULT_TENANT = "default"
ACCOUNT_FIELDS = ("actor.user.name", "unmapped.target_user.name")
COOLDOWN_MS = 300_000
#: Fixed value: events that an alert's row cites.
EVIDENCE_SHOWN = 50
GROUP = ["rule_id", "window_ms", "tenant", "grp"]


def detection_tenant(tenant: Column) -> Column:
    """The tenant of an event for detection: a missing or malformed one counts as ``default``."""
    return F.when(closed(tenant.rlike(r"\A[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\z")), tenant).otherwise(DEFAULT_TENANT)


def event_key() -> Column:
    """The id under which an event counts once: its ingest id, or a fingerprint of what it says when it has none."""
    said = F.struct("class_uid", "activity_id", "time", "message", F.col("src_endpoint.ip").alias("src"), F.col("src_endpoint.port").alias("sport"),
                    F.col("dst_endpoint.ip").alias("dst"), F.col("dst_endpoint.port").alias("dport"), F.col("dst_endpoint.hostname").alias("host"),
                    F.col("actor.user.name").alias("user"), F.col("api.operation").alias("operation"))
    return F.coalesce(S.non_empty(F.col("siem.ingest_id")), F.concat(F.lit("sha:"), F.substring(F.sha1(F.to_json(said)), 1, 16)))


def matches(events: DataFrame, rules: Sequence[Rule] = RULES, mode: str = "clamp",
            now_ms: int | None = None, received: bool = False) -> DataFrame:
    """(rule_id, window_ms, tenant, grp, val, t, event_key, companion_of) per event and matching rule; with ``received_ms`` on demand.

    ``grp`` is null exactly for stateless rules; a stateful rule ignores events without its group or
    counted value. With ``now_ms``, times too far ahead of it are ignored and smaller leads clamped.
    """
    ids = {r.name: r.id for r in rules}

    def row(rule: Rule) -> Column:
        w, t = rule.window_s * 1000, F.col("time")
        grp = val = F.lit(None).cast("string")
        ok = rule.predicate()
        if rule.stateful:
            grp = S.fold_account(F.col(rule.group)) if rule.group in ACCOUNT_FIELDS else F.col(rule.group).cast("string")
            t = S.window_time(t, F.col("siem.received_ms"), w, mode, rule.measure == "cv")
            if now_ms is not None:
                t = S.valid_time(t, now_ms)
                t = t if rule.measure == "cv" else F.when(t.isNotNull(), F.least(t, F.lit(now_ms)))
            ok = ok & grp.isNotNull() & t.isNotNull()
            if rule.distinct:
                val = F.col(rule.distinct).cast("string")
                ok = ok & val.isNotNull()
        return F.when(ok, F.struct(
            F.lit(rule.id).alias("rule_id"), F.lit(w).cast("bigint").alias("window_ms"), grp.alias("grp"),
            val.alias("val"), t.cast("bigint").alias("t"), F.lit(rule.measure).cast("string").alias("measure"),
            F.lit(ids.get(rule.companion_of or "")).cast("string").alias("companion_of")))

    classes = sorted({r.class_uid for r in rules})
    # The array is exploded as an expression: as a column of its own the optimizer would copy it into
    # inferred filters.
    rows = events.where(F.col("class_uid").isin(classes)).select(
        "*", detection_tenant(F.col("siem.tenant")).alias("tenant"), event_key().alias("event_key"))
    more = {"received_ms": F.col("siem.received_ms").cast("bigint").alias("received_ms")} if received else {}
    return (rows.select("tenant", "event_key", *more.values(), F.explode(F.array(*[row(r) for r in rules])).alias("m"))
            .where("m is not null").select("tenant", "event_key", *more, "m.*"))


def gate(matched: DataFrame, tenant_rules: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Matches without the rules a tenant switched off, and with default-off rules only where switched on.

    A companion follows its sibling. ``tenant_rules``: (tenant, rule_id, state disabled | enabled).
    """
    off = tenant_rules.where("state = 'disabled'").select("tenant", F.col("rule_id").alias("_rid")).distinct()
    on = tenant_rules.where("state = 'enabled'").select("tenant", F.col("rule_id").alias("_rid")).distinct()
    rows = matched
    for column in ("rule_id", "companion_of"):
        rows = rows.join(off.withColumnRenamed("_rid", column), ["tenant", column], "left_anti")
    opt_in = [r.id for r in rules if not r.default_enabled]
    if not opt_in:
        return rows.select(*matched.columns)
    closed_rows = rows.where(F.col("rule_id").isin(opt_in))
    opened = closed_rows.join(on.withColumnRenamed("_rid", "rule_id"), ["tenant", "rule_id"], "left_semi")
    return rows.where(~F.col("rule_id").isin(opt_in)).unionByName(opened).select(*matched.columns)


def once(matched: DataFrame) -> DataFrame:
    """Stateful matches with each event counted once per rule and group, at its newest time."""
    keys = [*GROUP, "event_key", "measure", "companion_of"]
    return (matched.where("grp is not null").groupBy(*keys)
            .agg(F.max(F.struct("t", "val")).alias("x")).select(*keys, "x.t", "x.val"))


def paired(rules: Sequence[Rule]) -> list[str]:
    """Ids of companions whose sibling is among ``rules``, and of those siblings."""
    ids = {r.name: r.id for r in rules}
    return sorted({x for r in rules if r.companion_of in ids for x in (r.id, ids[r.companion_of])})


def windows(stateful: DataFrame, compared: Sequence[str] = ()) -> DataFrame:
    """(rule_id, window_ms, tenant, grp, t, n, cv[, f0..f3]) of every rule at every time it was fed, in one pass for all measures; with content
    words for the rules that are ``compared``."""
    return sliding_measures(stateful, GROUP, "window_ms", fingerprint=F.col("rule_id").isin(*compared) if compared else None)


def crossed(levels: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Windows at or over their rule's limit."""
    def over(rule: Rule) -> Column:
        base = (F.col("rule_id") == rule.id) & (F.col("n") >= rule.threshold)
        return base & closed(F.col("cv") <= rule.max_cv) if rule.max_cv is not None else base

    stateful = [over(r) for r in rules if r.stateful]
    return levels.where(reduce(or_, stateful)) if stateful else levels.limit(0)


def run_rules(events: DataFrame, rules: Sequence[Rule] = RULES, tenant_rules: DataFrame | None = None,
              mode: str = "clamp", now_ms: int | None = None, suppress: bool = True, aliases: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """Rule hits: (tenant, event_key, rule_id, window_ms, grp, t, n), one per event and rule."""
    return detected(events, rules, tenant_rules, mode, now_ms, suppress, aliases, lists)[0]


def detected(events: DataFrame, rules: Sequence[Rule] = RULES, tenant_rules: DataFrame | None = None,
             mode: str = "clamp", now_ms: int | None = None, suppress: bool = True, aliases: DataFrame | None = None,
             lists: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The hits of :func:`run_rules`, and what fed the windows (null without stateful rules).

    With ``aliases`` (``identity.realm_aliases``) accounts are folded before any rule sees them. ``lists`` (list, entry) replaces the
    shipped entries of all lists that rules test.

    Rules are evaluated once: matches are far fewer than events, and they are written to reliable storage before windows,
    hits, suppression and evidence read them."""
    if aliases is not None:
        events = fold_events(events, aliases, detection_tenant(F.col("siem.tenant")))
    if lists is None:
        matched = matches(events, rules, mode, now_ms)
    else:
        with lists_from_column():
            matched = matches(listed_events(events, rules, lists), rules, mode, now_ms)
    if tenant_rules is not None:
        matched = gate(matched, tenant_rules, rules)
    stateful = any(r.stateful for r in rules)
    if stateful:
        matched = cut_lineage(matched)
    columns = ["tenant", "event_key", "rule_id", "window_ms", "grp", "t", "n"]
    parts, fed = [], None
    if any(not r.stateful for r in rules):
        alone = matched.where("grp is null").groupBy("tenant", "event_key", "rule_id", "window_ms").agg(F.max("t").alias("t"))
        parts.append(alone.select("tenant", "event_key", "rule_id", "window_ms",
                                  F.lit(None).cast("string").alias("grp"), "t", F.lit(None).cast("bigint").alias("n")))
    if stateful:
        # read by the windows, by the join with those over their limit, twice by suppression and by evidence
        fed = cut_lineage(once(matched))
        pairs = paired(rules) if suppress else []
        over = crossed(windows(fed, pairs), rules)
        hits = fed.join(over, [*GROUP, "t"])
        if pairs:
            # Few rows (windows over their limit), read four times below: kept on reliable storage.
            hits = drop_covered(cut_lineage(hits), fed)
        parts.append(hits.select(*columns))
    return sets.union_all(parts).select(*columns), fed


def drop_covered(hits: DataFrame, fed: DataFrame) -> DataFrame:
    """Hits without those of a companion whose sibling's alert already carries the same evidence.

    Count windows: every event of the companion's window lies in the sibling's, i.e. the number of
    events in the companion's group that are also in the sibling's group equals the whole count; only
    groups that fired together with their sibling are counted.
    Distinct windows: both windows hold the same set of values (equal count and content sums).
    """
    sib = hits.select("tenant", "event_key", F.col("rule_id").alias("companion_of"), F.col("grp").alias("s_grp"),
                      F.col("n").alias("s_n"), *[F.col(w).alias(f"s_{w}") for w in WORDS])
    pair = hits.where("companion_of is not null").join(sib, ["tenant", "event_key", "companion_of"])
    same_values = reduce(lambda a, w: a & (F.col(w) == F.col(f"s_{w}")), WORDS, F.col("n") == F.col("s_n"))
    covered_values = pair.where((F.col("measure") == "distinct") & same_values)

    counted = pair.where(F.col("measure") == "count")
    fired = counted.select(*GROUP, "companion_of", "s_grp").distinct()
    # events of the groups that fired, with each sibling group they fired with, and of those the ones that are in it
    member = fed.where("measure = 'count' and companion_of is not null").select(*GROUP, "companion_of", "event_key", "t").join(fired, [*GROUP, "companion_of"])
    in_sibling = fed.where("measure = 'count'").select("tenant", "event_key", F.col("rule_id").alias("companion_of"), F.col("grp").alias("s_grp"))
    shared = member.join(in_sibling, ["tenant", "event_key", "companion_of", "s_grp"]).select(*GROUP, "s_grp", "t")
    shared_n = sliding_count(shared, [*GROUP, "s_grp"], "window_ms").withColumnRenamed("n", "both")
    covered_events = counted.join(shared_n, [*GROUP, "s_grp", "t"]).where(F.col("both") == F.col("n"))
    covered = (covered_values.select("tenant", "event_key", "rule_id")
               .unionByName(covered_events.select("tenant", "event_key", "rule_id")))
    return hits.join(covered, ["tenant", "event_key", "rule_id"], "left_anti")


def score_events(hits: DataFrame, rules: Sequence[Rule] = RULES, exposure: DataFrame | None = None) -> DataFrame:
    """(tenant, event_key, score, routing_score, route, rule_ids) per event with a hit.

    ``exposure``: (tenant, event_key, points), see :func:`exposure_points`. Only rules with an exposure
    gate gain from exposure in the routing score; a rule's level floor counts there unless gated off.
    """
    table = rule_table(hits.sparkSession, tuple(rules)).select("rule_id", "level", "weight", "deep_gate", "exposure_gate")
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    zero = lambda c: F.coalesce(c, F.lit(0))
    floor, deep = floor_of(F.col("level")), F.col("deep_gate")
    agg = hits.join(table, "rule_id").groupBy("tenant", "event_key").agg(
        F.sum("weight").cast("int").alias("w"), F.max(floor).alias("fl"),
        zero(F.max(F.when(deep, floor))).alias("fl_deep"),
        F.sum(F.when(F.col("exposure_gate"), F.col("weight"))).cast("int").alias("w_exp"),
        zero(F.max(F.when(F.col("exposure_gate") & deep, floor))).alias("fl_exp"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    if exposure is not None:
        agg = agg.join(exposure, ["tenant", "event_key"], "left")
    points = zero(F.col("points")) if exposure is not None else F.lit(0)
    score = clamp(clamp(F.greatest("w", "fl")) + points)
    base = clamp(F.greatest("w", "fl_deep"))
    exposed = F.when(F.col("w_exp").isNotNull(), clamp(clamp(F.greatest("w_exp", "fl_exp")) + points))
    routing = F.greatest(base, exposed)
    return agg.select("tenant", "event_key", score.cast("int").alias("score"),
                      routing.cast("int").alias("routing_score"), route(routing).alias("route"), "rule_ids")


def route(score: Column) -> Column:
    return F.when(score >= ROUTE_DEEP, "deep").when(score >= ROUTE_LIGHT, "light").otherwise("store")


def exposure_points(events: DataFrame, points: DataFrame) -> DataFrame:
    """(tenant, event_key, points) of events that touch a listed control-system address."""
    side = points.select(F.col("wire_address").alias("_addr"), F.col("criticality")).dropDuplicates(["_addr"])
    table = F.create_map(*[F.lit(x) for kv in CRITICALITY_POINTS.items() for x in kv])
    return (events.where("unmapped.ot.address is not null")
            .select(detection_tenant(F.col("siem.tenant")).alias("tenant"), event_key().alias("event_key"),
                    F.col("unmapped.ot.address").alias("_addr"))
            .join(side, "_addr").groupBy("tenant", "event_key")
            .agg(F.max(F.coalesce(F.try_element_at(table, F.col("criticality")), F.lit(0))).alias("points")))


def alert_ids(hits: DataFrame) -> DataFrame:
    """Hits plus their deterministic alert id: rule, group and window bucket, or rule and event."""
    stateful = S.alert_key(F.col("rule_id"), F.col("tenant"), F.col("grp"), F.col("t"), F.col("window_ms"))
    alone = F.concat_ws(":", "rule_id", "tenant", "event_key")
    return hits.withColumn("alert_id", F.when(F.col("grp").isNotNull(), stateful).otherwise(alone))


def collapse(hits: DataFrame) -> DataFrame:
    """One row per alert id: its newest hit, and how many events hit."""
    rest = ["tenant", "rule_id", "window_ms", "grp", "t", "n", "event_key"]
    return (alert_ids(hits).groupBy("alert_id")
            .agg(F.max_by(F.struct(*rest), F.struct("t", "event_key")).alias("x"), F.count(F.lit(1)).alias("hits"))
            .select("alert_id", "x.*", "hits"))


def evidence_rows(alerts: DataFrame, fed: DataFrame) -> DataFrame:
    """(alert_id, ident, t): all that each alert's window holds, as rows.

    Two passes: only windows that fired are looked at, and an event is joined by hash on the two
    window buckets it can belong to. Distinct rules cite the counted values instead of events.
    """
    fired = (alerts.where("grp is not null")
             .select("alert_id", *GROUP, F.col("t").alias("at"), S.bucket(F.col("t"), F.col("window_ms")).alias("b")))
    own = F.floor(F.col("t") / F.col("window_ms")).cast("bigint")
    members = fed.withColumn("b", F.explode(F.array(own, own + 1))).join(fired, [*GROUP, "b"])
    return (members.where((F.col("t") <= F.col("at")) & (F.col("t") >= F.col("at") - F.col("window_ms")))
            .groupBy("alert_id", F.coalesce("val", "event_key").alias("ident")).agg(F.max("t").alias("t")))


def evidence(alerts: DataFrame, fed: DataFrame, cap: int = EVIDENCE_SHOWN) -> DataFrame:
    """(alert_id, event_ids, event_ids_omitted): the first ``cap`` of :func:`evidence_rows`, oldest first, and how many more there are."""
    return sets.capped_ids(evidence_rows(alerts, fed), ["alert_id"], ["t", "ident"], "ident", cap)


def causal_list() -> Column:
    """The hashed process, logon, flow and agent keys of an event."""
    tenant, host = detection_tenant(F.col("siem.tenant")), F.trim("siem.key_scope.host")
    sender = F.trim("siem.sender.ip")
    qualifier = F.coalesce(S.non_empty(host), S.non_empty(sender), S.non_empty(F.trim("siem.sender.source")))
    sensor = S.non_empty(F.trim("siem.key_scope.sensor"))
    flow_scope = F.when(sensor.isNotNull() & qualifier.isNotNull(), F.to_json(F.array(sensor, qualifier)))
    named = [("proc", "self", "actor.process.uid", S.non_empty(host)),
             ("proc", "parent", "actor.process.parent_process.uid", S.non_empty(host)),
             ("logon", "self", "actor.session.uid", S.non_empty(host)),
             ("flow", "self", "connection_info.uid", flow_scope),
             ("agent", "self", "unmapped.mcp.session_id", S.non_empty(host))]

    def key(ns: str, role: str, path: str, scope: Column) -> Column:
        h = F.when(scope.isNotNull(), S.key_hash(tenant, ns, F.lit(""), scope, F.col(path)))
        return F.when(h.isNotNull(), F.struct(F.lit(ns).alias("ns"), F.lit(role).alias("role"), h.alias("h"),
                                              F.lit("declared" if ns == "agent" else "asserted").alias("scope_trust")))

    keys = F.filter(F.array(*[key(*spec) for spec in named]), lambda x: x.isNotNull())
    return F.array_distinct(keys)


def causal_keys(events: DataFrame) -> DataFrame:
    """(tenant, event_key, causal_keys) of each event."""
    return events.select(detection_tenant(F.col("siem.tenant")).alias("tenant"), event_key().alias("event_key"), causal_list().alias("causal_keys"))


def make_alerts(events: DataFrame, rules: Sequence[Rule] = RULES, tenant_rules: DataFrame | None = None,
                points: DataFrame | None = None, mode: str = "clamp", now_ms: int | None = None) -> DataFrame:
    """The alert table: one row per alert id, carrying the newest hit's event and the window's evidence."""
    hits, fed = detected(events, rules, tenant_rules, mode, now_ms)
    hits = cut_lineage(hits)
    exposure = exposure_points(events, points) if points is not None else None
    scored = score_events(hits, rules, exposure).select("tenant", "event_key", "score")
    alerts = cut_lineage(collapse(hits).join(scored, ["tenant", "event_key"]))
    table = rule_table(events.sparkSession, tuple(rules)).select(
        "rule_id", "rule_title", "level", F.struct("framework", "tactic", "technique").alias("mitre"))
    # Only events that raised an alert are looked at again, once: what is told of them is written.
    asked = alerts.select(F.col("tenant").alias("_t"), F.col("event_key").alias("_k")).distinct()
    wanted = events.join(asked, (detection_tenant(F.col("siem.tenant")) == F.col("_t")) & (event_key() == F.col("_k")), "left_semi")
    told = cut_lineage(wanted.select(
        detection_tenant(F.col("siem.tenant")).alias("tenant"), event_key().alias("event_key"), "time", F.col("siem.sector").alias("sector"), "src_endpoint",
        "dst_endpoint", F.struct("actor.user").alias("actor"), F.col("siem.ingest_id").alias("trigger_event_id"), causal_list().alias("causal_keys")))
    trigger = sets.latest_by(told.drop("causal_keys"), ["tenant", "event_key"], "time")
    out = alerts.join(table, "rule_id").join(trigger, ["tenant", "event_key"])
    own = F.filter(F.array("trigger_event_id"), lambda x: x.isNotNull())
    if fed is not None:
        cited = evidence(alerts, fed)
        out = out.join(cited, "alert_id", "left")
        ids, omitted = F.coalesce("event_ids", own), F.coalesce("event_ids_omitted", F.lit(0).cast("bigint"))
    else:
        ids, omitted = own, F.lit(0).cast("bigint")
    out = out.join(told.select("tenant", "event_key", "causal_keys").dropDuplicates(["tenant", "event_key"]), ["tenant", "event_key"], "left")
    return out.select(
        "alert_id", F.col("time"), "rule_id", "rule_title", "level", "score", "sector", "mitre",
        F.col("tenant").alias("tenant_id"), "src_endpoint", "dst_endpoint", "actor", ids.alias("event_ids"),
        omitted.alias("event_ids_omitted"), "trigger_event_id",
        F.struct(F.lit("new").alias("status"), F.lit(None).cast("string").alias("note")).alias("triage"),
        "causal_keys")


def review_queue(hits: DataFrame, rules: Sequence[Rule] = RULES, gap_ms: int = COOLDOWN_MS) -> DataFrame:
    """Events to review: routed to a tier, and at least one of their alert keys not in cooldown.

    (tenant, event_key, tier, reasons). Cooldown runs on event time per alert key.
    """
    hits = cut_lineage(hits)
    routed = score_events(hits, rules).where("route <> 'store'").select("tenant", "event_key", F.col("route").alias("tier"))
    keyed = cut_lineage(alert_ids(hits.join(routed, ["tenant", "event_key"])))
    first = keyed.groupBy("alert_id", "t").agg(F.min(F.struct("tenant", "event_key")).alias("x"))
    kept = (cooldown(first.select("alert_id", "t"), ["alert_id"], gap_ms).join(first, ["alert_id", "t"])
            .select("x.tenant", "x.event_key").distinct())
    titles = rule_table(hits.sparkSession, tuple(rules)).select("rule_id", "rule_title")
    return (keyed.join(kept, ["tenant", "event_key"], "left_semi").join(titles, "rule_id")
            .groupBy("tenant", "event_key", "tier").agg(F.array_sort(F.collect_set("rule_title")).alias("reasons")))
