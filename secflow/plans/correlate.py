"""Alerts to entity tracks, incidents, typed graphs, timelines and campaigns.

Alerts come as rows of (alert_id, tenant_id, time, rule_id, tactic, technique, score, actor, ip, device,
event_id[, anomaly]); ``alert_view`` gives that shape from the alert table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secflow.functions import scalars as S
from secflow.operators import sets
from secflow.operators.joins import not_listed
from secflow.operators.sliding import sessions
from secflow.session import cut_lineage

HORIZON_MS = 86_400_000
SEVERITY_CAP = 1000
#: Fixed value: members that an incident's row lists.
MEMBERS_SHOWN = 200
# Edge kinds in order of preference, and link bases.
TYPED_KINDS = ("caused_by", "invoked", "authenticated_as", "wrote_to", "changed")
BASIS = {"proc": "process_tree", "flow": "network_flow", "agent": "agent_session"}
TRUST = ("asserted", "declared", "observed")


def alert_view(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        S.member_id(F.col("alert_id"), F.col("time"), F.col("rule_id"), F.col("event_ids")).alias("alert_id"), "tenant_id", "time", "rule_id",
        F.col("mitre.tactic").alias("tactic"), F.col("mitre.technique").alias("technique"), "score",
        F.col("actor.user.name").alias("actor"), S.valid_ip(F.col("src_endpoint.ip")).alias("ip"),
        F.coalesce("src_endpoint.mac", "src_endpoint.hostname").alias("device"),
        F.coalesce("trigger_event_id", "alert_id").alias("event_id"), F.lit(None).cast("string").alias("anomaly"), "causal_keys")


def entities_of() -> Column:
    pairs = [F.when(F.length(c) > 0, F.struct(F.lit(c).alias("entity_type"), F.col(c).alias("entity_value"))) for c in ("actor", "ip", "device")]
    return F.filter(F.array(*pairs), lambda x: x.isNotNull())


def alert_tracks(alerts: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """One row per alert and entity; a listed (shared) ip or device opens no track."""
    rows = (alerts.withColumn("e", F.explode(entities_of())).select("*", "e.*").drop("e")
            .withColumn("entity_value", S.bounded(F.col("entity_value"))))
    if shared is None:
        return rows
    people = rows.where("entity_type = 'actor'")
    return people.unionByName(not_listed(rows.where("entity_type <> 'actor'"), "entity_value", shared))


TRACK = ["tenant_id", "entity_type", "entity_value"]


def track_members(tracks: DataFrame, horizon_ms: int = HORIZON_MS) -> DataFrame:
    """Track rows plus ``first_seen``: the start of the run of alerts with gaps up to the horizon."""
    marked = sessions(tracks, TRACK, horizon_ms, "time").select(*TRACK, F.col("t").alias("time"), F.col("session_start").alias("first_seen"))
    return tracks.join(marked, [*TRACK, "time"])


def incidents(tracks: DataFrame, horizon_ms: int = HORIZON_MS, listed: int = MEMBERS_SHOWN) -> tuple[DataFrame, DataFrame]:
    """(incidents, members). A track with two or more tactics is an incident.

    Tactics and first_seen cover the whole run; members are all alerts within the horizon of its last
    alert, as rows. A row shows the newest ``listed`` ids (``truncated`` tells that there are more); nothing else reads that list.
    """
    key = [*TRACK, "first_seen"]
    # Tracks are read by their sessions and by the join with them, members by heads, totals and lists and by whatever follows: each is worked
    # out once and written.
    rows = cut_lineage(track_members(cut_lineage(sets.latest_by(tracks, [*TRACK, "alert_id"], "time")), horizon_ms))
    # A handful of tactics per track, so this set stays small whatever the number of alerts.
    heads = (rows.groupBy(*key).agg(F.array_sort(F.collect_set("tactic")).alias("tactics"), F.max("time").alias("last_seen"))
             .where(F.size("tactics") >= 2)
             .withColumn("incident_id", F.concat_ws(":", *TRACK, S.bucket(F.col("first_seen"), horizon_ms).cast("string"))))
    live = cut_lineage(rows.join(heads, key).where(F.col("time") >= F.col("last_seen") - horizon_ms))
    rolled = live.groupBy("incident_id", *key, "tactics", "last_seen").agg(
        F.count(F.lit(1)).cast("int").alias("member_count"), F.least(F.sum("score"), F.lit(SEVERITY_CAP)).cast("int").alias("severity"))
    shown = sets.cap_per_key(live, ["incident_id"], [F.desc("time"), F.asc("alert_id")], listed)
    ids = shown.groupBy("incident_id").agg(F.array_sort(F.collect_set("alert_id")).alias("member_alert_ids"))
    cut = F.col("member_count") > listed
    out = rolled.join(ids, "incident_id").select(
        "incident_id", *TRACK, "first_seen", "last_seen", "tactics", "member_alert_ids", "member_count", "severity", cut.alias("truncated"))
    return out, live.drop("tactics", "last_seen")


def typed_kind(pair: str) -> Column:
    tactic, technique = F.col("tactic"), F.coalesce("technique", F.lit(""))
    if pair == "used_ip":
        return (F.when((tactic == "TA0001") | F.startswith(technique, F.lit("T1078")), "authenticated_as")
                .when((tactic == "TA0011") | F.startswith(technique, F.lit("T1071")), "invoked").otherwise(pair))
    if pair == "used_device":
        return (F.when((F.col("anomaly") == "unauthorized_write") & F.startswith(technique, F.lit("T0855")), "caused_by")
                .when((tactic == "TA0106") & (technique == "T0836"), "wrote_to").when(tactic == "TA0003", "changed").otherwise(pair))
    return F.when(tactic == "TA0108", "changed").otherwise(pair)


def kind_rank(kind: Column) -> Column:
    order = F.array(*[F.lit(k) for k in (*TYPED_KINDS, "used_ip", "used_device", "seen_at_ip")])
    return F.array_position(order, kind)


def _node_id(kind: str, value: Column) -> Column:
    return S.entity_id(F.col("tenant_id"), F.lit(kind), S.canonical_entity(F.lit(kind), value))


def graph_nodes(members: DataFrame) -> DataFrame:
    """(incident_id, entity_id, entity_type, entity_value): smallest spelling per entity."""
    rows = members.select("incident_id", "tenant_id", F.explode(entities_of()).alias("e")).select("incident_id", "tenant_id", "e.*")
    ident = S.entity_id(F.col("tenant_id"), F.col("entity_type"), S.canonical_entity(F.col("entity_type"), F.col("entity_value")))
    return (rows.withColumn("entity_id", ident).where("entity_id is not null")
            .groupBy("incident_id", "entity_id", "entity_type").agg(F.min("entity_value").alias("entity_value")))


def graph_edges(members: DataFrame) -> DataFrame:
    """Typed edges between entities of one alert (at most three per alert), best evidence kept."""
    pairs = [("actor", "ip", "used_ip"), ("actor", "device", "used_device"), ("device", "ip", "seen_at_ip")]
    specs = [F.struct(_node_id(a, F.col(a)).alias("from_id"), _node_id(b, F.col(b)).alias("to_id"), typed_kind(k).alias("kind")) for a, b, k in pairs]
    rows = (members.select("incident_id", "alert_id", "time", "event_id", F.explode(F.array(*specs)).alias("e"))
            .select("incident_id", "alert_id", "time", "event_id", "e.*").where("from_id is not null and to_id is not null"))
    per_alert = rows.groupBy("incident_id", "from_id", "to_id", "alert_id").agg(
        F.min(F.struct(kind_rank(F.col("kind")).alias("r"), "time", "event_id", "kind")).alias("b"), F.min("time").alias("time"))
    return (per_alert.groupBy("incident_id", "from_id", "to_id")
            .agg(F.min("b").alias("b"), F.min("time").alias("first_ts"), F.max("time").alias("last_ts"), F.count(F.lit(1)).alias("evidence_count"))
            .select("incident_id", "from_id", "to_id", "b.kind", "b.event_id", F.col("b.time").alias("ts_ms"), "first_ts", "last_ts", "evidence_count"))


def tactic_sources(members: DataFrame) -> DataFrame:
    """(incident_id, tactic, alert_ids)."""
    return (members.where("tactic is not null").groupBy("incident_id", "tactic")
            .agg(F.array_sort(F.collect_set("alert_id")).alias("alert_ids")))


def held_keys(members: DataFrame) -> DataFrame:
    """(incident_id, tenant_id, alert_id, event_id, time, ns, role, h, trust) per linkable key of a member."""
    keys = (members.select("incident_id", "tenant_id", "alert_id", "event_id", "time", F.explode("causal_keys").alias("k"))
            .select("incident_id", "tenant_id", "alert_id", "event_id", "time", "k.ns", "k.role", "k.h",
                    F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TRUST]), F.col("k.scope_trust")), F.lit(0)).alias("p")))
    rank = F.when(F.col("p") > 0, F.col("p") - 1).otherwise(0).cast("int")
    return keys.where(F.col("ns").isin(*BASIS)).withColumn("trust", rank).drop("p")


def drop_foreign_keys(keys: DataFrame) -> DataFrame:
    """Keys without those that members of two incidents hold, unless the two share all their holders."""
    holder = (keys.select("tenant_id", "ns", "h", "incident_id", "alert_id").distinct())
    per_incident = holder.groupBy("tenant_id", "ns", "h", "incident_id").agg(F.count(F.lit(1)).alias("mine"))
    all_alerts = holder.select("tenant_id", "ns", "h", "alert_id").distinct().groupBy("tenant_id", "ns", "h").agg(F.count(F.lit(1)).alias("every"))
    foreign = (per_incident.join(all_alerts, ["tenant_id", "ns", "h"]).where("mine < every").select("tenant_id", "ns", "h", "incident_id"))
    return keys.join(foreign, ["tenant_id", "ns", "h", "incident_id"], "left_anti")


def graph_links(members: DataFrame) -> DataFrame:
    """Evidence links between member alerts that share a key.

    A process key gives a tree (earliest holder to each alert naming it as parent), flow and agent keys
    a chain in time. Windows are by incident and key.
    """
    keys = drop_foreign_keys(cut_lineage(held_keys(members)))
    base = ["incident_id", "ns", "h"]
    per_role = cut_lineage(keys.groupBy(*base, "alert_id", "event_id", "time", "role").agg(F.min("trust").alias("trust")))
    order = F.struct(F.col("time").isNull().alias("u"), F.col("time"), F.col("event_id"), F.col("alert_id"), F.col("trust"))
    anchor = per_role.where("ns = 'proc' and role = 'self'").groupBy(*base).agg(F.min(order).alias("a"))
    tree = (per_role.where("ns = 'proc' and role = 'parent'").join(anchor, base).where(F.col("alert_id") != F.col("a.alert_id"))
            .select(*base, F.col("a.event_id").alias("f_ev"), F.col("a.time").alias("f_t"), F.col("a.trust").alias("f_trust"),
                    F.col("event_id").alias("t_ev"), F.col("time").alias("t_t"), F.col("trust").alias("t_trust")))
    w = Window.partitionBy(*base).orderBy(F.asc_nulls_last("time"), "event_id", "alert_id")
    chain_rows = per_role.where("ns <> 'proc' and role in ('self', 'member')").groupBy(*base, "alert_id", "event_id", "time").agg(F.min("trust").alias("trust"))
    chain = chain_rows.select(*base, F.lag("event_id").over(w).alias("f_ev"), F.lag("time").over(w).alias("f_t"), F.lag("trust").over(w).alias("f_trust"),
                              F.col("event_id").alias("t_ev"), F.col("time").alias("t_t"), F.col("trust").alias("t_trust")).where("f_ev is not null")
    basis = F.create_map(*[F.lit(x) for kv in BASIS.items() for x in kv])
    order_of = (F.when(F.col("f_t").isNull() | F.col("t_t").isNull(), "unordered").when(F.col("f_t") < F.col("t_t"), "forward")
                .when(F.col("f_t") == F.col("t_t"), "concurrent").otherwise("conflict"))
    weakest = F.element_at(F.array(*[F.lit(t) for t in TRUST]), (F.least("f_trust", "t_trust") + 1).cast("int"))
    return tree.unionByName(chain).where("f_ev <> t_ev").select(
        "incident_id", F.element_at(basis, F.col("ns")).alias("basis"), F.col("f_ev").alias("from_event_id"), F.col("t_ev").alias("to_event_id"),
        order_of.alias("order"), F.col("f_t").alias("from_ts"), F.col("t_t").alias("to_ts"), weakest.alias("trust"))


def shown_links(links: DataFrame, listed: int) -> DataFrame:
    """The first links of each incident for display, with ``links_total``."""
    totals = links.groupBy("incident_id").agg(F.count(F.lit(1)).alias("links_total"))
    first = sets.cap_per_key(links, ["incident_id"], [F.asc(c) for c in ("basis", "from_event_id", "to_event_id", "order", "trust")], listed)
    return first.join(totals, "incident_id")


def incident_timeline(members: DataFrame) -> DataFrame:
    """(incident_id, time, alert_ids, rule_ids, tactics): members at one time form one step."""
    return members.where("time is not null").groupBy("incident_id", "time").agg(
        F.array_sort(F.collect_set("alert_id")).alias("alert_ids"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.array_sort(F.collect_set("tactic")).alias("tactics"))


def tactic_order(members: DataFrame) -> DataFrame:
    """(incident_id, tactics in order of first appearance)."""
    first = members.where("tactic is not null").groupBy("incident_id", "tactic").agg(F.min("time").alias("t"))
    return first.groupBy("incident_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "tactic"))), lambda x: x.tactic).alias("tactic_order"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating star contraction.

    ``edges``: (a, b). Each round points neighbours at the smallest node around them, so the depth
    shrinks geometrically. Minima are aggregated before the shuffle and joined back: a hub is never
    collected, and since the minima are written first, both sides of that join are exchanged and Spark
    splits a hub's rows. Rounds go on until nothing moves; each is cut off with a reliable checkpoint.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    nodes = both(edges).select(F.col("a").alias("node")).distinct()
    mark = None
    while True:
        around = both(links)
        low = cut_lineage(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = around.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        large = cut_lineage(large)
        floor = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(floor, "a").select(F.col("b").alias("x"), "m").unionByName(floor.select(F.col("a").alias("x"), "m"))
        links = cut_lineage(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == mark:
            break
        mark = now
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _node(*parts: Column) -> Column:
    return F.to_json(F.array(*parts))


def campaign_edges(members: DataFrame) -> DataFrame:
    """(a, b): each incident tied to its member alerts, of one tenant."""
    rows = members.select("tenant_id", "incident_id", "alert_id").distinct()
    return rows.select(_node(F.lit("i"), F.col("tenant_id"), F.col("incident_id")).alias("a"), _node(F.lit("z"), F.col("tenant_id"), F.col("alert_id")).alias("b"))


def campaign_nodes(members: DataFrame) -> DataFrame:
    """(node, root) of incidents and alerts: what :func:`advanced` goes on from."""
    return cut_lineage(components(cut_lineage(campaign_edges(members))))


def advanced(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, moved): known components with new edges taken in, and (root, new_root) of the components that were merged.

    Edges are lifted to the roots of their ends, where most fall together; only the components that the rest touches are
    worked out, on a graph of roots. Roots are smallest nodes, so the result is that of a run over all edges."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("new"))
    ends = cut_lineage(ends)
    lift = lambda df, c: df.join(ends.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    lifted = cut_lineage(lift(lift(edges.select("a", "b"), "a"), "b").where("a <> b").distinct())
    moved = cut_lineage(components(lifted).where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("new_root")))
    every = nodes.select("node", "root").unionByName(ends.where("new").select("node", "root"))
    out = every.join(moved, "root", "left").select("node", F.coalesce("new_root", "root").alias("root"))
    return cut_lineage(out), moved


def members_by_root(nodes: DataFrame, incident_rows: DataFrame) -> DataFrame:
    """(campaign_id, tenant_id, incident_id): a campaign is named after its first incident."""
    mine = incident_rows.select("tenant_id", "incident_id", _node(F.lit("i"), F.col("tenant_id"), F.col("incident_id")).alias("node")).distinct()
    named = mine.join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = cut_lineage(named.groupBy("root").agg(F.min("incident_id").alias("first")))
    ident = F.concat_ws(":", F.lit("campaign"), "tenant_id", F.substring(F.sha2("first", 256), 1, 16))
    return named.join(first, "root").select(ident.alias("campaign_id"), "tenant_id", "incident_id")


def campaign_members(members: DataFrame) -> DataFrame:
    """(campaign_id, tenant_id, incident_id): incidents of one tenant that share member alerts, transitively."""
    return members_by_root(campaign_nodes(members), members)


def campaigns(incident_rows: DataFrame, members: DataFrame, previous: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """One row per campaign with its sizes, tactics and, with ``previous`` (campaign_members before), how many former ids it took in.

    ``members`` are rows (tenant_id, incident_id, alert_id). ``nodes`` are components that are known already. Re-sent versions of an incident: the one
    with most members wins, then the greater content digest.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(incident_rows.columns))), 256)
    versions = incident_rows.groupBy("tenant_id", "incident_id").agg((F.count(F.lit(1)) - 1).alias("dups"))
    best = cut_lineage(sets.latest_by(incident_rows, ["tenant_id", "incident_id"], F.col("member_count"), digest))
    member = cut_lineage(members_by_root(campaign_nodes(members) if nodes is None else nodes, best))
    rows = member.join(best.select("tenant_id", "incident_id", "entity_type", "entity_value", "tactics"), ["tenant_id", "incident_id"]).join(versions, ["tenant_id", "incident_id"])
    alerts = member.join(members.select("tenant_id", "incident_id", "alert_id").distinct(), ["tenant_id", "incident_id"]).groupBy("campaign_id").agg(F.countDistinct("alert_id").alias("alert_count"))
    tactics = rows.select("campaign_id", F.explode("tactics").alias("x")).groupBy("campaign_id").agg(F.array_sort(F.collect_set("x")).alias("tactics"))
    sizes = rows.groupBy("campaign_id", "tenant_id").agg(
        F.count(F.lit(1)).alias("incident_count"), F.countDistinct("entity_type", "entity_value").alias("entity_count"),
        F.sum("dups").alias("duplicate_incidents_dropped"))
    out = sizes.join(alerts, "campaign_id").join(tactics, "campaign_id", "left")
    if previous is None:
        return out
    old = previous.select("tenant_id", "incident_id", F.col("campaign_id").alias("old"))
    absorbed = (member.join(old, ["tenant_id", "incident_id"]).where("old <> campaign_id").groupBy("campaign_id")
                .agg(F.countDistinct("old").alias("merged_from")))
    return out.join(absorbed, "campaign_id", "left").withColumn("merged_from", F.coalesce("merged_from", F.lit(0).cast("bigint")))


# ---- process ancestry --------------------------------------------------------------------------

def nearest_marked(parents: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, ancestor, distance): the nearest proper ancestor of each node that is marked; nodes without one are left out.

    Pointer doubling: a pointer that has met a marked node or the top of its tree rests, any other takes over the pointer of the node it
    stands on, which has come as far. Depth ``d`` takes log2(d) rounds, each one exchange on the node. A node with several parents keeps the
    least; nodes on or below a cycle never rest, and are left out after the rounds that the longest path could need.
    """
    one = parents.where("node is not null and parent is not null and node <> parent").groupBy("node").agg(F.min("parent").alias("at"))
    marks = cut_lineage(marked.select(F.col("node").alias("at")).distinct().withColumn("hit", F.lit(True)))
    state = cut_lineage(one.join(marks, "at", "left").select("node", "at", F.lit(1).cast("bigint").alias("far"), F.coalesce("hit", F.lit(False)).alias("hit")))
    moving, left = state.where("not hit").count(), state.count().bit_length() + 1
    while moving and left:
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("far").alias("_far"), F.col("hit").alias("_hit"))
        # a resting pointer is not asked for again; one at the top of its tree has nothing ahead and goes
        asked = state.where("not hit").join(ahead, "at").select("node", F.col("_at").alias("at"), (F.col("far") + F.col("_far")).alias("far"), F.col("_hit").alias("hit"))
        state = cut_lineage(state.where("hit").unionByName(asked))
        moving, left = state.where("not hit").count(), left - 1
    return state.where("hit").select("node", F.col("at").alias("ancestor"), F.col("far").alias("distance"))


def ancestor_links(members: DataFrame, processes: DataFrame) -> DataFrame:
    """(incident_id, from_event_id, to_event_id, distance): each alert on a process tied to the first alert of the nearest process above it
    that has an alert of the same incident, however many quiet processes lie between.

    ``members``: (incident_id, tenant_id, event_id, time, process); ``processes``: (tenant_id, process, parent) of all events."""
    name = lambda *c: _node(*[F.col(x) for x in c])
    alerted = members.where("process is not null").groupBy("incident_id", "tenant_id", "process").agg(F.min(F.struct("time", "event_id")).alias("first"))
    marked = cut_lineage(alerted.withColumn("node", name("tenant_id", "process")))
    tree = processes.select(name("tenant_id", "process").alias("node"), F.when(F.col("parent").isNotNull(), name("tenant_id", "parent")).alias("parent"))
    up = nearest_marked(tree, marked.select("node").distinct())
    # the nearest alerted ancestor may belong to other incidents only: from there on the walk goes from alerted process to alerted process
    held = marked.select("incident_id", "node", F.col("first.event_id").alias("event_id"))
    steps = held.select("incident_id", "node", "event_id").join(up, "node").withColumnRenamed("event_id", "to_event_id")
    done = []
    walk = cut_lineage(steps)
    for _ in range(64):
        met = walk.join(held.select("incident_id", F.col("node").alias("ancestor"), F.col("event_id").alias("from_event_id")), ["incident_id", "ancestor"], "left")
        met = cut_lineage(met)
        done.append(met.where("from_event_id is not null").select("incident_id", "from_event_id", "to_event_id", "distance"))
        rest = met.where("from_event_id is null").drop("from_event_id")
        onward = up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("distance").alias("_more"))
        walk = cut_lineage(rest.join(onward, "ancestor").select("incident_id", "node", "to_event_id", F.col("_up").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance")))
        if walk.isEmpty():
            break
    return sets.union_all(done)


# ---- entities ----------------------------------------------------------------------------------

def resolve_entities(alerts: DataFrame) -> DataFrame:
    """One row per entity over all alerts: first and last sighting, tactics, members, first and last alert."""
    rows = alerts.withColumn("e", F.explode(entities_of())).select("tenant_id", "alert_id", "time", "tactic", "e.*")
    value = S.bounded(S.canonical_entity(F.col("entity_type"), F.col("entity_value")))
    keyed = rows.withColumn("canonical_value", value).withColumn("entity_id", S.entity_id(F.col("tenant_id"), F.col("entity_type"), value)).where("entity_id is not null")
    return keyed.groupBy("entity_id", "tenant_id", "entity_type", "canonical_value").agg(
        F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.array_sort(F.collect_set("tactic")).alias("tactics"),
        F.countDistinct("alert_id").alias("member_count"), F.min_by("alert_id", F.struct("time", "alert_id")).alias("first_alert"),
        F.max_by("alert_id", F.struct("time", "alert_id")).alias("last_alert"))


def merge_entities(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Current entities with newer updates applied: (entity_id, last_seen, attributes map). Several updates of an
    entity are folded in time order first: the latest value of each attribute counts."""
    each = updates.select("entity_id", "last_seen", F.explode_outer("attributes").alias("k", "v"))
    latest = each.groupBy("entity_id", "k").agg(F.max_by("v", F.struct("last_seen", "v")).alias("v"), F.max("last_seen").alias("t"))
    updates = latest.groupBy("entity_id").agg(F.max("t").alias("last_seen"), F.map_from_entries(
        F.filter(F.collect_list(F.struct("k", "v")), lambda x: x["k"].isNotNull())).alias("attributes"))
    new = updates.select("entity_id", F.col("last_seen").alias("n_t"), F.col("attributes").alias("n_a"))
    newer = F.col("last_seen").isNull() | (F.col("n_t") > F.col("last_seen"))
    merged = F.map_from_entries(F.map_entries(F.map_concat(F.map_filter("attributes", lambda k, v: ~F.map_contains_key(F.col("n_a"), k)), F.col("n_a"))))
    return current.join(new, "entity_id", "full_outer").select(
        "entity_id", F.when(F.col("n_t").isNotNull() & newer, F.col("n_t")).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(F.col("n_t").isNull() | ~newer, F.col("attributes")).when(F.col("attributes").isNull(), F.col("n_a")).otherwise(merged).alias("attributes"))


def expire_entities(entities: DataFrame, now_ms: int, horizon_ms: int) -> DataFrame:
    return entities.where(F.col("last_seen") >= now_ms - horizon_ms)
