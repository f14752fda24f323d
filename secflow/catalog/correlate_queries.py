"""Incidents, graphs, campaigns, entities, inventory and baselines over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from secflow.catalog.fixture import BASE_SQL, base_events, spread_events, table
from secflow.catalog.registry import ORACLES, query
from secflow.functions import scalars as S
from secflow.operators import joins
from secflow.plans import correlate as C
from secflow.plans import evaluate as M
from secflow.plans import inventory as I
from secflow.session import cut_lineage

HOUR, DAY = 3_600_000, 86_400_000
ALERT_TEXT = {
    "alert_id": "concat('al', event_id)", "tenant_id": "concat('t', u % 3)", "time": "t", "rule_id": "etype",
    "tactic": "CASE etype WHEN 'error' THEN 'TA0001' WHEN 'click' THEN 'TA0011' WHEN 'view' THEN 'TA0106' WHEN 'purchase' THEN 'TA0003' END",
    "technique": "CASE etype WHEN 'error' THEN 'T1078' WHEN 'view' THEN 'T0836' ELSE 'T1' END", "score": "CAST(k AS INT)",
    "actor": "concat('User', u)", "ip": "concat('10.0.', k % 5, '.', u % 40)", "device": "CASE WHEN k % 4 <> 0 THEN concat('H', u % 30) END",
    "event_id": "concat('e', event_id)", "anomaly": "CAST(NULL AS STRING)",
}
ALERTS_SQL = (BASE_SQL + ", al AS (SELECT " + ", ".join(f"{v.replace('STRING', 'VARCHAR')} AS {k}" for k, v in ALERT_TEXT.items()) + f" FROM base)")
TRACKS_SQL = ALERTS_SQL + """, tr AS (SELECT *, 'actor' AS entity_type, actor AS entity_value FROM al UNION ALL SELECT *, 'ip', ip FROM al WHERE ip NOT LIKE '10.0.3.%'
UNION ALL SELECT *, 'device', device FROM al WHERE device IS NOT NULL AND device <> 'H7')"""
SESS_SQL = TRACKS_SQL + f""", op AS (SELECT *, CASE WHEN time - lag(time) OVER w <= {DAY} THEN NULL ELSE time END AS o FROM tr
WINDOW w AS (PARTITION BY tenant_id, entity_type, entity_value ORDER BY time)),
ss AS (SELECT *, max(o) OVER (PARTITION BY tenant_id, entity_type, entity_value ORDER BY time) AS first_seen FROM op),
hd AS (SELECT tenant_id, entity_type, entity_value, first_seen, max(time) AS last_seen, list_sort(list(DISTINCT tactic) FILTER (WHERE tactic IS NOT NULL)) AS tactics
       FROM ss GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT tactic) >= 2),
mb AS (SELECT concat(ss.tenant_id, ':', ss.entity_type, ':', ss.entity_value, ':', ss.first_seen // {DAY}) AS incident_id, ss.*, last_seen, tactics
       FROM ss JOIN hd USING (tenant_id, entity_type, entity_value, first_seen) WHERE time >= last_seen - {DAY}),
nb AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY time DESC, alert_id) AS newest FROM mb),
inc AS (SELECT incident_id, tenant_id, entity_type, entity_value, first_seen, last_seen, tactics, list_sort(list(alert_id) FILTER (WHERE newest <= {C.MEMBERS_SHOWN})) AS member_alert_ids,
        CAST(count(*) AS INT) AS member_count, CAST(least(sum(score), 1000) AS INT) AS severity, count(*) > {C.MEMBERS_SHOWN} AS truncated FROM nb GROUP BY 1, 2, 3, 4, 5, 6, 7)"""


def alerts(spark, sf):
    return spread_events(spark, sf).selectExpr(*[f"{v} AS {k}" for k, v in ALERT_TEXT.items()])


def shared(spark):
    return spark.createDataFrame([("10.0.3.0/24",), ("H7",)], "entry string")


def tracked(spark, sf):
    return C.incidents(C.alert_tracks(alerts(spark, sf), shared(spark)))


@query("incident_promotion", f"WITH {SESS_SQL} SELECT * FROM inc")
def incident_promotion(spark, sf):
    return tracked(spark, sf)[0]


@query("graph_nodes", f"""WITH {SESS_SQL}, n AS (SELECT incident_id, tenant_id, 'actor' AS ty, actor AS v FROM mb UNION ALL SELECT incident_id, tenant_id, 'ip', ip FROM mb
UNION ALL SELECT incident_id, tenant_id, 'device', device FROM mb WHERE device IS NOT NULL)
SELECT incident_id, sha256(concat(tenant_id, '|', ty, '|', lower(v))) AS entity_id, ty AS entity_type, min(v) AS entity_value FROM n GROUP BY 1, 2, 3""")
def graph_nodes(spark, sf):
    return C.graph_nodes(tracked(spark, sf)[1])


@query("graph_edges", f"""WITH {SESS_SQL}, p AS (
SELECT incident_id, tenant_id, 'actor' AS ft, actor AS fv, 'ip' AS tt, ip AS tv, alert_id, time, event_id, CASE WHEN tactic = 'TA0001' THEN 'authenticated_as' WHEN tactic = 'TA0011' THEN 'invoked' ELSE 'used_ip' END AS kind FROM mb
UNION ALL SELECT incident_id, tenant_id, 'actor', actor, 'device', device, alert_id, time, event_id, CASE WHEN tactic = 'TA0106' THEN 'wrote_to' WHEN tactic = 'TA0003' THEN 'changed' ELSE 'used_device' END FROM mb WHERE device IS NOT NULL
UNION ALL SELECT incident_id, tenant_id, 'device', device, 'ip', ip, alert_id, time, event_id, 'seen_at_ip' FROM mb WHERE device IS NOT NULL),
r AS (SELECT *, list_position(['caused_by','invoked','authenticated_as','wrote_to','changed','used_ip','used_device','seen_at_ip'], kind) AS rk FROM p)
SELECT incident_id, sha256(concat(tenant_id, '|', ft, '|', lower(fv))) AS from_id, sha256(concat(tenant_id, '|', tt, '|', lower(tv))) AS to_id,
arg_min(kind, (rk, time, event_id)) AS kind, arg_min(event_id, (rk, time, event_id)) AS event_id, arg_min(time, (rk, time, event_id)) AS ts_ms,
min(time) AS first_ts, max(time) AS last_ts, count(*) AS evidence_count FROM r GROUP BY 1, 2, 3""")
def graph_edges(spark, sf):
    return C.graph_edges(tracked(spark, sf)[1])


def _edges_sql(name: str) -> str:
    """A CTE of the graph edges: the end of the graph_edges SQL under a name."""
    body = ORACLES["graph_edges"].removeprefix(f"WITH {SESS_SQL}, ")
    head, _, last = body.rpartition("\nSELECT incident_id, sha256")
    return f"{head},\n{name} AS (SELECT incident_id, sha256{last})"


# Steps of a storyline: entities by the first digits of their ids.
STEP_SQL = "st AS (SELECT DISTINCT CAST('0x' || substr(e, 1, 2) AS BIGINT) % 40 AS step, e AS entity_id FROM (SELECT from_id AS e FROM ge UNION SELECT to_id FROM ge))"
PAIR_SQL = "rl AS (SELECT DISTINCT step % 5 AS storyline, step AS from_step, step + 1 AS to_step, step % 3 <> 0 AS allowed FROM st)"


def _steps(edges):
    ids = edges.select(F.explode(F.array("from_id", "to_id")).alias("entity_id")).distinct()
    return ids.select((F.conv(F.substring("entity_id", 1, 2), 16, 10).cast("bigint") % 40).alias("step"), "entity_id")


def _relations(steps):
    return steps.select((F.col("step") % 5).alias("storyline"), F.col("step").alias("from_step"), (F.col("step") + 1).alias("to_step"), (F.col("step") % 3 != 0).alias("allowed")).distinct()


@query("step_order", f"""WITH {SESS_SQL}, {_edges_sql('ge')}, {STEP_SQL}, {PAIR_SQL}, ow AS (SELECT DISTINCT st.step, ge.* FROM ge JOIN st ON st.entity_id = ge.from_id OR st.entity_id = ge.to_id),
iv AS (SELECT step, min(first_ts) AS lo, max(last_ts) AS hi FROM ow GROUP BY 1)
SELECT rl.*, CASE WHEN a.lo IS NULL OR b.lo IS NULL THEN 'untimed' WHEN a.hi < b.lo THEN 'forward' WHEN b.hi < a.lo THEN 'reverse' ELSE 'concurrent' END AS "order"
FROM rl LEFT JOIN iv a ON a.step = from_step LEFT JOIN iv b ON b.step = to_step""")
def step_order(spark, sf):
    """Graph edges attributed to the steps that own their ends, and the order of each pair of steps."""
    edges = cut_lineage(C.graph_edges(tracked(spark, sf)[1]))
    steps = cut_lineage(_steps(edges))
    return M.step_order(_relations(steps), M.step_intervals(edges, steps))


@query("chain_fidelity_of_edges", f"""WITH {SESS_SQL}, {_edges_sql('ge')}, {STEP_SQL}, {PAIR_SQL}, se AS (SELECT DISTINCT a.step AS from_step, b.step AS to_step FROM ge JOIN st a ON a.entity_id = from_id JOIN st b ON b.entity_id = to_id WHERE a.step <> b.step),
j AS (SELECT rl.*, se.from_step IS NOT NULL AS hit FROM rl LEFT JOIN se USING (from_step, to_step)),
c AS (SELECT storyline, count(*) FILTER (WHERE allowed) AS wanted, count(*) FILTER (WHERE allowed AND hit) AS found, count(*) FILTER (WHERE NOT allowed AND hit) AS forbidden_found FROM j GROUP BY 1)
SELECT *, round(found / nullif(wanted + forbidden_found, 0), 6) AS fidelity FROM c""")
def chain_fidelity_of_edges(spark, sf):
    edges = cut_lineage(C.graph_edges(tracked(spark, sf)[1]))
    steps = cut_lineage(_steps(edges))
    return M.chain_fidelity(M.step_edges(edges, steps), _relations(steps))


# A forest of processes: chains of 300, each hung below a process of another; a few processes carry an alert.
TREE_SQL = f"WITH RECURSIVE {BASE_SQL}, tr AS (SELECT event_id AS node, CASE WHEN event_id % 300 <> 0 THEN event_id - 1 WHEN event_id > 0 THEN event_id // 2 END AS parent, etype = 'error' AND k > 92 AS mark FROM base)"


@query("process_ancestry", TREE_SQL + """, up(node, above, far) AS (SELECT node, parent, 1 FROM tr WHERE parent IS NOT NULL UNION ALL SELECT up.node, tr.parent, far + 1 FROM up JOIN tr ON tr.node = up.above WHERE NOT tr.mark AND tr.parent IS NOT NULL)
SELECT up.node, above AS ancestor, CAST(far AS BIGINT) AS distance FROM up JOIN tr ON tr.node = up.above WHERE tr.mark""")
def process_ancestry(spark, sf):
    """The nearest process above each one that carries an alert."""
    rows = base_events(spark, sf)
    parent = F.when(F.col("event_id") % 300 != 0, F.col("event_id") - 1).when(F.col("event_id") > 0, F.floor(F.col("event_id") / 2).cast("bigint"))
    return C.nearest_marked(rows.select(F.col("event_id").alias("node"), parent.alias("parent")), rows.where("etype = 'error' and k > 92").select(F.col("event_id").alias("node")))


@query("tactic_sources", f"WITH {SESS_SQL} SELECT incident_id, tactic, list_sort(list(alert_id)) AS alert_ids FROM mb WHERE tactic IS NOT NULL GROUP BY 1, 2")
def tactic_sources(spark, sf):
    return C.tactic_sources(tracked(spark, sf)[1])


@query("incident_timeline", f"""WITH {SESS_SQL} SELECT incident_id, time, list_sort(list(DISTINCT alert_id)) AS alert_ids, list_sort(list(DISTINCT rule_id)) AS rule_ids,
coalesce(list_sort(list(DISTINCT tactic) FILTER (WHERE tactic IS NOT NULL)), []) AS tactics FROM mb GROUP BY 1, 2""")
def incident_timeline(spark, sf):
    return C.incident_timeline(tracked(spark, sf)[1])


@query("tactic_order", f"""WITH {SESS_SQL}, f AS (SELECT incident_id, tactic, min(time) AS t FROM mb WHERE tactic IS NOT NULL GROUP BY 1, 2)
SELECT incident_id, list(tactic ORDER BY t, tactic) AS tactic_order FROM f GROUP BY 1""")
def tactic_order(spark, sf):
    return C.tactic_order(tracked(spark, sf)[1])


@query("graph_links", f"""WITH {SESS_SQL}, ky AS (SELECT incident_id, tenant_id, alert_id, event_id, time, ip AS h FROM mb),
hl AS (SELECT tenant_id, h, count(DISTINCT alert_id) AS every FROM ky GROUP BY 1, 2), mn AS (SELECT tenant_id, h, incident_id, count(*) AS mine FROM ky GROUP BY 1, 2, 3),
ok AS (SELECT ky.* FROM ky JOIN hl USING (tenant_id, h) JOIN mn USING (tenant_id, h, incident_id) WHERE mine = every),
ch AS (SELECT incident_id, lag(event_id) OVER w AS f, lag(time) OVER w AS ft, event_id AS x, time FROM ok WINDOW w AS (PARTITION BY incident_id, h ORDER BY time, event_id))
SELECT incident_id, 'network_flow' AS basis, f AS from_event_id, x AS to_event_id, CASE WHEN ft < time THEN 'forward' ELSE 'concurrent' END AS "order", ft AS from_ts, time AS to_ts,
'asserted' AS trust FROM ch WHERE f IS NOT NULL""")
def graph_links(spark, sf):
    members = tracked(spark, sf)[1]
    key = F.struct(F.lit("flow").alias("ns"), F.lit("self").alias("role"), F.col("ip").alias("h"), F.lit("asserted").alias("scope_trust"))
    return C.graph_links(members.withColumn("causal_keys", F.array(key)))


def _camp_sql(suffix: str = "", where: str = "TRUE") -> str:
    """CTEs ending in cm: the campaign of each incident, of the members for which a condition holds."""
    return f""", sh{suffix} AS (SELECT DISTINCT incident_id, tenant_id, alert_id AS a FROM mb WHERE {where}),
ne{suffix} AS MATERIALIZED (SELECT DISTINCT x.incident_id AS p, y.incident_id AS q FROM sh{suffix} x JOIN sh{suffix} y ON x.a = y.a AND x.tenant_id = y.tenant_id),
rc{suffix} AS (SELECT p, q FROM ne{suffix} UNION SELECT r.p, n.q FROM rc{suffix} r JOIN ne{suffix} n ON r.q = n.p), rt{suffix} AS (SELECT p AS incident_id, min(q) AS first FROM rc{suffix} GROUP BY 1),
cm{suffix} AS (SELECT concat('campaign:', tenant_id, ':', substr(sha256(first), 1, 16)) AS campaign_id, inc.* FROM inc JOIN rt{suffix} USING (incident_id))"""


CAMP_SQL = SESS_SQL + _camp_sql()
SIZES_SQL = """SELECT cm.campaign_id, tenant_id, count(*) AS incident_count, count(DISTINCT (entity_type, entity_value)) AS entity_count, CAST(0 AS BIGINT) AS duplicate_incidents_dropped,
any_value(al.n) AS alert_count, list_sort(list_distinct(flatten(list(tactics)))) AS tactics{more} FROM cm JOIN (SELECT campaign_id, count(DISTINCT mb.alert_id) AS n FROM mb JOIN cm USING (incident_id) GROUP BY 1) al USING (campaign_id){join} GROUP BY 1, 2"""


@query("campaign_members", f"WITH RECURSIVE {CAMP_SQL} SELECT campaign_id, tenant_id, incident_id FROM cm")
def campaign_members(spark, sf):
    return C.campaign_members(tracked(spark, sf)[1])


@query("campaigns", f"WITH RECURSIVE {CAMP_SQL} " + SIZES_SQL.format(more="", join=""))
def campaigns(spark, sf):
    rows, members = tracked(spark, sf)
    return C.campaigns(cut_lineage(rows), members)


@query("campaigns_grown", f"WITH RECURSIVE {CAMP_SQL}{_camp_sql('0', 'entity_type <> ' + chr(39) + 'ip' + chr(39))}, ab AS (SELECT cm.campaign_id, count(DISTINCT cm0.campaign_id) AS merged FROM cm JOIN cm0 USING (incident_id) WHERE cm.campaign_id <> cm0.campaign_id GROUP BY 1) "
       + SIZES_SQL.format(more=", coalesce(any_value(merged), 0) AS merged_from", join=" LEFT JOIN ab USING (campaign_id)"))
def campaigns_grown(spark, sf):
    """Campaigns of all incidents, from those without the ones by address: known components go on with the new members only."""
    rows, members = tracked(spark, sf)
    rows = cut_lineage(rows)
    before = members.where("entity_type <> 'ip'")
    known = C.campaign_nodes(before)
    nodes, _ = C.advanced(known, C.campaign_edges(members.where("entity_type = 'ip'")))
    return C.campaigns(rows, members, C.members_by_root(known, before), nodes)


@query("entity_rollup", f"""WITH {ALERTS_SQL}, n AS (SELECT *, 'actor' AS ty, actor AS v FROM al UNION ALL SELECT *, 'ip', ip FROM al UNION ALL SELECT *, 'device', device FROM al WHERE device IS NOT NULL)
SELECT sha256(concat(tenant_id, '|', ty, '|', lower(v))) AS entity_id, tenant_id, ty AS entity_type, lower(v) AS canonical_value, min(time) AS first_seen, max(time) AS last_seen,
coalesce(list_sort(list(DISTINCT tactic) FILTER (WHERE tactic IS NOT NULL)), []) AS tactics, count(*) AS member_count, arg_min(alert_id, (time, alert_id)) AS first_alert, arg_max(alert_id, (time, alert_id)) AS last_alert
FROM n GROUP BY 1, 2, 3, 4""")
def entity_rollup(spark, sf):
    return C.resolve_entities(alerts(spark, sf))


@query("entity_ids", "SELECT c_custkey, sha256(concat('acme|actor|', lower(trim(c_name)))) AS entity_id, CASE WHEN strlen(c_name || c_name || c_name) > 40 THEN substr(c_name || c_name || c_name, 1, 23) || ':' || substr(sha256(c_name || c_name || c_name), 1, 16) ELSE c_name || c_name || c_name END AS bounded FROM customer")
def entity_ids(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", S.entity_id(F.lit("acme"), F.lit("actor"), S.canonical_entity(F.lit("actor"), F.col("c_name"))).alias("entity_id"),
                    S.bounded(F.concat("c_name", "c_name", "c_name"), 40).alias("bounded"))


@query("alert_keys", "SELECT o_orderkey, concat('r:t:', length(o_orderpriority), ':', o_orderpriority, ':', (epoch_us(o_orderdate) // 1000) // 3600000) AS k FROM orders")
def alert_keys(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.alert_key(F.lit("r"), F.lit("t"), F.col("o_orderpriority"), S.epoch_ms_of(F.col("o_orderdate")), HOUR).alias("k"))


@query("entity_merge", """WITH c AS (SELECT c_custkey AS id, c_custkey % 7 AS t FROM customer WHERE c_custkey % 2 = 0), u AS (SELECT c_custkey AS id, c_custkey % 5 AS t FROM customer WHERE c_custkey % 3 = 0)
SELECT concat('x', coalesce(c.id, u.id)) AS entity_id, CASE WHEN u.t IS NOT NULL AND (c.t IS NULL OR u.t > c.t) THEN u.t ELSE c.t END AS last_seen,
CASE WHEN u.t IS NOT NULL AND (c.t IS NULL OR u.t > c.t) THEN 'new' ELSE 'old' END AS src FROM c FULL OUTER JOIN u ON c.id = u.id""")
def entity_merge(spark, sf):
    rows = table(spark, sf, "customer").select(F.concat(F.lit("x"), "c_custkey").alias("entity_id"), "c_custkey")
    side = lambda m, d, tag: rows.where(F.col("c_custkey") % d == 0).select("entity_id", (F.col("c_custkey") % m).alias("last_seen"), F.create_map(F.lit("src"), F.lit(tag)).alias("attributes"))
    return C.merge_entities(side(7, 2, "old"), side(5, 3, "new")).select("entity_id", "last_seen", F.col("attributes")["src"].alias("src"))


# ---- inventory and baselines -------------------------------------------------------------------

OBS_SQL = BASE_SQL + ", ob AS (SELECT concat('t', u % 2) AS tenant_id, concat('m', u % 50) AS mac, concat('10.0.0.', k // 25) AS ip, t FROM base WHERE etype = 'view')"
HIST_SQL = OBS_SQL + """, lg AS (SELECT *, lag(ip) OVER (PARTITION BY tenant_id, mac ORDER BY t) AS pv FROM ob), ch AS (SELECT * FROM lg WHERE pv IS NULL OR pv <> ip),
hi AS (SELECT tenant_id, mac, ip, t AS from_ts, lead(t) OVER (PARTITION BY tenant_id, mac ORDER BY t) AS to_ts FROM ch)"""


def observations(spark, sf):
    return base_events(spark, sf).where("etype = 'view'").selectExpr("concat('t', u % 2) AS tenant_id", "concat('m', u % 50) AS mac", "concat('10.0.0.', k div 25) AS ip",
                                                                     "CASE WHEN k % 3 = 0 THEN concat('h', k) END AS hostname", "t", "event_id", "k", "u")


@query("ip_history_scd2", f"WITH {HIST_SQL} SELECT * FROM hi")
def ip_history_scd2(spark, sf):
    return I.ip_history(observations(spark, sf))


@query("resolve_ip_at", f"""WITH {HIST_SQL}, q AS (SELECT event_id, concat('t', u % 2) AS tenant_id, concat('10.0.0.', k // 25) AS ip, t FROM base WHERE etype = 'click')
SELECT event_id, (SELECT max((from_ts, mac))[2] FROM hi WHERE hi.tenant_id = q.tenant_id AND hi.ip = q.ip AND from_ts <= t AND (to_ts IS NULL OR t < to_ts)) AS mac FROM q""")
def resolve_ip_at(spark, sf):
    asked = base_events(spark, sf).where("etype = 'click'").selectExpr("event_id", "concat('t', u % 2) AS tenant_id", "concat('10.0.0.', k div 25) AS ip", "t")
    return I.resolve_ip_at(asked, I.ip_history(observations(spark, sf))).select("event_id", "mac")


@query("new_devices", f"""WITH {OBS_SQL}, f AS (SELECT tenant_id, mac, min(t) AS first_seen FROM ob GROUP BY 1, 2), s AS (SELECT tenant_id, min(first_seen) AS st FROM f GROUP BY 1)
SELECT tenant_id, mac, first_seen FROM f JOIN s USING (tenant_id) WHERE first_seen > st + {4 * HOUR}""")
def new_devices(spark, sf):
    return I.new_devices(observations(spark, sf), 4 * HOUR)


@query("assets", f"""WITH {BASE_SQL}, ob AS (SELECT concat('t', u % 2) AS tenant_id, concat('m', u % 50) AS mac, concat('10.0.0.', k // 25) AS ip, CASE WHEN k % 3 = 0 THEN concat('h', k) END AS hostname, t FROM base WHERE etype = 'view')
SELECT tenant_id, mac, arg_max(ip, t) AS ip, arg_max(hostname, t) FILTER (WHERE hostname IS NOT NULL) AS hostname, min(t) AS first_seen, max(t) AS last_seen FROM ob GROUP BY 1, 2""")
def assets(spark, sf):
    return I.assets(observations(spark, sf))


@query("baseline_deviations", f"""WITH {BASE_SQL}, f AS (SELECT u, min(t) AS t0 FROM base GROUP BY 1), n AS (SELECT *, count(*) OVER (PARTITION BY u ORDER BY t RANGE BETWEEN {7 * DAY} PRECEDING AND CURRENT ROW) AS n,
coalesce(t - lag(t) OVER (PARTITION BY u, k ORDER BY t) > {7 * DAY}, true) AS nk, coalesce(t - lag(t) OVER (PARTITION BY u, etype ORDER BY t) > {7 * DAY}, true) AS ne FROM base)
SELECT u, t, event_id, list_filter([CASE WHEN nk THEN 'new k' END, CASE WHEN ne THEN 'new etype' END], lambda x: x IS NOT NULL) AS reasons FROM n JOIN f USING (u)
WHERE t - t0 >= {7 * DAY} AND n >= 15 AND (nk OR ne)""")
def baseline_deviations(spark, sf):
    return I.deviations(base_events(spark, sf).select("u", "t", "event_id", "k", "etype"), "u", ["k", "etype"], 7 * DAY, 15)


@query("baseline_snapshot", f"WITH {BASE_SQL}, m AS (SELECT max(t) AS x FROM base) SELECT u, 'etype' AS feature, etype AS value, count(*) AS n FROM base WHERE t BETWEEN 1706000000000 - {7 * DAY} AND 1706000000000 GROUP BY 1, 3")
def baseline_snapshot(spark, sf):
    return I.baseline_snapshot(base_events(spark, sf), "u", ["etype"], 1_706_000_000_000, 7 * DAY)


NETS = "CASE s_suppkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 24 END"
IPS_SQL = "concat('10.', c_custkey % 8, '.', c_custkey % 5, '.', c_custkey % 250)"


@query("cidr_lpm", f"""WITH n AS (SELECT s_suppkey AS v, {NETS} AS len, (10 * 256 + s_suppkey % 8) * 65536 + (s_suppkey % 5) * 256 AS base FROM supplier),
c AS (SELECT c_custkey, (10 * 256 + c_custkey % 8) * 65536 + (c_custkey % 5) * 256 + c_custkey % 250 AS ip FROM customer)
SELECT c_custkey, max((len, v))[2] AS v FROM (SELECT c_custkey, n.len, n.v FROM c LEFT JOIN n ON c.ip >> (32 - n.len) = n.base >> (32 - n.len)) GROUP BY 1""")
def cidr_lpm(spark, sf):
    nets = table(spark, sf, "supplier").selectExpr(f"concat('10.', s_suppkey % 8, '.', s_suppkey % 5, '.0/', {NETS}) AS cidr", "s_suppkey AS v")
    return joins.cidr_lpm(table(spark, sf, "customer").selectExpr("c_custkey", f"{IPS_SQL} AS ip"), "ip", nets, "cidr", ["v"], "v").select("c_custkey", "v")


@query("not_listed", """SELECT c_custkey FROM customer WHERE NOT (c_custkey % 8 = 3) AND NOT (c_custkey % 8 = 5 AND c_custkey % 5 = 2) AND c_custkey % 8 NOT IN (6, 7) OR c_custkey % 11 = 0""")
def not_listed(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey", f"CASE WHEN c_custkey % 11 <> 0 THEN {IPS_SQL} END AS ip")
    nets = spark.createDataFrame([("10.3.0.0/16",), ("10.5.2.0/24",), ("10.6.0.0/15",)], "entry string")
    return joins.not_listed(rows, "ip", nets).select("c_custkey")


@query("ioc_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, p_size AS score FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey")
def ioc_lookup(spark, sf):
    bad = table(spark, sf, "part").where("p_size > 25")
    return joins.lookup(table(spark, sf, "lineitem"), bad, "l_partkey", "p_partkey", score="p_size").select("l_orderkey", "l_linenumber", "l_partkey", "score")


@query("verdict_first_match", """WITH a AS (SELECT o_orderkey, [o_custkey, o_custkey + 7, o_orderkey] AS h FROM orders), t AS (SELECT o_orderkey, unnest(h) AS x, generate_subscripts(h, 1) AS p FROM a)
SELECT o.o_orderkey, arg_min(c_mktsegment, p) AS segment FROM orders o LEFT JOIN (SELECT t.*, c_mktsegment FROM t JOIN customer ON x = c_custkey AND c_custkey % 3 = 0) j USING (o_orderkey) GROUP BY 1""")
def verdict_first_match(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", F.array(F.col("o_custkey"), F.col("o_custkey") + 7, F.col("o_orderkey")).alias("h"))
    side = table(spark, sf, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return joins.first_match(left, "o_orderkey", "h", side, "c_custkey", ["segment"]).select("o_orderkey", "segment")
