"""Windows, scoring, suppression, gating and alerts over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from secflow.catalog.fixture import BASE_SQL, EV_SQL, base_events, security_events
from secflow.catalog.registry import query
from secflow.catalog.rule_queries import FILTERS, level_sql, members_sql, stretched
from secflow.functions import scalars as S
from secflow.operators import sets, sliding
from secflow.operators.cooldown import cooldown
from secflow.plans import detect
from secflow.plans.rules import BY_NAME, FLOORS, RULES, rule_table

DAY = 86_400_000
HOUR = 3_600_000

# ---- windows (W) -------------------------------------------------------------------------------


@query("sliding_count_bruteforce", f"""WITH {BASE_SQL}, e AS (SELECT * FROM base WHERE etype = 'error')
SELECT u, t, n FROM (SELECT u, t, count(*) OVER (PARTITION BY u ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS n
FROM e) GROUP BY u, t, n""")
def sliding_count_bruteforce(spark, sf):
    return sliding.sliding_count(base_events(spark, sf).where("etype = 'error'"), ["u"], DAY)


@query("sliding_distinct_scan", f"""WITH {BASE_SQL}, e AS (SELECT * FROM base WHERE etype = 'click')
SELECT a.u, a.t, count(DISTINCT b.k) AS n FROM (SELECT DISTINCT u, t FROM e) a JOIN e b
ON a.u = b.u AND b.t BETWEEN a.t - {5 * DAY} AND a.t GROUP BY 1, 2""")
def sliding_distinct_scan(spark, sf):
    return sliding.sliding_distinct(base_events(spark, sf).where("etype = 'click'"), ["u"], "k", 5 * DAY)


@query("beacon_cv", f"""WITH {BASE_SQL}, e AS (SELECT DISTINCT u, t, event_id FROM base WHERE etype = 'view'),
p AS (SELECT DISTINCT u, t FROM e),
g AS (SELECT a.u, a.t, b.t - lag(b.t) OVER (PARTITION BY a.u, a.t ORDER BY b.t, b.event_id) AS gap
      FROM p a JOIN e b ON a.u = b.u AND b.t BETWEEN a.t - {4 * DAY} AND a.t)
SELECT u, t, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(stddev_pop(gap) / nullif(avg(gap), 0), 6) END AS cv
FROM g GROUP BY u, t""")
def beacon_cv(spark, sf):
    out = sliding.sliding_cv(base_events(spark, sf).where("etype = 'view'"), ["u"], 4 * DAY)
    return out.select("u", "t", "n", F.round("cv", 6).alias("cv"))


@query("peak_windows", f"""WITH {BASE_SQL}, e AS (SELECT DISTINCT u, t FROM base WHERE etype = 'click'),
n AS (SELECT a.u, a.t, count(DISTINCT b.k) AS n FROM e a JOIN (SELECT * FROM base WHERE etype = 'click') b
ON a.u = b.u AND b.t BETWEEN a.t - {2 * DAY} AND a.t GROUP BY 1, 2)
SELECT u, max(n) AS peak, min(t) FILTER (WHERE n = m) AS peak_t
FROM (SELECT *, max(n) OVER (PARTITION BY u) AS m FROM n) GROUP BY u""")
def peak_windows(spark, sf):
    clicks = base_events(spark, sf).where("etype = 'click'")
    return sliding.peak(sliding.sliding_distinct(clicks, ["u"], "k", 2 * DAY), ["u"])


@query("window_clock", f"""WITH {BASE_SQL}, r AS (SELECT event_id, t, t + (k - 50) * 60000 AS recv FROM base)
SELECT event_id, CASE WHEN abs(t - recv) > 600000 THEN recv ELSE t END AS wide,
CASE WHEN abs(t - recv) > 30000 THEN recv ELSE t END AS narrow, recv AS ingest, t AS record FROM r""")
def window_clock(spark, sf):
    t, recv = F.col("t"), F.col("t") + (F.col("k") - 50) * 60_000
    return base_events(spark, sf).select(
        "event_id", S.window_time(t, recv, HOUR).alias("wide"), S.window_time(t, recv, 60_000).alias("narrow"),
        S.window_time(t, recv, HOUR, "ingest").alias("ingest"), S.window_time(t, recv, HOUR, "event").alias("record"))


@query("track_sessions", f"""WITH {BASE_SQL}, e AS (SELECT DISTINCT u, t FROM base),
f AS (SELECT u, t, CASE WHEN t - lag(t) OVER w <= {6 * HOUR} THEN NULL ELSE t END AS opened FROM e WINDOW w AS (PARTITION BY u ORDER BY t)),
s AS (SELECT u, t, max(opened) OVER (PARTITION BY u ORDER BY t) AS session_start FROM f)
SELECT u, session_start, max(t) AS session_end, count(*) AS n FROM s GROUP BY 1, 2""")
def track_sessions(spark, sf):
    marked = sliding.sessions(base_events(spark, sf), ["u"], 6 * HOUR)
    return marked.groupBy("u", "session_start").agg(F.max("t").alias("session_end"), F.count(F.lit(1)).alias("n"))


@query("baseline_novelty", f"""WITH {BASE_SQL}, e AS (SELECT DISTINCT u, k, t FROM base)
SELECT u, k, t, coalesce(t - lag(t) OVER (PARTITION BY u, k ORDER BY t) > {7 * DAY}, true) AS novel FROM e""")
def baseline_novelty(spark, sf):
    return sliding.novelty(base_events(spark, sf), ["u"], "k", 7 * DAY)


@query("cooldown_walk", f"""WITH RECURSIVE {BASE_SQL}, e AS (SELECT DISTINCT etype, t FROM base),
nx AS MATERIALIZED (SELECT a.etype, a.t, b.t AS nt FROM e a ASOF JOIN e b ON a.etype = b.etype AND a.t + {3 * HOUR} <= b.t),
walk AS (SELECT etype, min(t) AS t FROM e GROUP BY etype UNION ALL
         SELECT w.etype, nx.nt AS t FROM walk w JOIN nx ON nx.etype = w.etype AND nx.t = w.t WHERE nx.nt IS NOT NULL)
SELECT etype, t FROM walk""")
def cooldown_walk(spark, sf):
    return cooldown(base_events(spark, sf), ["etype"], 3 * HOUR)


@query("dedup_redelivery", f"""WITH {BASE_SQL}, d AS (SELECT event_id, u, t FROM base UNION ALL
SELECT event_id, u, t + 5 AS t FROM base WHERE k % 3 = 0)
SELECT u, concat('e', event_id) AS _id, max(t) AS t FROM d GROUP BY 1, 2""")
def dedup_redelivery(spark, sf):
    base = base_events(spark, sf).select(F.concat(F.lit("e"), "event_id").alias("event_id"), "u", "t", "k")
    twice = base.unionByName(base.where("k % 3 = 0").withColumn("t", F.col("t") + 5))
    return sets.distinct_events(twice, ["u"])


# ---- the assembled detection job (D) -----------------------------------------------------------

PICKED = tuple(stretched(BY_NAME[n]) for n in (
    "common_bruteforce", "common_bruteforce_by_account", "common_port_scan", "common_port_scan_by_target",
    "bank_db_priv_esc", "ot_modbus_unauthorized_write", "ot_modbus_unauthorized_write_ticketed",
    "ot_write_unlisted_source", "win_lsass_access_suspicious", "common_password_spray_by_source"))
IDS = {r.name: r.id for r in RULES}


def hits_sql(rules=PICKED, out: str = "hits") -> str:
    """CTEs ending in ``out``: (eid, tenant, rule_id, grp, t, n)."""
    ctes, parts = [], []
    for i, r in enumerate(rules):
        if r.stateful:
            ctes += [members_sql(r, f"m{i}"), level_sql(r, f"m{i}", f"lv{i}")]
            parts.append(f"SELECT eid, tenant, '{r.id}' AS rule_id, grp, t, CAST(n AS BIGINT) AS n FROM lv{i} WHERE n >= {r.threshold}")
        else:
            parts.append(f"SELECT ingest_id AS eid, tenant, '{r.id}' AS rule_id, CAST(NULL AS VARCHAR) AS grp, t,"
                         f" CAST(NULL AS BIGINT) AS n FROM ev WHERE {FILTERS[r.name]}")
    return f"{EV_SQL}, {', '.join(ctes)}, {out} AS ({' UNION ALL '.join(parts)})"


RULES_SQL = "rl AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r.id}', {r.weight}, {FLOORS[r.level]}, {str(r.exposure_gate).lower()})" for r in RULES
) + ") AS x(rule_id, weight, floor, exposed))"


@query("rule_hits", f"WITH {hits_sql()} SELECT tenant, eid AS event_key, rule_id, grp, t, n FROM hits")
def rule_hits(spark, sf):
    hits = detect.run_rules(security_events(spark, sf), PICKED, tenant_rules=None, mode="event", suppress=False)
    return hits.select("tenant", "event_key", "rule_id", "grp", "t", "n")


def _covered_sql(rules=PICKED) -> str:
    """CTEs ending in kept: hits without those of a companion whose windows its sibling's windows hold. Only windows that fired together with
    the sibling's are looked at; events of a window are compared by number, values as sorted lists."""
    pos, ctes, found = {r.name: i for i, r in enumerate(rules)}, [], []
    for r in rules:
        if not r.stateful or r.companion_of not in pos:
            continue
        c, s, w = pos[r.name], pos[r.companion_of], r.window_s * 1000
        ctes.append(f"p{c} AS (SELECT c.eid, c.tenant, c.rule_id, c.grp, c.t, c.n, s.grp AS sgrp, s.t AS st FROM hits c JOIN hits s ON s.eid = c.eid AND s.rule_id = '{rules[s].id}' WHERE c.rule_id = '{r.id}')")
        inside = f"m{{0}} b ON b.tenant = p.tenant AND b.grp = p.{{1}} AND b.t BETWEEN p.{{2}} - {w} AND p.{{2}}"
        if r.distinct:
            vals = lambda m, grp, t: f"SELECT p.eid, list_sort(list(DISTINCT b.val)) AS vals FROM p{c} p JOIN {inside.format(m, grp, t)} GROUP BY 1"  # noqa: E731,B023
            found.append(f"SELECT x.eid, '{r.id}' AS rule_id FROM ({vals(c, 'grp', 't')}) x JOIN ({vals(s, 'sgrp', 'st')}) y ON x.eid = y.eid AND x.vals = y.vals")
        else:
            found.append(f"SELECT p.eid, p.rule_id FROM p{c} p JOIN {inside.format(c, 'grp', 't')} JOIN m{s} d ON d.eid = b.eid AND d.grp = p.sgrp GROUP BY p.eid, p.rule_id, p.n HAVING count(*) = p.n")
    return f"{', '.join(ctes)}, covered AS ({' UNION ALL '.join(found)}), kept AS (SELECT h.* FROM hits h ANTI JOIN covered c ON c.eid = h.eid AND c.rule_id = h.rule_id)"


@query("companion_suppression", f"WITH {hits_sql()}, {_covered_sql()} SELECT tenant, eid AS event_key, rule_id, grp, t, n FROM kept")
def companion_suppression(spark, sf):
    hits = detect.run_rules(security_events(spark, sf), PICKED, mode="event")
    return hits.select("tenant", "event_key", "rule_id", "grp", "t", "n")


POINTS_SQL = ("pts AS (SELECT ingest_id AS eid, max(CASE ot_address % 4 WHEN 0 THEN 20 WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END) AS p"
              " FROM ev WHERE ot_address % 5 <> 0 GROUP BY 1)")
SCORE_SQL = f"""{RULES_SQL}, {POINTS_SQL},
a AS (SELECT k.tenant, k.eid, sum(weight) AS w, max(floor) AS fl, sum(weight) FILTER (WHERE exposed) AS we,
      max(floor) FILTER (WHERE exposed) AS fe, list_sort(list(DISTINCT k.rule_id)) AS rule_ids
      FROM kept k JOIN rl USING (rule_id) GROUP BY 1, 2),
sc AS (SELECT a.*, coalesce(p, 0) AS p, least(100, greatest(w, fl)) AS base FROM a LEFT JOIN pts USING (eid)),
scored AS (SELECT tenant, eid, rule_ids, CAST(least(100, base + p) AS INT) AS score,
      CAST(greatest(base, CASE WHEN we IS NULL THEN 0 ELSE least(100, least(100, greatest(we, fe)) + p) END) AS INT) AS routing_score FROM sc)"""


def _points(spark, sf):
    """Control-system addresses of the events table with a criticality by address."""
    address = F.col("unmapped.ot.address")
    level = (F.when(address % 4 == 0, "critical").when(address % 4 == 1, "high").when(address % 4 == 2, "medium")
             .otherwise("low"))
    return (security_events(spark, sf).where((address % 5) != 0)
            .select(address.alias("wire_address"), level.alias("criticality")).distinct())


@query("score_and_route", f"""WITH {hits_sql()}, {_covered_sql()}, {SCORE_SQL}
SELECT tenant, eid AS event_key, score, routing_score, rule_ids,
CASE WHEN routing_score >= 60 THEN 'deep' WHEN routing_score >= 20 THEN 'light' ELSE 'store' END AS route FROM scored""")
def score_and_route(spark, sf):
    events = security_events(spark, sf)
    hits = detect.run_rules(events, PICKED, mode="event")
    return detect.score_events(hits, PICKED, detect.exposure_points(events, _points(spark, sf)))


WIDTHS_SQL = "wd AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r.id}', CAST({max(r.window_s, 1) * 1000} AS BIGINT))" for r in PICKED) + ") AS x(rule_id, width))"
ALERT_ID_SQL = ("CASE WHEN grp IS NULL THEN concat(rule_id, ':', tenant, ':', eid) ELSE concat(rule_id, ':', tenant, ':',"
                " length(grp), ':', grp, ':', t // width) END")
ALERTS_SQL = f"""{WIDTHS_SQL}, keyed AS (SELECT {ALERT_ID_SQL} AS alert_id, kept.*, width FROM kept JOIN wd USING (rule_id)),
al AS (SELECT alert_id, rule_id, tenant, grp, max(t) AS t, arg_max(eid, (t, eid)) AS eid, arg_max(n, (t, eid)) AS n,
       count(*) AS hits, any_value(width) AS width FROM keyed GROUP BY 1, 2, 3, 4)"""


@query("alerts_collapsed", f"WITH {hits_sql()}, {_covered_sql()}, {ALERTS_SQL} SELECT alert_id, tenant, t, eid AS event_key, n, hits FROM al")
def alerts_collapsed(spark, sf):
    hits = detect.run_rules(security_events(spark, sf), PICKED, mode="event")
    return detect.collapse(hits).select("alert_id", "tenant", "t", "event_key", "n", "hits")


def _evidence_sql() -> str:
    parts = []
    for i, r in enumerate(PICKED):
        if r.stateful:
            ident = "val" if r.distinct else "eid"
            parts.append(f"SELECT al.alert_id, m.{ident} AS ident, max(m.t) AS t FROM al JOIN m{i} m ON al.rule_id = '{r.id}'"
                         f" AND m.tenant = al.tenant AND m.grp = al.grp AND m.t BETWEEN al.t - {r.window_s * 1000} AND al.t GROUP BY 1, 2")
    return (f"ev1 AS ({' UNION ALL '.join(parts)}), ev2 AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY t, ident) AS rn FROM ev1),"
            " cited AS (SELECT alert_id, list(ident ORDER BY rn) FILTER (WHERE rn <= 4) AS event_ids,"
            " greatest(count(*) - 4, 0) AS event_ids_omitted FROM ev2 GROUP BY 1)")


@query("window_evidence", f"WITH {hits_sql()}, {_covered_sql()}, {ALERTS_SQL}, {_evidence_sql()} SELECT * FROM cited")
def window_evidence(spark, sf):
    hits, fed = detect.detected(security_events(spark, sf), PICKED, mode="event")
    return detect.evidence(detect.collapse(hits), fed, cap=4)


@query("make_alerts", f"""WITH {hits_sql()}, {_covered_sql()}, {SCORE_SQL}, {ALERTS_SQL}
SELECT alert_id, al.t AS time, al.rule_id, al.tenant AS tenant_id, score, ev.sector, ev.src_ip, ev.user_name, al.eid AS trigger_event_id
FROM al JOIN scored USING (eid) JOIN ev ON ev.ingest_id = al.eid""")
def make_alerts(spark, sf):
    alerts = detect.make_alerts(security_events(spark, sf), PICKED, points=_points(spark, sf), mode="event")
    return alerts.select("alert_id", "time", "rule_id", "tenant_id", "score", "sector",
                         F.col("src_endpoint.ip").alias("src_ip"), F.col("actor.user.name").alias("user_name"),
                         "trigger_event_id")


def tenant_switches(spark, sf):
    """Tenant switches by rule position: every third rule is off for t1, opt-in rules are on for t2."""
    tenants = base_events(spark, sf).select((F.col("u") % 3).alias("x")).distinct()
    ordered = rule_table(spark).withColumn("pos", F.row_number().over(Window.orderBy("rule_id")))
    state = (F.when((F.col("x") == 1) & (F.col("pos") % 3 == 0), "disabled")
             .when((F.col("x") == 2) & ~F.col("default_enabled"), "enabled"))
    return (tenants.crossJoin(ordered).select(F.concat(F.lit("t"), "x").alias("tenant"), "rule_id", state.alias("state"))
            .where("state is not null"))


GATED = tuple(r for r in RULES if not r.stateful)
GATE_SQL = """pos AS (SELECT rule_id, row_number() OVER (ORDER BY rule_id) AS pos FROM rl),
sw AS (SELECT 't1' AS tenant, rule_id FROM pos WHERE pos % 3 = 0)"""


@query("tenant_gating", f"""WITH {EV_SQL}, {RULES_SQL}, {GATE_SQL}, h AS ({' UNION ALL '.join(
    f"SELECT tenant, ingest_id AS event_key, '{r.id}' AS rule_id, {str(r.default_enabled).lower()} AS dflt FROM ev WHERE {FILTERS[r.name]}"
    for r in GATED)})
SELECT tenant, event_key, rule_id FROM h WHERE (tenant, rule_id) NOT IN (SELECT tenant, rule_id FROM sw) AND (dflt OR tenant = 't2')""")
def tenant_gating(spark, sf):
    matched = detect.matches(security_events(spark, sf), GATED, "event")
    return detect.gate(matched, tenant_switches(spark, sf), GATED).select("tenant", "event_key", "rule_id")


@query("rule_boolean_not_missing", f"""WITH {EV_SQL} SELECT event_id FROM ev
WHERE NOT coalesce(conn_state = 'SF', false) AND NOT coalesce(ot_pdu = 'RESP' AND ot_function > 3, false)
AND coalesce(dst_port <> 7, false)""")
def rule_boolean_not_missing(spark, sf):
    from secflow.catalog.fixture import flat_events
    from secflow.functions.predicates import all_of, cmp, eq
    keep = all_of(~eq("conn_state", "SF"), ~all_of(eq("ot_pdu", "RESP"), cmp("ot_function", "gt", 3)), cmp("dst_port", "ne", 7))
    return flat_events(spark, sf).where(keep).select("event_id")


@query("after_hours_privileged", f"""WITH {BASE_SQL}, l AS (SELECT event_id, etype, t // 60000 + 60 AS m FROM base)
SELECT event_id FROM l WHERE etype = 'purchase' AND NOT ((m // 1440 + 3) % 7 IN (0, 1, 2, 3, 4)
AND (m % 1440 >= 1320 OR m % 1440 < 360))""")
def after_hours_privileged(spark, sf):
    from secflow.functions.predicates import outside_hours
    return (base_events(spark, sf).where("etype = 'purchase'")
            .where(outside_hours("t", "22:00", "06:00", tz_offset_minutes=60)).select("event_id"))


TITLES_SQL = "tt AS (SELECT * FROM (VALUES " + ", ".join(f"('{r.id}', '{r.title.replace(chr(39), chr(39) * 2)}')" for r in RULES) + ") AS x(rule_id, title))"


@query("review_queue", f"""WITH RECURSIVE {hits_sql()}, {_covered_sql()}, {SCORE_SQL.replace(POINTS_SQL, 'pts AS (SELECT NULL AS eid, 0 AS p WHERE FALSE)')}, {WIDTHS_SQL}, {TITLES_SQL},
tier AS (SELECT tenant, eid, CASE WHEN routing_score >= 60 THEN 'deep' ELSE 'light' END AS tier FROM scored WHERE routing_score >= 20),
keyed AS (SELECT {ALERT_ID_SQL} AS alert_id, kept.*, tier FROM kept JOIN wd USING (rule_id) JOIN tier USING (tenant, eid)),
firsts AS MATERIALIZED (SELECT alert_id, t, min((tenant, eid)) AS x FROM keyed GROUP BY 1, 2),
nx AS MATERIALIZED (SELECT a.alert_id, a.t, min(b.t) AS nt FROM firsts a JOIN firsts b ON a.alert_id = b.alert_id AND b.t >= a.t + {6 * HOUR} GROUP BY 1, 2),
walk AS (SELECT alert_id, min(t) AS t FROM firsts GROUP BY 1 UNION ALL SELECT w.alert_id, nx.nt AS t FROM walk w JOIN nx ON nx.alert_id = w.alert_id AND nx.t = w.t),
asked AS (SELECT DISTINCT x FROM walk JOIN firsts USING (alert_id, t))
SELECT tenant, eid AS event_key, tier, list_sort(list(DISTINCT title)) AS reasons FROM keyed JOIN asked ON x = (tenant, eid) JOIN tt USING (rule_id) GROUP BY 1, 2, 3""")
def review_queue(spark, sf):
    hits = detect.run_rules(security_events(spark, sf), PICKED, mode="event")
    return detect.review_queue(hits, PICKED, 6 * HOUR)


@query("top_alerts", f"""WITH {BASE_SQL}, e AS (SELECT * FROM base WHERE etype = 'error'),
w AS (SELECT u, t, event_id, count(*) OVER (PARTITION BY u ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS n FROM e)
SELECT concat('errors:default:', length(CAST(u AS VARCHAR)), ':', u, ':', t // {DAY}) AS alert_id, CAST(u AS VARCHAR) AS account,
max(t) AS last_t, max(n) AS peak_n, count(*) AS hits, CAST(least(100, 10 * max(n) + 40) AS INT) AS score
FROM w WHERE n >= 3 GROUP BY 1, 2""")
def top_alerts(spark, sf):
    """Accounts with three or more errors within 24 h: one scored alert per account and day bucket."""
    errors = base_events(spark, sf).where("etype = 'error'")
    level = sliding.sliding_count(errors, ["u"], DAY).where("n >= 3")
    per_ms = errors.groupBy("u", "t").agg(F.count(F.lit(1)).alias("c"))
    account = F.col("u").cast("string")
    key = S.alert_key(F.lit("errors"), F.lit("default"), account, F.col("t"), DAY)
    return (level.join(per_ms, ["u", "t"]).groupBy(key.alias("alert_id"), account.alias("account"))
            .agg(F.max("t").alias("last_t"), F.max("n").alias("peak_n"), F.sum("c").alias("hits"))
            .withColumn("score", F.least(F.lit(100), F.col("peak_n") * 10 + 40).cast("int")))


@query("causal_keys", f"""WITH {EV_SQL}, h AS (SELECT ingest_id, tenant, mcp_session, lower(hex(u * 7919 + k)) AS lid, src_host FROM ev),
kk AS (SELECT ingest_id, [x.h for x in [
  {{'h': substr(sha256('["' || tenant || '","logon","","' || src_host || '","' || lid || '"]'), 1, 16)}},
  CASE WHEN mcp_session IS NOT NULL THEN {{'h': substr(sha256('["' || tenant || '","agent","","' || src_host || '","' || mcp_session || '"]'), 1, 16)}} END
] if x IS NOT NULL] AS hs FROM (SELECT * REPLACE (ltrim(lid, '0') AS lid) FROM h))
SELECT ingest_id AS event_key, hs AS hashes FROM kk""")
def causal_keys(spark, sf):
    ev = security_events(spark, sf)
    host = F.col("src_endpoint.hostname")
    number = F.regexp_extract("siem.ingest_id", r"(\d+)", 1).cast("bigint")
    base = base_events(spark, sf).select(F.col("event_id").alias("_e"), (F.col("u") * 7919 + F.col("k")).alias("_n"))
    scoped = (ev.withColumn("_e", number).join(base, "_e")
              .withColumn("siem", F.col("siem").withField("key_scope", F.struct(host.alias("host"), F.lit(None).cast("string").alias("sensor"), F.lit(None).cast("string").alias("boot"))))
              .withColumn("actor", F.col("actor").withField("session", F.struct(F.concat(F.lit("0x00"), F.hex("_n")).alias("uid")))))
    return detect.causal_keys(scoped).select("event_key", F.transform("causal_keys", lambda x: x.h).alias("hashes"))


# ---- the whole job: all rules, shipped limits, the default clock ---------------------------------

NOW_MS = 1_706_500_000_000


def shipped_sql() -> str:
    """CTEs ending in hits of all rules as shipped, at NOW_MS: times over five minutes ahead are in no window, smaller leads count as now (but for the regularity of gaps)."""
    text = hits_sql(RULES)
    for i, r in enumerate(RULES):
        if r.stateful:
            t = "t" if r.measure == "cv" else f"least(t, {NOW_MS}) AS t"
            text = text.replace(members_sql(r, f"m{i}"), members_sql(r, f"m{i}").replace(" AS grp, t, ", f" AS grp, {t}, ").replace("FROM ev WHERE ", f"FROM ev WHERE t <= {NOW_MS + 300_000} AND "))
            if r.max_cv is not None:
                text = text.replace(f"FROM lv{i} WHERE n >= {r.threshold}", f"FROM lv{i} WHERE n >= {r.threshold} AND n >= 3 AND cv <= {r.max_cv}")
    return text


@query("run_rules_all", f"""WITH {shipped_sql()}, {_covered_sql(RULES)}, wa AS (SELECT * FROM (VALUES {', '.join(f"('{r.id}', CAST({r.window_s * 1000} AS BIGINT))" for r in RULES)}) AS x(rule_id, window_ms))
SELECT tenant, eid AS event_key, rule_id, window_ms, grp, t, n FROM kept JOIN wa USING (rule_id)""")
def run_rules_all(spark, sf):
    """All rules as shipped over all events."""
    return detect.run_rules(security_events(spark, sf), RULES, now_ms=NOW_MS)


@query("make_alerts_all")
def make_alerts_all(spark, sf):
    return detect.make_alerts(security_events(spark, sf), RULES, now_ms=NOW_MS)
