"""Search, dashboards, evidence, privacy, evaluation and sinks over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from secflow.catalog.fixture import BASE_SQL, EV_SQL, base_events, flat_events, table
from secflow.catalog.registry import query
from secflow.functions import predicates as P
from secflow.functions import scalars as S
from secflow.operators import sets
from secflow.plans import evaluate as M
from secflow.plans import search as Q
from secflow.plans.rules import RULES, rule_table
from secflow.sources import sinks

DAY = 86_400_000
AL = {"alert_id": "concat('al', event_id)", "tenant_id": "concat('t', u % 3)", "time": "t", "rule_id": "concat('r', k % 12)", "source": "source_type", "sender": "src_host",
      "level": "CASE k % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END", "status": "CASE u % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'new' WHEN 2 THEN 'in_progress' END",
      "actor": "concat('user', u)", "ip": "src_ip", "tactic": "CASE WHEN k % 10 < 5 THEN 'TA0001' WHEN k % 10 < 8 THEN 'TA0011' WHEN k % 10 = 8 THEN 'TA0040' END", "note": "CASE WHEN u % 5 = 0 THEN 'seen' END"}
AL_SQL = EV_SQL + ", al AS (SELECT event_id, u, k, " + ", ".join(f"{v} AS {n}" for n, v in AL.items()) + " FROM ev)"
RANK = "CASE level WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END"


def alerts(spark, sf):
    return flat_events(spark, sf).selectExpr("event_id", "u", "k", *[f"{v} AS {n}" for n, v in AL.items()])


@query("list_alerts", f"WITH {AL_SQL} SELECT alert_id, time FROM al WHERE tenant_id = 't1' AND coalesce(status, 'new') = 'new' ORDER BY time DESC, alert_id LIMIT 50")
def list_alerts(spark, sf):
    return Q.list_alerts(alerts(spark, sf), 50, "t1", status="new").select("alert_id", "time")


@query("console_feed", f"WITH {AL_SQL} SELECT alert_id, time FROM al WHERE tenant_id = 't2' AND time >= 1705000000000 ORDER BY time DESC, alert_id LIMIT 100")
def console_feed(spark, sf):
    return Q.feed(alerts(spark, sf), 1_705_000_000_000, "t2", 100).select("alert_id", "time")


@query("active_alarms", f"WITH {AL_SQL} SELECT alert_id, {RANK} AS rank FROM al WHERE coalesce(status, 'new') <> 'resolved'")
def active_alarms(spark, sf):
    return Q.active_alarms(alerts(spark, sf)).select("alert_id", "rank")


@query("search_events", f"WITH {AL_SQL} SELECT alert_id FROM al WHERE contains(lower(source), 'suri') AND contains(lower(concat_ws(' ', actor, ip, sender, rule_id)), '10.1') AND contains(lower(concat_ws(' ', actor, ip, sender, rule_id)), 'host')")
def search_events(spark, sf):
    return Q.search(alerts(spark, sf), {"source": "SURI"}, ["10.1", "HOST"], ["actor", "ip", "sender", "rule_id"]).select("alert_id")


@query("facets", f"WITH {AL_SQL} SELECT 'source' AS facet, source AS value, count(*) AS n FROM al GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM al GROUP BY 2 UNION ALL SELECT 'level', level, count(*) FROM al GROUP BY 2")
def facets(spark, sf):
    return sets.facets(alerts(spark, sf), ["source", "status", "level"])


@query("event_histogram", f"""WITH {AL_SQL}, b AS (SELECT least(19, CAST(floor((time - 1704067200000) / (20.0 * {DAY} / 20)) AS INT)) AS bin FROM al WHERE time >= 1704067200000 AND time < {1704067200000 + 20 * DAY})
SELECT CAST(g AS INT) AS bin, count(b.bin) AS n FROM range(20) r(g) LEFT JOIN b ON b.bin = g GROUP BY 1""")
def event_histogram(spark, sf):
    return sets.histogram(alerts(spark, sf), "time", 1_704_067_200_000, 1_704_067_200_000 + 20 * DAY, 20)


@query("top_sources", f"WITH {AL_SQL} SELECT ip, count(*) AS n FROM al WHERE ip IS NOT NULL GROUP BY 1 ORDER BY n DESC, ip LIMIT 10")
def top_sources(spark, sf):
    return sets.top_n(alerts(spark, sf).where("ip is not null"), "ip", 10)


@query("newest_per_key", f"WITH {AL_SQL} SELECT actor, alert_id FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY time DESC, alert_id) AS rn FROM al) WHERE rn <= 5")
def newest_per_key(spark, sf):
    return sets.cap_per_key(alerts(spark, sf), ["actor"], [F.desc("time"), F.asc("alert_id")], 5).select("actor", "alert_id")


@query("overview_tactic_heat", f"WITH {AL_SQL}, c AS (SELECT tactic, count(*) AS n FROM al WHERE tactic IS NOT NULL GROUP BY 1) SELECT tactic, n, CASE WHEN n / (SELECT max(n) FROM c) > 0.66 THEN 'h3' WHEN n / (SELECT max(n) FROM c) > 0.33 THEN 'h2' ELSE 'h1' END AS heat FROM c")
def overview_tactic_heat(spark, sf):
    return Q.tactic_heat(alerts(spark, sf))


RL_SQL = "rl AS (SELECT * FROM (VALUES " + ", ".join(f"('r{i}', {repr(r.technique) if r.technique else 'NULL'})" for i, r in enumerate(RULES)) + ") x(rule_id, technique))"


def numbered_rules(spark):
    order = {r.id: f"r{i}" for i, r in enumerate(RULES)}
    names = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return rule_table(spark).withColumn("rule_id", names[F.col("rule_id")])


@query("coverage", f"WITH {AL_SQL}, {RL_SQL}, f AS (SELECT DISTINCT rule_id AS h FROM al) SELECT coalesce(technique, 'undeclared') AS technique, count(*) AS rules, count(h) AS fired FROM rl LEFT JOIN f ON rule_id = h GROUP BY 1")
def coverage(spark, sf):
    return Q.coverage(numbered_rules(spark), alerts(spark, sf))


@query("rule_health", f"WITH {AL_SQL}, {RL_SQL} SELECT rl.rule_id, max(time) AS last_fired, nullif(count(time), 0) AS n FROM rl LEFT JOIN al USING (rule_id) GROUP BY 1")
def rule_health(spark, sf):
    return M.rule_health(alerts(spark, sf), numbered_rules(spark))


@query("source_health", f"""WITH {AL_SQL}, s AS (SELECT source, sender, count(*) AS c FROM al GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, sender) AS rn FROM s),
t AS (SELECT source, list(sender ORDER BY rn) AS top_senders FROM r WHERE rn <= 3 GROUP BY 1)
SELECT source, count(*) AS n, max(time) AS last_seen, max(time) < 1706659000000 - 900000 AS silent, any_value(top_senders) AS top_senders FROM al JOIN t USING (source) GROUP BY 1""")
def source_health(spark, sf):
    return Q.source_health(alerts(spark, sf), 1_706_659_000_000)


@query("rule_catalogue", f"""WITH {BASE_SQL}, t AS (SELECT DISTINCT concat('t', u % 3) AS tenant FROM base), r AS (SELECT * FROM (VALUES {", ".join(f"('{r.id}', {repr(next((x.id for x in RULES if x.name == r.companion_of), None)) if r.companion_of else 'NULL'}, {str(r.default_enabled).lower()})" for r in RULES)}) x(rule_id, comp, dflt)),
p AS (SELECT *, row_number() OVER (ORDER BY rule_id) AS pos FROM r), off AS (SELECT rule_id FROM p WHERE pos % 3 = 0)
SELECT tenant, rule_id, CASE WHEN tenant = 't1' AND (rule_id IN (SELECT rule_id FROM off) OR comp IN (SELECT rule_id FROM off)) THEN false ELSE dflt OR tenant = 't2' END AS enabled FROM t CROSS JOIN p""")
def rule_catalogue(spark, sf):
    from secflow.catalog.detect_queries import tenant_switches
    tenants = base_events(spark, sf).select(F.concat(F.lit("t"), F.col("u") % 3).alias("tenant")).distinct()
    return Q.rule_catalogue(rule_table(spark), tenant_switches(spark, sf), tenants)


FIELDS = {"ip": "src_ip", "user": "user_name", "port": "dst_port", "country": "country", "domain": "parent_domain"}


@query("field_coverage", f"WITH {EV_SQL} " + " UNION ALL ".join(f"SELECT source_type, '{n}' AS field, count({c}) AS filled FROM ev GROUP BY 1" for n, c in FIELDS.items()))
def field_coverage(spark, sf):
    return Q.field_coverage(flat_events(spark, sf), FIELDS, "source_type")


@query("latest_report", "SELECT o_custkey AS alert_id, max(o_orderkey) AS generated_at, arg_max(o_orderpriority, o_orderkey) AS body FROM orders GROUP BY 1")
def latest_report(spark, sf):
    return Q.latest_report(table(spark, sf, "orders").select(F.col("o_custkey").alias("alert_id"), F.col("o_orderkey").alias("generated_at"), F.col("o_orderpriority").alias("body")))


@query("provenance", """WITH c AS (SELECT DISTINCT l_orderkey AS alert_id, l_partkey AS h FROM lineitem), e AS (SELECT DISTINCT p_partkey AS h FROM part WHERE p_partkey % 3 <> 0)
SELECT alert_id, count(e.h) AS resolved, count(*) - count(e.h) AS missing FROM c LEFT JOIN e USING (h) GROUP BY 1""")
def provenance(spark, sf):
    cited = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("alert_id"), F.array("l_partkey").alias("event_ids"))
    events = table(spark, sf, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("event_id"), F.lit(None).cast("bigint").alias("ingest_id"))
    return Q.provenance(cited, events)


def blocks(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("package_id"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("pos"),
                                               F.concat_ws("|", "l_partkey", "l_suppkey", "l_returnflag").alias("body"))


@query("evidence_chain")
def evidence_chain(spark, sf):
    return Q.evidence_chain(blocks(spark, sf)).select("package_id", F.size("chain").alias("n"), "digest")


@query("verify_chain", "SELECT DISTINCT l_orderkey AS package_id, ['chain', 'digest'] AS failures FROM lineitem WHERE l_orderkey % 50 = 0")
def verify_chain(spark, sf):
    stored = Q.evidence_chain(blocks(spark, sf))
    forged = blocks(spark, sf).withColumn("body", F.when(F.col("package_id") % 50 == 0, F.concat("body", F.lit("x"))).otherwise(F.col("body")))
    return Q.verify_chain(stored, forged)


@query("pseudonymise_scan", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in Q.PRIVATE_PATTERNS.items()) + " FROM documents")
def pseudonymise_scan(spark, sf):
    return Q.find_private(table(spark, sf, "documents"), "text", "doc_id")


@query("pseudonymise_rescan", "SELECT count(*) AS docs, CAST(0 AS BIGINT) AS left_over FROM documents")
def pseudonymise_rescan(spark, sf):
    """No address, mail or hardware address is left in any text after masking."""
    masked = Q.pseudonymise(table(spark, sf, "documents").select("doc_id", "text"), "key", {}, ["text"])
    counts = Q.find_private(masked, "text", "doc_id")
    return counts.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("email") + F.col("ipv4") + F.col("mac") + F.col("sid")).cast("bigint").alias("left_over"))


# ---- evaluation --------------------------------------------------------------------------------



@query("rule_confusion", """WITH e AS (SELECT doc_id AS case_id, doc_id % 5 AS rule_id FROM labels WHERE quality = 1), f AS (SELECT doc_id AS case_id, doc_id % 5 AS rule_id FROM documents WHERE n_chars > 500),
j AS (SELECT coalesce(e.rule_id, f.rule_id) AS rule_id, e.case_id AS e, f.case_id AS f FROM e FULL OUTER JOIN f ON e.case_id = f.case_id AND e.rule_id = f.rule_id),
c AS (SELECT rule_id, count(*) FILTER (WHERE e IS NOT NULL AND f IS NOT NULL) AS tp, count(*) FILTER (WHERE e IS NULL) AS fp, count(*) FILTER (WHERE f IS NULL) AS fn FROM j GROUP BY 1)
SELECT rule_id, tp, fp, fn, coalesce(round(tp / nullif(tp + fp, 0), 6), 0.0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 6), 0.0) AS recall, coalesce(round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6), 0.0) AS f1 FROM c""")
def rule_confusion(spark, sf):
    pairs = lambda df: df.select(F.col("doc_id").alias("case_id"), (F.col("doc_id") % 5).alias("rule_id"))
    return M.rule_metrics(pairs(table(spark, sf, "labels").where("quality = 1")), pairs(table(spark, sf, "documents").where("n_chars > 500")))


WILSON = "(tp / n + 3.8416 / (2 * n) {s} 1.96 * sqrt((tp / n) * (1 - tp / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)"


@query("label_precision", f"""WITH v AS (SELECT doc_id % 25 AS rule_id, CASE WHEN toxic = 1 THEN 'unknown' WHEN quality = 1 THEN 'tp' ELSE 'fp' END AS v FROM labels JOIN documents USING (doc_id)),
c AS (SELECT rule_id, count(*) FILTER (WHERE v = 'tp') AS tp, count(*) FILTER (WHERE v = 'fp') AS fp, count(*) FILTER (WHERE v = 'unknown') AS unknown FROM v GROUP BY 1),
d AS (SELECT *, CAST(nullif(tp + fp, 0) AS DOUBLE) AS n FROM c)
SELECT rule_id, tp, fp, unknown, round(tp / n, 6) AS precision, CASE WHEN n IS NOT NULL THEN round(greatest({WILSON.format(s='-')}, 0), 4) END AS low, CASE WHEN n IS NOT NULL THEN round(least({WILSON.format(s='+')}, 1), 4) END AS high, tp + fp < 10 AS low_n FROM d""")
def label_precision(spark, sf):
    verdict = F.when(F.col("toxic") == 1, "unknown").when(F.col("quality") == 1, "tp").otherwise("fp")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("alert_id"), verdict.alias("verdict"), F.col("doc_id").alias("pos"))
    return M.label_precision(labels, table(spark, sf, "documents").select(F.col("doc_id").alias("alert_id"), (F.col("doc_id") % 25).alias("rule_id")))


@query("orphan_labels", "SELECT count(*) AS orphans FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)")
def orphan_labels(spark, sf):
    keep = table(spark, sf, "documents").where("doc_id % 4 <> 0").select(F.col("doc_id").alias("alert_id"))
    return M.orphan_labels(table(spark, sf, "labels").select(F.col("doc_id").alias("alert_id")), keep)


@query("alert_volume_report", f"WITH {AL_SQL} SELECT rule_id, strftime(make_timestamp(time * 1000), '%Y-%m-%d') AS day, count(*) AS n FROM al GROUP BY 1, 2")
def alert_volume_report(spark, sf):
    rows = alerts(spark, sf)
    return M.alert_volume(rows.unionByName(rows.where("k % 5 = 0")))


@query("latency_summary", f"WITH {BASE_SQL} SELECT etype, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM base GROUP BY 1")
def latency_summary(spark, sf):
    return M.latency_summary(base_events(spark, sf), "etype", "value")


@query("label_ceiling", f"WITH {AL_SQL}, p AS (SELECT rule_id, source, level, count(*) AS n FROM al GROUP BY 1, 2, 3), t AS (SELECT max(n) AS b, sum(n) AS a FROM p GROUP BY rule_id, source) SELECT CAST(sum(b) AS BIGINT) AS best, CAST(sum(a) AS BIGINT) AS n, round(sum(b) / sum(a), 6) AS ceiling FROM t")
def label_ceiling(spark, sf):
    return M.label_ceiling(alerts(spark, sf).select("rule_id", "source", F.col("level").alias("label")))


@query("normalisation_coverage", f"WITH {EV_SQL} SELECT source_type AS source, count(*) AS n, count(*) FILTER (WHERE k % 7 <> 0) AS parsed, round(count(*) FILTER (WHERE k % 7 <> 0) / count(*), 6) AS share FROM ev GROUP BY 1")
def normalisation_coverage(spark, sf):
    rows = flat_events(spark, sf).select(F.col("source_type").alias("source"), F.col("event_id").alias("record_id"), "k")
    return M.normalisation_coverage(rows, rows.where("k % 7 <> 0"))


@query("funnel_buckets", """WITH c AS (SELECT CASE WHEN p_size < 5 THEN 'NOT_FETCHED' WHEN p_size < 8 THEN 'READER_UNAVAILABLE' WHEN p_size % 5 = 0 THEN 'UNLABELLED' WHEN p_partkey % 3 = 0 THEN 'NO_PARSER' WHEN p_partkey % 4 = 0 THEN 'NO_RULE'
WHEN p_partkey % 7 < 2 THEN 'HIT_EXACT' WHEN p_partkey % 7 < 4 THEN 'HIT_FAMILY' ELSE 'MISS' END AS bucket FROM part) SELECT bucket, count(*) AS n FROM c GROUP BY 1""")
def funnel_buckets(spark, sf):
    p = table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    return M.funnel(p.select((size >= 5).alias("fetched"), (size >= 8).alias("readable"), F.when(size % 5 != 0, "T1").alias("label"), (key % 3 != 0).alias("parsed"), (key % 4 != 0).alias("has_rule"),
                             F.when(key % 7 < 2, "exact").when(key % 7 < 4, "family").otherwise("none").alias("level")))


@query("technique_levels", "SELECT DISTINCT concat('T', 1000 + p_size) || CASE WHEN p_partkey % 2 = 0 THEN '.001' ELSE '' END AS technique, CASE WHEN p_size % 3 <> 0 THEN 'none' WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'family' END AS level FROM part")
def technique_levels(spark, sf):
    label = F.concat(F.lit("T"), 1000 + F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, ".001").otherwise(""))
    rules = table(spark, sf, "part").where("p_size % 3 = 0").select(F.concat(F.lit("T"), 1000 + F.col("p_size"), F.lit(".001")).alias("technique"))
    return M.technique_level(table(spark, sf, "part").select(label.alias("technique")), rules)


@query("chain_metrics", f"""WITH {BASE_SQL}, st AS (SELECT u % 10 AS storyline, event_id AS step_id, t AS time FROM base WHERE etype = 'error'), a AS (SELECT event_id AS step_id, t + 60000 AS time FROM base WHERE k % 2 = 0)
SELECT storyline, count(*) AS steps, count(a.time) AS detected, round(count(a.time) / count(*), 6) AS tpr, min(a.time) - min(st.time) AS time_to_detect FROM st LEFT JOIN a USING (step_id) GROUP BY 1""")
def chain_metrics(spark, sf):
    b = base_events(spark, sf)
    steps = b.where("etype = 'error'").select((F.col("u") % 10).alias("storyline"), F.col("event_id").alias("step_id"), F.col("t").alias("time"))
    return M.chain_metrics(steps, b.where("k % 2 = 0").select(F.col("event_id").alias("step_id"), (F.col("t") + 60000).alias("time")))


@query("correlation_metrics", f"""WITH {BASE_SQL}, s AS (SELECT k AS incident_id, count(DISTINCT u % 4) AS c FROM base WHERE value > 100 GROUP BY 1)
SELECT (SELECT count(*) FROM base) AS alerts, count(*) AS incidents, round(1 - count(*) / (SELECT count(*) FROM base), 6) AS reduction, round(count(*) FILTER (WHERE c > 1) / count(*), 6) AS false_rate FROM s""")
def correlation_metrics(spark, sf):
    b = base_events(spark, sf)
    return M.correlation_metrics(b.select(F.col("event_id").alias("alert_id"), (F.col("u") % 4).alias("storyline")), b.where("value > 100").select(F.col("k").alias("incident_id"), F.col("event_id").alias("alert_id")))


REL = "SELECT DISTINCT o_custkey % 5 AS storyline, o_custkey AS from_step, o_custkey + 1 AS to_step, o_custkey % 3 <> 0 AS allowed FROM orders"


@query("chain_fidelity", f"""WITH r AS ({REL}), e AS (SELECT DISTINCT c_custkey AS from_step, c_custkey + 1 + c_nationkey % 2 AS to_step FROM customer),
j AS (SELECT r.*, e.from_step IS NOT NULL AS hit FROM r LEFT JOIN e USING (from_step, to_step)), c AS (SELECT storyline, count(*) FILTER (WHERE allowed) AS wanted, count(*) FILTER (WHERE allowed AND hit) AS found, count(*) FILTER (WHERE NOT allowed AND hit) AS forbidden_found FROM j GROUP BY 1)
SELECT *, round(found / (wanted + forbidden_found), 6) AS fidelity FROM c""")
def chain_fidelity(spark, sf):
    rel = table(spark, sf, "orders").selectExpr("o_custkey % 5 AS storyline", "o_custkey AS from_step", "o_custkey + 1 AS to_step", "o_custkey % 3 <> 0 AS allowed").distinct()
    return M.chain_fidelity(table(spark, sf, "customer").selectExpr("c_custkey AS from_step", "c_custkey + 1 + c_nationkey % 2 AS to_step"), rel)


@query("timed_order", """WITH c AS (SELECT count(*) FILTER (WHERE l_partkey + 50 < l_suppkey * 20) AS forward, count(*) FILTER (WHERE NOT (l_partkey + 50 < l_suppkey * 20) AND NOT (l_suppkey * 20 + 50 < l_partkey)) AS concurrent,
count(*) FILTER (WHERE l_suppkey * 20 + 50 < l_partkey) AS reverse FROM lineitem), d AS (SELECT *, forward AS tp, CAST(forward + concurrent + reverse AS DOUBLE) AS n FROM c)
SELECT forward, concurrent, reverse, CAST(0 AS BIGINT) AS untimed, round(""" + WILSON.format(s="-") + ", 4) AS low, round(" + WILSON.format(s="+") + ", 4) AS high, false AS low_n FROM d")
def timed_order(spark, sf):
    return M.timed_order(table(spark, sf, "lineitem").selectExpr("l_partkey AS a_lo", "l_partkey + 50 AS a_hi", "l_suppkey * 20 AS b_lo", "l_suppkey * 20 + 50 AS b_hi"))


@query("link_metrics", """WITH e AS (SELECT DISTINCT 'k' || o_custkey % 3 AS basis, o_custkey AS a, o_custkey + 1 AS b FROM orders), t AS (SELECT DISTINCT 'k' || c_custkey % 3 AS basis, c_custkey + 1000000 * CAST(c_nationkey > 5 AS INT) AS a, c_custkey + 1000000 * CAST(c_nationkey > 5 AS INT) + 1 AS b FROM customer),
j AS (SELECT coalesce(e.basis, t.basis) AS basis, e.a AS ea, t.a AS ta FROM e FULL OUTER JOIN t ON e.basis = t.basis AND e.a = t.a), c AS (SELECT basis, count(*) FILTER (WHERE ea IS NOT NULL AND ta IS NOT NULL) AS tp, count(ea) AS en, count(ta) AS tn FROM j GROUP BY 1)
SELECT basis, tp, tp AS directed, round(tp / nullif(en, 0), 6) AS precision, round(tp / nullif(tn, 0), 6) AS recall FROM c""")
def link_metrics(spark, sf):
    e = table(spark, sf, "orders").selectExpr("concat('k', o_custkey % 3) AS basis", "o_custkey AS a", "o_custkey + 1 AS b")
    return M.link_metrics(e, table(spark, sf, "customer").selectExpr("concat('k', c_custkey % 3) AS basis", "c_custkey + 1000000 * cast(c_nationkey > 5 as int) AS a", "c_custkey + 1000000 * cast(c_nationkey > 5 as int) + 1 AS b"))


@query("attribution", f"WITH {BASE_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE k % 9 <> 0) AS \"right\", round(count(*) FILTER (WHERE k % 9 <> 0) / count(*), 6) AS accuracy FROM base WHERE u % 4 <> 0")
def attribution(spark, sf):
    b = base_events(spark, sf)
    raw = b.select(F.col("event_id").alias("record_id"), F.when(F.col("u") % 4 != 0, F.concat(F.lit("u"), "u")).alias("actor"))
    return M.attribution(b.select(F.col("event_id").alias("record_id"), F.when(F.col("k") % 9 != 0, F.concat(F.lit("u"), "u")).otherwise("x").alias("actor")), raw)


HOST_SQL = "h AS (SELECT page_id * 1000 AS t, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS name, page_id % 7 AS client FROM pages), p AS (SELECT *, array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') AS parent FROM h)"


@query("dns_cardinality", f"""WITH {HOST_SQL}, w AS (SELECT a.parent, a.t, count(DISTINCT b.name) AS n FROM (SELECT DISTINCT parent, t FROM p) a JOIN p b ON a.parent = b.parent AND b.t BETWEEN a.t - 60000 AND a.t GROUP BY 1, 2),
k AS (SELECT parent, max(n) AS peak, arg_min(t, (-n, t)) AS peak_t FROM w GROUP BY 1)
SELECT parent, count(*) AS queries, count(DISTINCT name) AS names, count(DISTINCT client) AS clients, any_value(peak) AS peak, any_value(peak_t) AS peak_t, any_value(peak) >= 10 AND parent <> 'example.org' AS alerts FROM p JOIN k USING (parent) GROUP BY 1""")
def dns_cardinality(spark, sf):
    log = table(spark, sf, "pages").select((F.col("page_id") * 1000).alias("t"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("name"), (F.col("page_id") % 7).alias("client"))
    return M.dns_cardinality(log, 60_000, 10, ("example.org",))


@query("severity_confusion", f"WITH {AL_SQL} SELECT level AS expected, CASE WHEN k % 3 = 0 THEN 'high' ELSE level END AS actual, count(*) AS n FROM al GROUP BY 1, 2")
def severity_confusion(spark, sf):
    return M.severity_confusion(alerts(spark, sf).select(F.col("level").alias("expected"), F.when(F.col("k") % 3 == 0, "high").otherwise(F.col("level")).alias("actual")))


@query("metric_regressions", f"""WITH {BASE_SQL}, b AS (SELECT k, count(*) AS v FROM base WHERE t < 1705000000000 GROUP BY 1), c AS (SELECT k, count(*) AS v FROM base WHERE t >= 1705000000000 GROUP BY 1)
SELECT coalesce(b.k, c.k) AS metric, CASE WHEN b.k IS NULL THEN 'new' WHEN c.k IS NULL THEN 'missing' WHEN (b.k % 3 = 0 AND c.v < b.v) OR (b.k % 3 = 1 AND c.v > b.v) OR (b.k % 3 = 2 AND c.v <> b.v) THEN 'regressed' WHEN c.v <> b.v THEN 'improved' ELSE 'same' END AS state FROM b FULL OUTER JOIN c ON b.k = c.k""")
def metric_regressions(spark, sf):
    side = lambda cond: base_events(spark, sf).where(cond).groupBy(F.col("k").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    way = F.when(F.col("metric") % 3 == 0, "higher").when(F.col("metric") % 3 == 1, "lower").otherwise("pinned")
    return M.metric_regressions(side("t < 1705000000000").withColumn("direction", way), side("t >= 1705000000000"))


@query("verdict_metrics", """WITH v AS (SELECT CASE WHEN quality = 1 THEN 'a' ELSE 'b' END AS l, CASE WHEN doc_id % 10 = 0 THEN 'unknown' WHEN toxic = 0 THEN 'a' ELSE 'b' END AS p FROM labels),
c AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE l = p) AS tp, count(*) FILTER (WHERE p = 'unknown') AS ab, greatest(count(*) FILTER (WHERE l = 'a'), count(*) FILTER (WHERE l = 'b')) AS mj FROM v)
SELECT CAST(n AS BIGINT) AS n, tp AS "right", ab AS abstained, round(tp / n, 6) AS accuracy, round(""" + WILSON.format(s="-") + ", 4) AS low, round(" + WILSON.format(s="+") + ", 4) AS high, round(mj / n, 6) AS majority_share FROM c")
def verdict_metrics(spark, sf):
    pred = F.when(F.col("doc_id") % 10 == 0, "unknown").when(F.col("toxic") == 0, "a").otherwise("b")
    return M.verdict_metrics(table(spark, sf, "labels").select(F.when(F.col("quality") == 1, "a").otherwise("b").alias("label"), pred.alias("pred")))


@query("trend_row", "SELECT l_suppkey AS rule_id, CAST(sum(l_linenumber) AS BIGINT) AS tp, CAST(sum(l_partkey) AS BIGINT) AS fp, CAST(sum(l_orderkey) AS BIGINT) AS fn, sum(l_linenumber) + sum(l_orderkey) = 0 AS untested FROM lineitem GROUP BY 1")
def trend_row(spark, sf):
    return M.trend_row(table(spark, sf, "lineitem").selectExpr("l_suppkey AS rule_id", "l_linenumber AS tp", "l_partkey AS fp", "l_orderkey AS fn"))


# ---- labels, text predicates, sinks ------------------------------------------------------------

@query("light_labels", f"WITH {EV_SQL} SELECT event_id, CASE class_uid WHEN 1002 THEN 'process' WHEN 3002 THEN 'authentication' WHEN 3003 THEN 'account_change' WHEN 4001 THEN 'network' WHEN 4002 THEN 'web_dns' WHEN 4009 THEN 'email' WHEN 6003 THEN 'api' ELSE 'datastore' END AS category,"
       " CASE WHEN k >= 60 OR severity_id >= 5 THEN 'high' WHEN k >= 40 OR severity_id = 4 THEN 'medium' ELSE 'low' END AS priority FROM ev")
def light_labels(spark, sf):
    return flat_events(spark, sf).select("event_id", S.light_label(F.col("class_uid"), F.col("severity_id"), F.col("k")).alias("x")).select("event_id", "x.category", "x.priority")


@query("verdict_sets", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'malicious' WHEN 'O' THEN 'benign' ELSE 'unknown' END AS verdict, CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'low' END AS level, o_orderstatus NOT IN ('F', 'O') OR o_orderkey % 2 = 1 AS out_of_set FROM orders")
def verdict_sets(spark, sf):
    verdict = F.when(F.col("o_orderstatus") == "F", " Malicious ").when(F.col("o_orderstatus") == "O", "BENIGN").otherwise("odd")
    level = F.when(F.col("o_orderkey") % 2 == 0, "HIGH").otherwise("severe")
    return table(spark, sf, "orders").select("o_orderkey", S.normalise_verdict(verdict, level, F.lit("x")).alias("x")).select("o_orderkey", "x.verdict", "x.level", "x.out_of_set")


@query("glob_contains_docs", "SELECT page_id, url GLOB 'https://*.example.[cn]*' AS g, contains(url, '/en/') AS c FROM pages")
def glob_contains_docs(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.glob("url", "https://*.example.[cn]*").alias("g"), P.contains("url", "/en/").alias("c"))


TRI = "CASE o_orderkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'resolved' END"


@query("upsert_keep_triage", f"""WITH c AS (SELECT o_orderkey AS alert_id, 1 AS time, {TRI} AS status FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS alert_id, max(x) AS time FROM orders, range(2, 4) r(x) WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT coalesce(c.alert_id, b.alert_id) AS alert_id, coalesce(b.time, c.time) AS time, CASE WHEN b.alert_id IS NULL THEN c.status ELSE coalesce(c.status, 'new') END AS status, CAST(NULL AS VARCHAR) AS note FROM c FULL OUTER JOIN b ON c.alert_id = b.alert_id""")
def upsert_keep_triage(spark, sf):
    o = table(spark, sf, "orders")
    note = F.lit(None).cast("string").alias("note")
    current = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("alert_id"), F.lit(1).cast("bigint").alias("time"), F.expr(TRI).alias("status"), note)
    batch = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("alert_id"), F.explode(F.expr("array(2L, 3L)")).alias("time"), F.lit("new").alias("status"), note)
    return sinks.upsert_alerts(current, batch)


@query("insert_if_absent", "SELECT l_orderkey AS id, min(l_linenumber) AS time FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1")
def insert_if_absent(spark, sf):
    have = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"))
    return sinks.insert_if_absent(have, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("time")), "id")


@query("apply_triage", f"""WITH u AS (SELECT o_custkey AS a, arg_max(CASE o_orderstatus WHEN 'F' THEN 'resolved' ELSE 'in_progress' END, o_orderkey) AS s FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT c_custkey AS alert_id, coalesce(s, 'new') AS status, CAST(NULL AS VARCHAR) AS note FROM customer LEFT JOIN u ON a = c_custkey""")
def apply_triage(spark, sf):
    note = F.lit(None).cast("string").alias("note")
    updates = table(spark, sf, "orders").select(F.col("o_custkey").alias("alert_id"), F.col("o_orderkey").alias("at"),
                                                F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("bogus").alias("status"), note)
    return sinks.apply_triage(table(spark, sf, "customer").select(F.col("c_custkey").alias("alert_id"), F.lit("new").alias("status"), note), updates)


@query("routing", f"WITH {EV_SQL} SELECT event_id, CASE WHEN u % 5 <> 0 AND t % 7 <> 0 THEN CASE WHEN u % 2 = 0 THEN concat('events-', sector) ELSE 'alerts' END END AS family, CASE WHEN t % 7 <> 0 THEN strftime(make_timestamp(t * 1000), '%Y-%m-%d') END AS day FROM ev")
def routing(spark, sf):
    docs = flat_events(spark, sf).select("event_id", "sector", F.when(F.col("t") % 7 != 0, F.col("t")).alias("time"), F.when(F.col("u") % 5 == 0, "Bad Tenant").otherwise("acme").alias("tenant"),
                                         F.when(F.col("u") % 2 == 0, "event").otherwise("alert").alias("kind"))
    return sinks.routed(docs).select("event_id", "family", "day")


@query("retention", f"WITH {EV_SQL} SELECT event_id FROM ev WHERE date_diff('day', CAST(make_timestamp(t * 1000) AS DATE), DATE '2024-04-10') <= CASE sector WHEN 'bank' THEN 400 ELSE 90 END")
def retention(spark, sf):
    docs = flat_events(spark, sf).select("event_id", F.concat(F.lit("events-"), "sector").alias("family"), S.day_of(F.col("t")).alias("day"))
    return sinks.drop_expired(docs, "2024-04-10").select("event_id")


@query("dead_letter_summary", f"WITH {BASE_SQL} SELECT 'normalize' AS stage, 'bad ' || etype AS error, count(*) AS n, min(CAST(event_id AS VARCHAR)) AS example FROM base GROUP BY 2")
def dead_letter_summary(spark, sf):
    dead = base_events(spark, sf).select(F.lit("normalize").alias("stage"), F.array(F.concat(F.lit("bad "), "etype")).alias("errors"), F.col("event_id").cast("string").alias("raw"))
    return sinks.dead_letter_summary(dead)
