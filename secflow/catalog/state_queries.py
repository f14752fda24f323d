"""Accounts folded by realm aliases, and tables that batches change, over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from secflow.catalog.fixture import EV_SQL, base_events, security_events, table
from secflow.catalog.registry import query
from secflow.catalog.rule_queries import FILTERS, stretched
from secflow.plans import detect
from secflow.plans.identity import folded_account, realm_aliases
from secflow.plans.rules import BY_NAME
from secflow.session import checkpoint_dir
from secflow.sources import sinks
from secflow.sources.tables import VersionedTable

DAY = 86_400_000
# Realm groups by nation: a name, a domain, and for every other nation the domain of the nation after next but one, which chains groups of one tenant.
SPELLINGS = ("concat('R', n_nationkey)", "concat('R', n_nationkey, '.example')", "CASE WHEN n_nationkey % 2 = 0 THEN concat('r', n_nationkey + 3, '.EXAMPLE') END")
REALM = "((u % 3) + 3 * (k % 9))"
ACCOUNT = (f"CASE event_id % 5 WHEN 0 THEN concat('R', {REALM}, '\\\\', 'User', u % 20) WHEN 1 THEN concat(' user', u % 20, '@R', {REALM}, '.Example ')"
           " WHEN 2 THEN concat('User', u % 20) WHEN 3 THEN concat('user', u % 20, '@nowhere') ELSE concat('r1\\\\x@user', u % 20) END")
ALIAS_SQL = f"""gr AS (SELECT concat('t', n_nationkey % 3) AS tenant, n_nationkey AS grp, unnest([1, 2, 3]) AS pos, unnest([lower({SPELLINGS[0]}), lower({SPELLINGS[1]}), lower({SPELLINGS[2]})]) AS realm FROM nation),
gs AS (SELECT * FROM gr WHERE realm IS NOT NULL),
rc(tenant, a, b) AS (SELECT DISTINCT tenant, grp, grp FROM gs UNION SELECT rc.tenant, rc.a, y.grp FROM rc JOIN gs x ON x.tenant = rc.tenant AND x.grp = rc.b JOIN gs y ON y.tenant = x.tenant AND y.realm = x.realm),
nm AS (SELECT rc.tenant, rc.a AS grp, arg_min(gs.realm, (gs.grp, gs.pos)) AS canonical FROM rc JOIN gs ON gs.tenant = rc.tenant AND gs.grp = rc.b GROUP BY 1, 2),
als AS (SELECT DISTINCT gs.tenant, realm, canonical FROM gs JOIN nm ON nm.tenant = gs.tenant AND nm.grp = gs.grp UNION ALL SELECT tenant, '', canonical FROM nm WHERE grp IN (0, 2)),
fa AS (SELECT ev.*, CASE event_id % 5 WHEN 0 THEN concat('r', {REALM}) WHEN 1 THEN concat('r', {REALM}, '.example') WHEN 2 THEN '' WHEN 3 THEN 'nowhere' ELSE 'r1' END AS realm,
 CASE event_id % 5 WHEN 0 THEN concat('r', {REALM}, chr(92), 'user', u % 20) WHEN 1 THEN concat('user', u % 20, '@r', {REALM}, '.example') WHEN 2 THEN concat('user', u % 20) WHEN 3 THEN concat('user', u % 20, '@nowhere')
 ELSE concat('r1', chr(92), 'x@user', u % 20) END AS plain, event_id % 5 <> 4 AS one FROM ev),
fo AS (SELECT fa.*, CASE WHEN one AND canonical IS NOT NULL THEN concat('user', u % 20, '@', canonical) END AS folded FROM fa LEFT JOIN als ON als.tenant = fa.tenant AND als.realm = fa.realm)"""


def _aliases(spark, sf):
    nation = table(spark, sf, "nation")
    rows = nation.select("n_nationkey", F.posexplode(F.array(*[F.expr(x) for x in SPELLINGS])).alias("pos", "spelling"))
    return realm_aliases(rows.select(F.concat(F.lit("t"), F.col("n_nationkey") % 3).alias("tenant"), F.col("n_nationkey").alias("grp"), "pos", "spelling",
                                     F.col("n_nationkey").isin(0, 2).alias("is_default")))


@query("realm_folding", f"WITH RECURSIVE {EV_SQL}, {ALIAS_SQL} SELECT event_id, tenant, folded FROM fo")
def realm_folding(spark, sf):
    """Accounts in several spellings, aliases in chains, a default realm for some tenants."""
    accounts = base_events(spark, sf).select("event_id", F.concat(F.lit("t"), F.col("u") % 3).alias("tenant"), F.expr(ACCOUNT).alias("account"))
    return folded_account(accounts, F.col("account"), F.col("tenant"), _aliases(spark, sf), "folded").select("event_id", "tenant", "folded")


GUESS = stretched(BY_NAME["common_bruteforce_by_account"])


@query("realm_folded_alerts", f"""WITH RECURSIVE {EV_SQL}, {ALIAS_SQL}, m AS (SELECT ingest_id AS eid, tenant, coalesce(folded, plain) AS grp, t FROM fo WHERE {FILTERS[GUESS.name]}),
lv AS (SELECT a.eid, a.tenant, a.grp, a.t, count(*) AS n FROM m a JOIN m b ON a.tenant = b.tenant AND a.grp = b.grp AND b.t BETWEEN a.t - {GUESS.window_s * 1000} AND a.t GROUP BY 1, 2, 3, 4)
SELECT concat('{GUESS.id}:', tenant, ':', length(grp), ':', grp, ':', t // {GUESS.window_s * 1000}) AS alert_id, max(t) AS last_t, count(*) AS hits FROM lv WHERE n >= {GUESS.threshold} GROUP BY 1""")
def realm_folded_alerts(spark, sf):
    """A rule by account over folded events: spellings of one account count together."""
    account = base_events(spark, sf).select(F.concat(F.lit("e"), "event_id").alias("_id"), F.expr(ACCOUNT).alias("_account"))
    events = security_events(spark, sf).join(account, F.col("siem.ingest_id") == F.col("_id"))
    events = events.withColumn("actor", F.col("actor").withField("user.name", F.col("_account"))).drop("_id", "_account")
    hits = detect.run_rules(events, [GUESS], mode="event", aliases=_aliases(spark, sf))
    return detect.collapse(hits).select("alert_id", F.col("t").alias("last_t"), "hits")


@query("alert_table", """WITH b AS (SELECT concat('a', user_id % 400) AS alert_id, epoch_us(ts) // 1000 AS time, event_id AS payload, user_id FROM events)
SELECT alert_id, max(time) AS time, arg_max(payload, time) AS payload, CASE WHEN bool_or(user_id % 400 % 5 = 0 AND payload % 3 < 2) THEN 'resolved' ELSE 'new' END AS status, CAST(NULL AS VARCHAR) AS note FROM b GROUP BY 1""")
def alert_table(spark, sf):
    """Batches of alerts into a versioned table: one comes twice, an analyst resolves some in between, and an old one comes late."""
    rows = base_events(spark, sf).select(F.concat(F.lit("a"), F.col("u") % 400).alias("alert_id"), F.col("t").alias("time"), F.col("event_id").alias("payload"),
                                         F.lit("new").alias("status"), F.lit(None).cast("string").alias("note"))
    alerts = VersionedTable(spark, f"{checkpoint_dir(spark)}/alerts-{uuid.uuid4().hex}", "alert_id", rows.schema, buckets=16)
    part = lambda i: rows.where(F.col("payload") % 3 == i)
    for i in (0, 1, 1):
        alerts.apply(part(i), sinks.upsert_alerts, "alerts", i)
    seen = alerts.read()
    resolved = seen.where(F.regexp_extract("alert_id", r"(\d+)", 1).cast("int") % 5 == 0).select("alert_id", F.lit(1).alias("at"), F.lit("resolved").alias("status"), "note")
    alerts.apply(resolved, sinks.apply_triage, "triage", 0)
    alerts.apply(part(2), sinks.upsert_alerts, "alerts", 2)
    alerts.apply(rows.withColumn("time", F.col("time") - 400 * DAY).withColumn("payload", F.lit(-1).cast("bigint")), sinks.upsert_alerts, "alerts", 3)
    return alerts.read()


LISTED_RULES = tuple(BY_NAME[n] for n in ("agent_egress_non_allowlisted_domain", "common_after_hours_admin", "common_large_outbound_flow", "ot_write_unlisted_source", "ot_opcua_write_unauthorized_node"))
# List entries by supplier: exact texts, networks of several lengths, and addresses.
ENTRIES = {"service_accounts": "CASE WHEN s_suppkey % 3 = 0 THEN concat('User', s_suppkey % 20) END", "agent_egress_domains": "CASE WHEN s_suppkey % 2 = 0 THEN concat('x', s_suppkey, '.example') END",
           "opcua_authorized_nodes": "CASE WHEN s_suppkey % 4 = 0 THEN concat('ns=2;s=', s_suppkey % 9) END", "large_transfer_destinations": "CASE WHEN s_suppkey % 5 = 0 THEN concat('203.0.113.', s_suppkey % 50) END",
           "corp_ranges": "concat('10.9.', s_suppkey % 3, '.0/24')", "ot_authorized_writers": "concat('10.', s_suppkey % 4, '.0.', 8 * (s_suppkey % 2), '/29')"}
NOT_LISTED = {"agent_egress_non_allowlisted_domain": ("mcp_domain", "mcp_domain IN (SELECT e FROM en WHERE l = 'agent_egress_domains')"),
              "common_after_hours_admin": ("user_name", "user_name IN (SELECT e FROM en WHERE l = 'service_accounts')"),
              "common_large_outbound_flow": ("dst_ip", "dst_ip IN (SELECT e FROM en WHERE l = 'large_transfer_destinations') OR concat(regexp_extract(dst_ip, '^[0-9]+.[0-9]+.[0-9]+', 0), '.0/24') IN (SELECT e FROM en WHERE l = 'corp_ranges')"),
              "ot_write_unlisted_source": ("src_ip", "concat(regexp_extract(src_ip, '^[0-9]+.[0-9]+.[0-9]+', 0), '.', 8 * (CAST(split_part(src_ip, '.', 4) AS BIGINT) // 8), '/29') IN (SELECT e FROM en WHERE l = 'ot_authorized_writers')"),
              "ot_opcua_write_unauthorized_node": ("ot_node", "ot_node IN (SELECT e FROM en WHERE l = 'opcua_authorized_nodes')")}


def _base_filter(name: str) -> str:
    """A rule's filter without its shipped entries."""
    return FILTERS[name].rpartition(" AND NOT (dst_ip")[0] if name == "common_large_outbound_flow" else FILTERS[name]


@query("listed_accounts", f"""WITH {EV_SQL}, en AS (SELECT DISTINCT l, e FROM ({' UNION ALL '.join(f"SELECT '{n}' AS l, {sql} AS e FROM supplier" for n, sql in ENTRIES.items())}) WHERE e IS NOT NULL)
{' UNION ALL '.join(f"SELECT tenant, ingest_id AS event_key, '{r.id}' AS rule_id FROM ev WHERE {_base_filter(r.name)} AND NOT coalesce({NOT_LISTED[r.name][1]}, false)" for r in LISTED_RULES)}""")
def listed_accounts(spark, sf):
    """Five rules with lists from a table, most of which ship empty."""
    entries = F.array(*[F.struct(F.lit(n).alias("list"), F.expr(sql).alias("entry")) for n, sql in ENTRIES.items()])
    lists = table(spark, sf, "supplier").select(F.explode(entries).alias("x")).select("x.*").where("entry is not null").distinct()
    hits = detect.run_rules(security_events(spark, sf), LISTED_RULES, mode="event", lists=lists)
    return hits.select("tenant", "event_key", "rule_id")
