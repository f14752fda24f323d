"""Enrichment by nested networks of both versions, and a rule that depends on it, from raw records on."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.catalog.fixture import BASE_SQL, EV_SQL, base_events, security_events, spread_events, table
from secflow.catalog.registry import query
from secflow.catalog.rule_queries import stretched
from secflow.normalize import job
from secflow.normalize.enrich import enrich, reference_segments
from secflow.plans import detect
from secflow.plans.rules import BY_NAME

# Networks by supplier: nested ones around 10.x.y.0, single addresses, and two lengths of IPv6.
IOC = {"ip": "CASE WHEN s_suppkey % 6 = 1 THEN concat('203.0.113.', s_suppkey % 50) WHEN s_suppkey % 6 = 2 THEN concat('2001:DB8:0:0', ':', s_suppkey % 9, '::1') END",
       "cidr": "CASE s_suppkey % 6 WHEN 3 THEN concat('2001:db8:', s_suppkey % 9, '::/48') WHEN 4 THEN concat('2001:db8:', s_suppkey % 9, '::7/32')"
               " ELSE concat('10.', s_suppkey % 16, '.', s_suppkey % 5, '.9/', CASE s_suppkey % 7 WHEN 0 THEN 8 WHEN 1 THEN 13 WHEN 2 THEN 16 WHEN 3 THEN 22 WHEN 4 THEN 25 WHEN 5 THEN 30 ELSE 2 END) END",
       "score": "CAST(s_suppkey % 104 AS INT)"}
GEO = {"cidr": "CASE WHEN s_suppkey % 4 = 3 THEN concat('2001:db8:', s_suppkey % 9, '::/', CASE WHEN s_suppkey % 8 = 3 THEN 48 ELSE 45 END)"
               " ELSE concat('10.', s_suppkey % 16, '.0.0/', CASE s_suppkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 16 ELSE 27 END) END", "country": "concat('K', s_suppkey % 7)"}
ADDRESS = "CASE WHEN event_id % 5 = 0 THEN concat('2001:db8:', k % 9, ':', CASE WHEN k % 2 = 0 THEN '' ELSE 'a:' END, ':1') WHEN event_id % 5 = 1 THEN concat('203.0.113.', k % 50) ELSE concat('10.', k % 11, '.', u % 7, '.', u % 64) END"


def _cut(spark, sf):
    suppliers = table(spark, sf, "supplier")
    ioc = suppliers.selectExpr(*[f"{sql} AS {name}" for name, sql in IOC.items()], "array(concat('c', s_suppkey % 3)) AS categories")
    return reference_segments(ioc, suppliers.selectExpr(*[f"{sql} AS {name}" for name, sql in GEO.items()]))


# Addresses and networks as numbers of two parts: IPv4 as (4, number, 0); IPv6 by its third and fourth group, which is all in which they differ here.
NET_SQL = """v4(x, n) AS (SELECT x, CAST(string_split(x, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(x, '.')[2] AS BIGINT) * 65536 + CAST(string_split(x, '.')[3] AS BIGINT) * 256 + CAST(string_split(x, '.')[4] AS BIGINT)
 FROM (SELECT DISTINCT x FROM texts WHERE x NOT LIKE '%:%')),
v6(x, g) AS (SELECT x, CAST(string_split(x, ':')[3] AS BIGINT) FROM (SELECT DISTINCT x FROM texts WHERE x LIKE '%:%'))"""


def _best_sql(name: str, nets: str, order: str, values: str) -> str:
    """(x, values) of the deepest network that holds an address; ``nets`` has base, len and values."""
    return f"""{name} AS (SELECT x, max(({order}, {values})) AS best FROM (
 SELECT a.x, n.* FROM v4 a JOIN (SELECT *, b.n AS base_n FROM {nets} JOIN v4 b ON b.x = base WHERE len <= 32 AND base NOT LIKE '%:%') n ON a.n >> (32 - len) = base_n >> (32 - len)
 UNION ALL SELECT a.x, n.* FROM v6 a JOIN (SELECT *, b.g AS base_n FROM {nets} JOIN v6 b ON b.x = base WHERE base LIKE '%:%') n ON CASE WHEN len = 128 THEN a.x = n.base ELSE a.g >> (48 - len) = base_n >> (48 - len) END) GROUP BY 1)"""


IOC_SQL = f"""ioc0 AS (SELECT lower({IOC['ip']}) AS ip, {IOC['cidr']} AS cidr, {IOC['score']} AS score, concat('c', s_suppkey % 3) AS cat FROM supplier),
ioc AS (SELECT CASE WHEN ip IS NULL THEN split_part(cidr, '/', 1) WHEN ip LIKE '%:%' THEN concat('2001:db8:0:0:', split_part(ip, ':', 5), '::1') ELSE ip END AS base,
 CASE WHEN ip IS NULL THEN CAST(split_part(cidr, '/', 2) AS BIGINT) WHEN ip LIKE '%:%' THEN 128 ELSE 32 END AS len, ip IS NOT NULL AS exact, score, cat FROM ioc0 WHERE score BETWEEN 0 AND 100),
geo AS (SELECT split_part({GEO['cidr']}, '/', 1) AS base, CAST(split_part({GEO['cidr']}, '/', 2) AS BIGINT) AS len, {GEO['country']} AS country FROM supplier)"""


@query("enriched_events", f"""WITH {EV_SQL}, ad AS (SELECT *, {ADDRESS} AS dst6 FROM ev), {IOC_SQL},
texts(x) AS (SELECT src_ip FROM ad UNION SELECT dst6 FROM ad UNION SELECT base FROM ioc UNION SELECT base FROM geo), {NET_SQL},
{_best_sql('rep', 'ioc', 'len, exact', 'score, cat')}, {_best_sql('loc', 'geo', 'len', 'country')}
SELECT ingest_id, src_ip, dst6 AS dst_ip, r.best[3] AS src_score, r.best[4] AS src_category, coalesce(country, l.best[2]) AS src_country, q.best[3] AS dst_score, q.best[4] AS dst_category, m.best[2] AS dst_country
FROM ad LEFT JOIN rep r ON r.x = src_ip LEFT JOIN loc l ON l.x = src_ip LEFT JOIN rep q ON q.x = dst6 LEFT JOIN loc m ON m.x = dst6""")
def enriched_events(spark, sf):
    """Reputation and country of both endpoints; what an event has stays."""
    events = security_events(spark, sf)
    address = base_events(spark, sf).select(F.concat(F.lit("e"), "event_id").alias("_id"), F.expr(ADDRESS).alias("_dst"))
    events = events.join(address, F.col("siem.ingest_id") == F.col("_id")).withColumn("dst_endpoint", F.col("dst_endpoint").withField("ip", F.col("_dst"))).drop("_id", "_dst")
    side = lambda s: [F.col(f"{s}_endpoint.{f}").alias(f"{s}_{n}") for f, n in (("ip", "ip"), ("reputation.score", "score"), ("location.country", "country"))]
    return enrich(events, _cut(spark, sf)).select(F.col("siem.ingest_id").alias("ingest_id"), *side("src"), F.col("src_endpoint.reputation.categories")[0].alias("src_category"),
                                                  *side("dst"), F.col("dst_endpoint.reputation.categories")[0].alias("dst_category"))


TRAVEL = stretched(BY_NAME["common_impossible_travel"])
LOGON = "to_json(named_struct('EventID', 4624, 'TimeCreated', t, 'TargetUserName', concat('acct', u), 'IpAddress', concat('10.', k % 11, '.', u % 7, '.', u % 64), 'Computer', 'dc1'))"


@query("impossible_travel_from_raw", f"""WITH {BASE_SQL}, {IOC_SQL}, lg AS (SELECT event_id, t, concat('acct', u) AS grp, concat('10.', k % 11, '.', u % 7, '.', u % 64) AS ip FROM base),
texts(x) AS (SELECT ip FROM lg UNION SELECT base FROM geo), {NET_SQL}, {_best_sql('loc', 'geo', 'len', 'country')},
m AS (SELECT grp, t, best[2] AS val FROM lg JOIN loc ON x = ip), lv AS (SELECT a.grp, a.t, count(DISTINCT b.val) AS n FROM (SELECT DISTINCT grp, t FROM m) a JOIN m b ON a.grp = b.grp AND b.t BETWEEN a.t - {TRAVEL.window_s * 1000} AND a.t GROUP BY 1, 2)
SELECT concat('{TRAVEL.id}:default:', length(grp), ':', grp, ':', t // {TRAVEL.window_s * 1000}) AS alert_id, max(t) AS last_t, arg_max(n, t) AS n FROM lv WHERE n >= {TRAVEL.threshold} GROUP BY 1""")
def impossible_travel_from_raw(spark, sf):
    """Raw logons to events with countries to alerts on accounts that are in two countries within the window."""
    given = {"received_at": F.col("t"), "ingest_id": F.concat(F.lit("e"), "event_id")}
    fields = T.DataType.fromDDL(job_meta()).fields
    meta = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    bronze = spread_events(spark, sf).select(F.lit("active_directory").alias("source_type"), F.expr(LOGON).alias("raw"), meta.alias("meta"))
    events, _ = job.normalize(bronze, ("active_directory",), _cut(spark, sf))
    hits = detect.run_rules(events, [TRAVEL], mode="event")
    return detect.collapse(hits).select("alert_id", F.col("t").alias("last_t"), "n")


def job_meta() -> str:
    from secflow.schema import RAW_META
    return RAW_META
