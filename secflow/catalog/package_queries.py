"""Evidence packages of the incidents of the events table, against a fold over the same blocks in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from secflow.catalog.correlate_queries import SESS_SQL, tracked
from secflow.catalog.registry import query
from secflow.plans import packages as P
from secflow.session import cut_lineage

HEAD = ("incident_id", "tenant_id", "first_seen", "last_seen", "member_count", "severity")
BLOCKS_SQL = f"""{SESS_SQL}, bk AS (
SELECT incident_id, 0 AS rank, 0 AS time, '' AS name, 'incident' AS type, 'incident' AS block_id, concat('{{"first_seen":', first_seen, ',"incident_id":"', incident_id, '","last_seen":', last_seen, ',"member_count":', member_count, ',"severity":', severity, ',"tenant_id":"', tenant_id, '"}}') AS content FROM inc
UNION ALL SELECT incident_id, 1, time, alert_id, 'alert', concat('alert:', alert_id), concat('{{"alert_id":"', alert_id, '","rule_id":"', rule_id, '","score":', score, ',"time":', time, '}}') FROM mb
UNION ALL SELECT DISTINCT incident_id, 2, time, event_id, 'event', concat('event:', event_id), concat('{{"event_id":"', event_id, '","ingest_id":"i', event_id, '","time":', time, '}}') FROM mb),
bh AS (SELECT *, sha256(content) AS content_hash, row_number() OVER (PARTITION BY incident_id ORDER BY rank, time, name) - 1 AS idx FROM bk)"""
PACK_SQL = f"""WITH RECURSIVE {BLOCKS_SQL},
wk(incident_id, idx, head) AS (SELECT DISTINCT incident_id, CAST(-1 AS BIGINT), repeat('0', 64) FROM bh
 UNION ALL SELECT bh.incident_id, bh.idx, sha256(concat('{{"block_id":"', block_id, '","content_hash":"', content_hash, '","index":', bh.idx, ',"prev_hash":"', head, '","type":"', type, '"}}')) FROM wk JOIN bh ON bh.incident_id = wk.incident_id AND bh.idx = wk.idx + 1),
dg AS (SELECT incident_id, count(*) AS n, sha256(concat('[', string_agg(concat('{{"block_id":"', block_id, '","content_hash":"', content_hash, '","type":"', type, '"}}'), ',' ORDER BY idx), ']')) AS d FROM bh GROUP BY 1)
SELECT concat('evidence:', incident_id, ':', d) AS package_id, incident_id, n AS block_count, head AS head_hash FROM dg JOIN wk USING (incident_id) WHERE idx = n - 1"""


def _built(spark, sf):
    incidents, members = tracked(spark, sf)
    incidents = cut_lineage(incidents)
    events = members.select("incident_id", "event_id", F.concat(F.lit("i"), "event_id").alias("ingest_id"), "time")
    blocks = P.contents(incidents.select(*HEAD), members.select("incident_id", "alert_id", "rule_id", "score", "time"), events.unionByName(events))
    done, packages = P.build(blocks)
    return cut_lineage(done), cut_lineage(packages), incidents


@query("evidence_packages", PACK_SQL)
def evidence_packages(spark, sf):
    """Every event is delivered twice and stands once."""
    return _built(spark, sf)[1].select("package_id", "incident_id", "block_count", "head_hash")


@query("evidence_verify", f"""WITH {BLOCKS_SQL} SELECT incident_id, concat(block_id, ': content') AS failure FROM bh JOIN inc USING (incident_id) WHERE idx = 1 AND severity % 3 = 0
UNION ALL SELECT incident_id, 'package id' AS failure FROM inc WHERE severity % 3 = 1 UNION ALL SELECT incident_id, 'no blocks' AS failure FROM inc WHERE severity % 12 = 2""")
def evidence_verify(spark, sf):
    """Contents changed in some packages, another id given to some, all blocks of some lost; the others have no fault."""
    blocks, packages, incidents = _built(spark, sf)
    kind = incidents.select("incident_id", F.col("severity").alias("_s"))
    blocks = blocks.join(kind, "incident_id")
    touched = blocks.where(F.col("_s") % 12 != 2).withColumn("content", F.when((F.col("index") == 1) & (F.col("_s") % 3 == 0), F.concat("content", F.lit(" "))).otherwise(F.col("content"))).drop("_s")
    packages = packages.join(kind, "incident_id")
    renamed = packages.withColumn("package_id", F.when(F.col("_s") % 3 == 1, F.concat("package_id", F.lit("0"))).otherwise(F.col("package_id"))).drop("_s")
    return P.verify(touched, renamed)
