"""Work that must be done once per record, and spread over all cores wherever the rows lie."""

import json

from pyspark.sql import functions as F

from secflow.catalog import load
from secflow.catalog.fixture import security_events
from secflow.normalize import job
from secflow.normalize.assemble import assemble
from secflow.operators.cooldown import cooldown
from secflow.plans import correlate
from secflow.plans.rules import BY_NAME
from secflow.schema import raw_schema
from secflow.streaming.windows_stream import ALONE_GROUPS, KEYS, fed

QUERIES = load()[0]


def bronze(spark, rows):
    return spark.createDataFrame([(s, r, {"received_at": 1_700_000_000_000, "tenant_id": "t1"}) for s, r in rows], raw_schema())


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_steps_are_not_copied(spark):
    line = "Jun 10 13:55:01 db sshd[1]: Failed password for invalid user al from 198.51.100.7 port 51000 ssh2"
    ssh = job.normalize_source(bronze(spark, [("linux_ssh", line)]), "linux_ssh")
    assert optimized(ssh).count("regexp_extract(") < 20
    row = ssh.first()
    assert (row.activity_id, row.actor.user.name, row.src_endpoint.ip, row.src_endpoint.port) == (4, "al", "198.51.100.7", 51000)
    call = json.dumps({"tool": "fileDelete", "session_id": "s", "arguments": {"q": "cm0gLXJmIC8gJiYgZWNobyBkb25l", "url": "https://u@Host.example/x"}})
    agent = job.normalize_source(bronze(spark, [("mcp_agent", call)]), "mcp_agent")
    assert optimized(agent).count("regexp_extract_all(") < 5
    row = agent.first()
    assert (row.activity_id, row.unmapped.mcp.destructive_command_indicator, row.unmapped.mcp.egress_domain) == (4, True, "host.example")


def test_routing_parses_once(spark):
    rows = [(None, r) for r in ('{"functionCode":6,"address":1}', '{"uid":"C","id.orig_h":"1.2.3.4"}', '{"operation":"GRANT","object":"t"}', '{"x":1}', "{broken",
                                "%ASA-4-106023: Deny", None)] + [("cef", '{"functionCode":6}')]
    routed = job.resolved(bronze(spark, rows))
    assert "get_json_object" not in optimized(routed)
    assert [r.resolved_source for r in routed.collect()] == ["modbus_anomaly", "zeek_json", "db_audit", None, None, "cisco_asa", None, "cef"]


def test_short_keys_are_streamed(spark):
    rows = [(f"k{i % 40}", 100 * i) for i in range(400)] + [("long", t) for t in range(0, 90_000, 7)]
    kept = cooldown(spark.createDataFrame(rows, "k string, t bigint"), ["k"], 300, width=6000)
    assert "FlatMapGroups" not in optimized(kept)  # a call for each key, most of which have a time or two
    want = []
    for key in {k for k, _ in rows}:
        last = None
        for t in sorted(t for k, t in rows if k == key):
            if last is None or t >= last + 300:
                want.append((key, last := t))
    assert sorted((r.k, r.t) for r in kept.collect()) == sorted(want)


def test_incidents_and_links_are_worked_out_once(spark):
    rows = [(f"al{i}", "t1", 1000 * i, "r", f"TA{i % 2}", "T1", 5, f"u{i % 3}", f"10.0.0.{i % 4}", None, f"e{i}", None) for i in range(60)]
    alerts = spark.createDataFrame(rows, "alert_id string, tenant_id string, time bigint, rule_id string, tactic string, technique string, score int, actor string, "
                                         "ip string, device string, event_id string, anomaly string")
    shown, members = correlate.incidents(correlate.alert_tracks(alerts))
    assert "Join" not in optimized(members) and "Generate" not in optimized(shown)
    key = F.struct(F.lit("flow").alias("ns"), F.lit("self").alias("role"), F.col("actor").alias("h"), F.lit("asserted").alias("scope_trust"))
    links = correlate.graph_links(members.where("entity_type = 'actor'").withColumn("causal_keys", F.array(key)))
    assert "Generate" not in optimized(links)
    assert (shown.count(), members.count(), links.count()) == (3, 60, 57)


def test_events_of_alerts_are_read_once(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id AS event_id", "timestamp_millis(1704067200000 + id * 60000) AS ts", "id % 97 AS user_id", "'click' AS event_type",
                                        "0.5D AS value", "concat('{\"k\":', id % 100, '}') AS props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    for name in ("window_evidence", "make_alerts_all"):
        made = QUERIES[name](spark, str(tmp_path))
        assert "parquet" not in optimized(made) and "to_json" not in optimized(made)
        assert made.count() > 0


def test_events_without_a_window_share_groups(spark):
    rules = [BY_NAME["win_lsass_access_suspicious"]]
    leaves = {"class_uid": F.lit(1002), "activity_id": F.lit(5), "time": F.col("id"), "siem.ingest_id": F.concat(F.lit("e"), "id"), "siem.tenant": F.lit("t1"),
              "siem.source_type": F.lit("windows_eventlog"), "unmapped.lsass_access_suspicious": F.lit(True)}
    rows = fed(assemble(spark.range(500), leaves), rules, "event")
    assert rows.select("event_key").distinct().count() == 500
    assert rows.select(*KEYS).distinct().count() <= ALONE_GROUPS


def test_rows_of_one_row_group_are_dealt(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id AS event_id", "timestamp_millis(1704067200000 + id) AS ts", "id AS user_id", "'click' AS event_type",
                                        "0.5D AS value", "concat('{\"k\":', id % 100, '}') AS props")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits of a file whose rows are all in one of them
    try:
        used = security_events(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert used >= spark.sparkContext.defaultParallelism
