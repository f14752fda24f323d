"""Hostile and odd records: none ends the job, none vanishes, none is invented; merges keep what they should."""

import json

import pytest
from pyspark.sql import functions as F

from secflow.normalize import job
from secflow.plans import correlate, detect, evaluate
from secflow.functions import scalars as S
from secflow.schema import event_schema, raw_schema
from secflow.sources import readers, sinks


def bronze(spark, rows):
    return spark.createDataFrame([(s, r, {"received_at": 1_700_000_000_000, "tenant_id": "t1"}) for s, r in rows], raw_schema())


def test_garbage_is_dead_letter(spark):
    rows = [(name, raw) for name in job.SOURCES for raw in ("garbage {", "", "[1]", "{broken", "null")]
    events, dead = job.normalize(bronze(spark, rows))
    made = [(r.siem.source_type, r.message) for r in events.collect()]
    assert not [m for m in made if job.SOURCES[m[0]].schema]
    assert len(made) + dead.count() == len(rows)


def test_repeated_keys(spark):
    line = "CEF:0|v|p|1|id|name|5|src=10.0.0.1 src=10.0.0.2 spt=1 act=blocked act=allowed"
    events, _ = job.normalize(bronze(spark, [("cef", line)]), ["cef"])
    assert [r.src_endpoint.ip for r in events.collect()] == ["10.0.0.2"]
    beat = json.dumps({"winlog": {"event_id": 4625, "computer_name": "dc1", "event_data": {"Computer": "other", "TargetUserName": "u"}}})
    raw = job.unwrap_shipper(bronze(spark, [("windows_eventlog", beat)])).first().raw
    assert json.loads(raw) == {"EventID": "4625", "Computer": "dc1", "TargetUserName": "u"}


def test_repeated_xml_names(spark, tmp_path):
    data = "".join(f"<Data Name='{n}'>{v}</Data>" for n, v in (("TargetUserName", "a"), ("TargetUserName", "b"), ("Computer", "x")))
    (tmp_path / "e.xml").write_text(f"<Events><Event><System><EventID>4624</EventID><Computer>dc</Computer></System><EventData>{data}</EventData></Event></Events>")
    got = json.loads(readers.read_winevent_xml(spark, str(tmp_path / "e.xml")).first().raw)
    assert (got["TargetUserName"], got["Computer"]) == ("b", "dc")


def test_broken_array_stays(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a":1},{"b":2}]\n[broken\n{"c":3}\n')
    assert sorted(r.raw for r in readers.read_raw_json(spark, str(tmp_path)).collect()) == ['[broken', '{"a":1}', '{"b":2}', '{"c":3}']


def test_dns_lines_of_five_forms(spark, tmp_path):
    (tmp_path / "zeek.log").write_text("#separator \\x09\n#fields\tquery\tts\tid.orig_h\nz.example\t1.5\t10.0.0.1\n")
    (tmp_path / "mixed.log").write_text('ts,name,client\n1,c.example,10.0.0.2\n{"ts":2,"name":"j.example","client":"10.0.0.3"}\n'
                                        "Jan  1 10:00:00 dnsmasq[1]: query[A] m.example from 10.0.0.4\n"
                                        "01-Jan-2024 10:00:00 queries: client @0x1 10.0.0.5#53 (b.example): query: b.example IN A\nno form at all\n")
    good, bad = readers.read_dns_lines(spark, str(tmp_path))
    assert sorted((r.name, r.client) for r in good.collect()) == [("b.example", "10.0.0.5"), ("c.example", "10.0.0.2"), ("j.example", "10.0.0.3"),
                                                                  ("m.example", "10.0.0.4"), ("z.example", "10.0.0.1")]
    assert [r.value for r in bad.collect()] == ["no form at all"]


def test_dns_csv_by_header(spark, tmp_path):
    (tmp_path / "four.csv").write_text('ts,client,qname,type\n1,10.0.0.1,a.example,A\n2,10.0.0.2,"b,c.example",A\n')
    (tmp_path / "one.csv").write_text("Domain\nd.example\ndomain.example\n")
    (tmp_path / "two.csv").write_text("client,query\n10.0.0.3,query\n,e.example\n10.0.0.4\n")
    good, bad = readers.read_dns_lines(spark, str(tmp_path))
    assert sorted((r.name, r.client or "", r.ts or "") for r in good.collect()) == [
        ("a.example", "10.0.0.1", "1"), ("b,c.example", "10.0.0.2", "2"), ("d.example", "", ""), ("domain.example", "", ""), ("e.example", "", ""), ("query", "10.0.0.3", "")]
    assert [r.value for r in bad.collect()] == ["10.0.0.4"]
    with pytest.warns(UserWarning, match="1 lines"):
        assert readers.read_dns_log(spark, str(tmp_path)).count() == 6


def test_one_spelling_of_addresses(spark):
    records = [json.dumps({"operation": "select", "ip": ip, "timestamp": 1_700_000_000}) for ip in ("::ffff:10.0.0.1", "2001:DB8:0::5", "::::", "10.0.0.9")]
    events, _ = job.normalize(bronze(spark, [("db_audit", r) for r in records]), ["db_audit"])
    assert sorted(str(r.src_endpoint.ip) for r in events.collect()) == ["10.0.0.1", "10.0.0.9", "2001:db8::5", "None"]


def test_merges(spark):
    current = spark.createDataFrame([("e1", 10, {"a": "old", "b": "keep"})], "entity_id string, last_seen long, attributes map<string,string>")
    updates = spark.createDataFrame([("e1", 20, {"a": "new"}), ("e1", 30, {"c": "add"}), ("e2", 5, {"x": "1"})], current.schema)
    got = {r.entity_id: (r.last_seen, r.attributes) for r in correlate.merge_entities(current, updates).collect()}
    assert got == {"e1": (30, {"a": "new", "b": "keep", "c": "add"}), "e2": (5, {"x": "1"})}
    alerts = spark.createDataFrame([("a", 1, "new", None), ("b", 9, "resolved", "n")], "alert_id string, time long, status string, note string")
    marks = spark.createDataFrame([("a", 1, "in_progress", "first"), ("a", 2, "resolved", None), ("a", 3, "nonsense", "no")], "alert_id string, at long, status string, note string")
    assert {tuple(r) for r in sinks.apply_triage(alerts, marks).collect()} == {("a", 1, "resolved", "first"), ("b", 9, "resolved", "n")}
    batch = spark.createDataFrame([("b", 5, "new", None), ("c", 1, "new", None)], alerts.schema)
    assert {(r.alert_id, r.time) for r in sinks.upsert_alerts(alerts, batch).collect()} == {("a", 1), ("b", 9), ("c", 1)}
    rows = spark.createDataFrame([("r", None, 1), ("r", None, 2), ("r", "x", 3), ("r", "x", 3)], "rule_id string, alert_id string, time long")
    assert evaluate.alert_volume(rows).first().n == 3
    ci = spark.range(1).select(S.wilson(F.lit(0), F.lit(0)).alias("w")).first().w
    assert (ci.low, ci.high) == (None, None)


def test_large_incident_stays_whole(spark):
    alerts = spark.range(1500).selectExpr("concat('a', lpad(id, 5, '0')) AS alert_id", "'t' AS tenant_id", "id * 1000 AS time", "'r' AS rule_id",
                                          "if(id % 2 = 0, 'TA0001', 'TA0002') AS tactic", "'T1' AS technique", "1 AS score", "'root' AS actor",
                                          "cast(null as string) AS ip", "cast(null as string) AS device", "concat('e', lpad(id, 5, '0')) AS event_id", "cast(null as string) AS anomaly")
    rows, members = correlate.incidents(correlate.alert_tracks(alerts))
    one = rows.first()
    assert (one.member_count, len(one.member_alert_ids), one.truncated, one.severity) == (1500, 200, True, 1000)
    assert members.count() == 1500  # whole, as rows
    key = F.struct(F.lit("flow").alias("ns"), F.lit("self").alias("role"), F.lit("h").alias("h"), F.lit("asserted").alias("scope_trust"))
    links = correlate.graph_links(members.withColumn("causal_keys", F.array(key)))
    assert links.count() == 1499
    shown = correlate.shown_links(links, 10).collect()
    assert len(shown) == 10 and {r.links_total for r in shown} == {1499}


def test_long_chain_is_one_component(spark):
    edges = spark.range(1999).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in correlate.components(edges).collect()} == {0}


def event(**given):
    row = {f.name: None for f in event_schema()} | given
    return tuple(row[f.name] for f in event_schema())


def test_events_without_id_and_tenants_stay_apart(spark):
    base = {"class_uid": 6003, "activity_id": 4, "time": 1_700_000_000_000}
    rows = [event(**base, message=m, siem={"tenant": t, "ingest_id": i, "key_scope": {"host": "h"}}, actor={"session": {"uid": "0xabc"}})
            for m, t, i in (("one", "t1", None), ("two", "t1", None), ("x", "t1", "same"), ("x", "t2", "same"))]
    events = spark.createDataFrame(rows, event_schema())
    keys = events.select(detect.event_key().alias("k")).distinct().count()
    assert keys == 3
    causal = detect.causal_keys(events.where("siem.ingest_id = 'same'")).collect()
    assert len({(r.tenant, r.event_key) for r in causal}) == 2 and len({r.causal_keys[0].h for r in causal}) == 2
