"""Readers, dead letter, sinks, and stream equals batch."""

from pyspark.sql import functions as F

from secflow.normalize import job
from secflow.sources import readers, sinks
from secflow.streaming import detect_stream as stream

LINES = ["%ASA-4-106023: Deny tcp src outside:203.0.113.5/51000 dst inside:10.0.0.10/22",
         "Jun 10 13:55:01 db01 sshd[2154]: Failed password for invalid user admin from 203.0.113.9 port 51000 ssh2", "gibberish"]


def test_text_lines_to_events_and_dead_letter(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LINES) + "\n")
    bronze = readers.read_syslog(spark, str(tmp_path), received_ms=1_700_000_000_000)
    events, dead = job.normalize(bronze, ("cisco_asa", "linux_ssh"))
    got = {r.siem.source_type: (r.class_uid, r.activity_id, r.src_endpoint.ip, r.src_endpoint.port, r.time) for r in events.collect()}
    assert got == {"cisco_asa": (4001, 6, "203.0.113.5", 51000, 1_700_000_000_000), "linux_ssh": (3002, 4, "203.0.113.9", 51000, 1_700_000_000_000)}
    assert [r.raw for r in dead.collect()] == ["gibberish"]
    assert sinks.replay(dead).columns == ["source_type", "raw", "meta"]


def test_winevent_xml(spark, tmp_path):
    (tmp_path / "e.xml").write_text('<Events><Event><System><Provider Name="P"/><EventID>4625</EventID><Computer>dc1</Computer></System>'
                                    '<EventData><Data Name="TargetUserName">bob</Data><Data Name="IpAddress">10.1.1.1</Data></EventData></Event></Events>')
    raw = readers.read_winevent_xml(spark, str(tmp_path / "e.xml")).first().raw
    assert '"EventID":"4625"' in raw and '"TargetUserName":"bob"' in raw


def test_dns_formats(spark, tmp_path):
    (tmp_path / "q.log").write_text("Jan  1 00:00:01 dnsmasq[1]: query[A] a.example.com from 10.0.0.1\n")
    row = readers.read_dns_log(spark, str(tmp_path)).first()
    assert (row.name, row.client) == ("a.example.com", "10.0.0.1")


def test_routed_write_and_read(spark, tmp_path):
    docs = spark.createDataFrame([("e1", "event", "bank", "acme", 1_700_000_000_000), ("e2", "event", "bank", "BAD!", 1)],
                                 "id string, kind string, sector string, tenant string, time bigint")
    base = str(tmp_path / "t")
    assert [r.id for r in sinks.write_routed(docs, base).collect()] == ["e2"]
    assert [r.id for r in readers.read_table(spark, base, "events-bank", "acme").collect()] == ["e1"]


def test_tumbling_stream(spark, tmp_path):
    df = spark.createDataFrame([(i * 30_000, "a") for i in range(10)], "t bigint, k string").withColumn("ts", F.timestamp_millis("t"))
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    out = stream.tumbling_counts(spark.readStream.schema(df.schema).parquet(src), ["k"], "1 minute")
    q = out.writeStream.format("memory").queryName("tumbling_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.start_ms: r.n for r in spark.table("tumbling_out").collect()} == {i * 60_000: 2 for i in range(5)}


def run(out, tmp_path, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return out.sparkSession.table(name).collect()


def test_redelivered_once(spark, tmp_path):
    rows = [("a", "e1", 1000), ("a", "e1", 1000), ("b", "e1", 1000), ("a", "e2", 2000), ("a", "e1", 1500)]
    df = spark.createDataFrame(rows, "tenant string, ingest_id string, t bigint").withColumn("ts", F.timestamp_millis("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(stream.redelivered_once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), tmp_path, "once_out")
    assert sorted((r.tenant, r.ingest_id) for r in got) == [("a", "e1"), ("a", "e2"), ("b", "e1")]


def test_track_sessions_stream(spark, tmp_path):
    hour = 3_600_000
    times = [0, 5 * hour, 29 * hour - 1, 60 * hour, 61 * hour, 400 * hour]  # the last one closes what is before it
    df = spark.createDataFrame([("k", t) for t in times], "k string, t bigint").withColumn("ts", F.timestamp_millis("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(stream.track_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["k"]), tmp_path, "session_out")
    assert sorted((r.first_seen, r.last_seen, r.n) for r in got) == [(0, 29 * hour - 1, 3), (60 * hour, 61 * hour, 2)]
