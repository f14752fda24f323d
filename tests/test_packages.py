"""Evidence packages against a plain fold, every kind of tampering, and ancestry in deep, cyclic and shared trees."""

import hashlib
import json

from pyspark.sql import functions as F

from secflow.plans import correlate, packages


def made(spark):
    incidents = spark.createDataFrame([("i1", "t", 3), ("i2", "t", 1), (None, "t", 9)], "incident_id string, tenant_id string, severity long")
    alerts = spark.createDataFrame([("i1", "a2", 20, None), ("i1", "a1", 20, "é \"q\""), ("i1", "a3", 5, "x"), ("i2", "a1", None, "x")], "incident_id string, alert_id string, time long, note string")
    events = spark.createDataFrame([("i1", "e1", "g1", 7), ("i1", "e1", "g1", 7), ("i1", None, "g2", 3), ("i1", "", None, 4), ("i1", None, None, 4), ("i2", "e1", None, 1)],
                                   "incident_id string, event_id string, ingest_id string, time long")
    graphs = spark.createDataFrame([("i1", "{}")], "incident_id string, graph string")
    return packages.contents(incidents, alerts, events, graphs)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_packages_are_a_fold(spark):
    blocks, found = packages.build(made(spark))
    rows, stored = blocks.collect(), {r.incident_id: r for r in found.collect()}
    assert sorted(stored) == ["i1", "i2"] and packages.verify(blocks, found).count() == 0
    for incident, package in stored.items():
        mine = sorted((r for r in rows if r.incident_id == incident), key=lambda r: r["index"])
        prev, knots = packages.ZERO_HASH, []
        for i, r in enumerate(mine):
            assert (r["index"], r.prev_hash, r.content_hash) == (i, prev, sha(r.content))
            head = {"type": r.type, "block_id": r.block_id, "index": i, "prev_hash": prev, "content_hash": r.content_hash}
            prev = sha(json.dumps(head, sort_keys=True, separators=(",", ":")))
            knots.append({k: head[k] for k in ("type", "block_id", "content_hash")})
            assert list(json.loads(r.content)) == sorted(json.loads(r.content))
        assert (package.block_count, package.head_hash) == (len(mine), prev)
        assert package.package_id == f"evidence:{incident}:" + sha(json.dumps(knots, sort_keys=True, separators=(",", ":")))
    order = [r.block_id for r in sorted((r for r in rows if r.incident_id == "i1"), key=lambda r: r["index"])]
    assert order[:5] == ["incident", "alert:a3", "alert:a1", "alert:a2", "event:g2"] and order[-2:] == ["event:e1", "graph"] and len(order) == 9


def test_tampering_is_named(spark):
    blocks, found = packages.build(made(spark))
    faults = lambda b, p=found: {(r.incident_id, r.failure) for r in packages.verify(b, p).collect()}
    at = (F.col("incident_id") == "i1") & (F.col("index") == 2)
    assert faults(blocks.withColumn("content", F.when(at, "{}").otherwise(F.col("content")))) == {("i1", "alert:a1: content")}
    assert ("i1", "alert:a1: link") in faults(blocks.withColumn("prev_hash", F.when(at, "0").otherwise(F.col("prev_hash"))))
    lost = faults(blocks.where(~at))
    assert ("i1", "block count") in lost and ("i1", "package id") in lost and ("i1", "alert:a2: position") in lost
    assert ("i1", "alert:a1: type") in faults(blocks.withColumn("type", F.when(at, "other").otherwise(F.col("type"))))
    assert ("i1", "alert:a2: id twice") in faults(blocks.withColumn("block_id", F.when(at, "alert:a2").otherwise(F.col("block_id"))))
    assert ("i1", "first block") in faults(blocks.where(~((F.col("incident_id") == "i1") & (F.col("index") == 0))))
    swapped = blocks.withColumn("content", F.when((F.col("incident_id") == "i1") & (F.col("index") == 0), F.lit('{"incident_id":"i2"}')).otherwise(F.col("content")))
    assert ("i1", "incident block") in faults(swapped)
    assert faults(blocks.where("incident_id <> 'i2'")) == {("i2", "no blocks")}
    assert ("i2", "head hash") in faults(blocks, found.withColumn("head_hash", F.when(F.col("incident_id") == "i2", "x").otherwise(F.col("head_hash"))))
    assert ("i2", "no package") in faults(blocks, found.where("incident_id = 'i1'"))


def test_cited_events(spark):
    alerts = spark.createDataFrame([("i1", "a", "e1"), ("i1", "a", "g1"), ("i1", "a", "g2"), ("i1", "b", "gone"), ("i2", "a", "g1")], "incident_id string, alert_id string, event_id string")
    events = spark.createDataFrame([("i1", "e1", "g1", 7), ("i1", None, "g2", 3)], "incident_id string, event_id string, ingest_id string, time long")
    got = {(r.incident_id, r.alert_id, r.event_id): r.block_id for r in packages.cited_events(alerts, events).collect()}
    assert got == {("i1", "a", "e1"): "event:e1", ("i1", "a", "g1"): "event:e1", ("i1", "a", "g2"): "event:g2", ("i1", "b", "gone"): None, ("i2", "a", "g1"): None}


def test_ancestry_of_a_thousand(spark):
    chain = [(i, i - 1 if i else None) for i in range(1001)] + [(5000, 5001), (5001, 5002), (5002, 5000), (6000, 5001), (7000, 7000)]
    df = spark.createDataFrame(chain, "node long, parent long")
    got = {r.node: (r.ancestor, r.distance) for r in correlate.nearest_marked(df, spark.createDataFrame([(0,), (400,), (9999,)], "node long")).collect()}
    assert got == {i: ((0, i) if i <= 400 else (400, i - 400)) for i in range(1, 1001)}


def test_links_to_the_nearest_alerted_ancestor_of_the_same_incident(spark):
    tree = spark.createDataFrame([("t", f"p{i}", f"p{i - 1}" if i else None) for i in range(60)], "tenant_id string, process string, parent string")
    held = [("a", 0, "e0"), ("b", 20, "f20"), ("a", 40, "e40"), ("a", 40, "e41"), ("b", 59, "f59"), ("a", 59, "e59")]
    members = spark.createDataFrame([(i, "t", e, 100 + p, f"p{p}") for i, p, e in held] + [("a", "t", "none", 1, None)], "incident_id string, tenant_id string, event_id string, time long, process string")
    got = {tuple(r) for r in correlate.ancestor_links(members, tree).collect()}
    assert got == {("a", "e0", "e40", 40), ("a", "e40", "e59", 19), ("b", "f20", "f59", 39)}


def test_components_go_on(spark):
    parts = [[("i1", "z1"), ("i2", "z2"), ("i3", "z3")], [("i4", "z1"), ("i4", "z2"), ("i5", "z9")], [("i6", "z9"), ("i6", "z3"), ("i6", "z1")]]
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string")
    nodes, merged = correlate.components(frame(parts[0])), []
    for part in parts[1:]:
        nodes, moved = correlate.advanced(nodes, frame(part))
        merged.append(moved.count())
    whole = {r.node: r.root for r in correlate.components(frame(sum(parts, []))).collect()}
    assert {r.node: r.root for r in nodes.collect()} == whole and set(whole.values()) == {"i1"} and all(merged)
