"""Networks, accounts, quantiles and window measures against plain Python; versioned tables that are interrupted, repeated and raced."""

import ipaddress
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from secflow.catalog.fixture import security_events
from secflow.normalize.assemble import assemble
from secflow.normalize.enrich import enrich, reference_segments
from secflow.operators import networks, sliding
from secflow.operators.networks import network_lookup, segments
from secflow.operators.quantiles import quantiles
from secflow.plans.identity import alias_conflicts, fold_alerts, realm_aliases
from secflow.sources import sinks
from secflow.sources.tables import VersionedTable


def some_networks(rng, n):
    out = []
    for i in range(n):
        if rng.random() < 0.6:
            base = ipaddress.IPv4Address(rng.choice([rng.getrandbits(32), 0x0A000000 | rng.getrandbits(12), 0x0A000000 | rng.getrandbits(24), 2**32 - 1 - rng.getrandbits(6)]))
            out.append((f"{base}/{rng.choice([0, 3, 8, 9, 15, 16, 17, 20, 24, 27, 31, 32])}", i))
        else:
            base = ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), (0x20010DB8 << 96) | rng.getrandbits(90), 2**128 - 1 - rng.getrandbits(5)]))
            out.append((f"{base}/{rng.choice([0, 1, 16, 20, 31, 32, 33, 47, 48, 49, 64, 65, 127, 128])}", i))
    return out


def test_networks(spark):
    rng = random.Random(11)
    nets = some_networks(rng, 300)
    nets += [(nets[i][0], 1000 + i) for i in range(20)] + [("10.0.0.7", 5000), ("::ffff:0:0/96", 5001), ("bad", 5002), ("10.0.0.0/33", 5003), ("10.0.0.0/x", 5004), (None, 5005), ("2001:DB8::5", 5006)]
    inside = []
    for text, _ in nets[:300]:
        net = ipaddress.ip_network(text, strict=False)
        inside += [str(net[0]), str(net[-1]), str(net[rng.randrange(min(net.num_addresses, 2**60))])]
    asked = inside + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(50)] + ["10.0.0.7", "10.0.0.8", "255.255.255.255", "0.0.0.0", "::", "2001:db8::5", "nonsense", "", None, "1.2.3"]
    parsed = []
    for text, v in nets:
        try:
            parsed.append((ipaddress.ip_network(text, strict=False), v))
        except (ValueError, TypeError):
            pass

    def best(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return None
        held = [(n.prefixlen, v) for n, v in parsed if n.version == a.version and a in n]
        return max(held)[1] if held else None

    cut = segments(spark.createDataFrame(nets, "cidr string, v long"), "cidr", ["v"], F.col("v"))
    df = spark.createDataFrame(list(enumerate(asked)), "i long, ip string")
    got = {r.i: r.v for r in network_lookup(df, "ip", cut, ["v"]).collect()}
    assert got == {i: best(ip) if ip else None for i, ip in enumerate(asked)}


def test_a_hot_address(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "10.1.2.3").when(F.col("id") % 3 == 1, F.concat(F.lit("10.9.0."), F.col("id") % 200)).alias("ip"))
    cut = segments(spark.createDataFrame([("10.1.0.0/16", "a"), ("10.9.0.0/25", "b")], "cidr string, v string"), "cidr", ["v"])
    got = network_lookup(df, "ip", cut, ["v"]).groupBy("v").count().collect()
    small = sum(1 for i in range(30_000) if i % 3 == 1 and i % 200 < 128)
    assert {r.v: r["count"] for r in got} == {"a": 10_000, "b": small, None: 30_000 - 10_000 - small}


def test_events_are_made_once_and_few_addresses_are_broadcast(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(ip):
        made.add(1)
        return ip

    rows = [(t, None if t % 7 == 0 else f"10.0.{t % 3}.{t % 5}") for t in range(60)]
    flat = spark.createDataFrame(rows, "time long, ip string").repartition(2)
    events = assemble(flat, {"time": F.col("time"), "src_endpoint.ip": seen("ip"), "dst_endpoint.ip": F.lit("10.0.1.9")})
    cut = reference_segments(None, spark.createDataFrame([("10.0.1.0/24", "AA"), ("10.0.2.0/31", "BB")], "cidr string, country string"))
    of = lambda ip: None if ip is None or ip.startswith("10.0.0.") else "AA" if ip.startswith("10.0.1.") else "BB" if ip[-1] in "01" else None
    want = sorted((t, of(ip) or "", "AA") for t, ip in rows)
    for few in (networks.FEW, -1):
        monkeypatch.setattr(networks, "FEW", few)
        made.value = 0
        got = enrich(events, cut).select("time", F.coalesce("src_endpoint.location.country", F.lit("")), "dst_endpoint.location.country")
        assert ("Exchange hashpartitioning" in got._jdf.queryExecution().executedPlan().toString()) == (few < 0)
        assert sorted(map(tuple, got.collect())) == want
        assert made.value == len(rows)


def test_enrichment_keeps_what_is_there(spark):
    events = security_events(spark, "/root/testdata/sf0.001")
    had = F.struct(F.lit("XX").alias("country"), F.lit("sensor").alias("source"))
    events = events.withColumn("src_endpoint", F.when(F.col("time") % 2 == 0, F.col("src_endpoint").withField("location", had)).otherwise(F.col("src_endpoint")))
    geo = spark.createDataFrame([("0.0.0.0/0", "ZZ")], "cidr string, country string")
    ioc = spark.createDataFrame([("10.0.0.1", None, 7, ["a"]), (None, "10.0.0.0/8", 101, ["b"]), (None, "10.0.0.0/9", None, ["c"])], "ip string, cidr string, score int, categories array<string>")
    rows = enrich(events, reference_segments(ioc, geo)).select("time", "src_endpoint").collect()
    assert len(rows) == events.count()
    for r in rows:
        side = r.src_endpoint
        if r.time % 2 == 0:
            assert side.location.country == "XX"
        elif side is not None and side.ip is not None:
            assert side.location.country is not None
        if side is not None and side.reputation is not None and side.reputation.score is not None:
            assert side.ip == "10.0.0.1" and side.reputation.score == 7


def test_alias_chain(spark):
    groups = [("a", i, 0, f"R{i}", i == 7) for i in range(30)] + [("a", i, 1, f" r{i + 1} ", False) for i in range(30)]
    groups += [("b", 1, 0, "R5", False), ("b", 1, 1, "other", False), ("b", 2, 0, "bad realm", True), ("b", 2, 1, None, False)]
    df = spark.createDataFrame(groups, "tenant string, grp long, pos long, spelling string, is_default boolean")
    aliases = realm_aliases(df)
    got = {(r.tenant, r.realm): r.canonical for r in aliases.collect()}
    assert got == {("a", f"r{i}"): "r0" for i in range(31)} | {("a", ""): "r0", ("b", "r5"): "r5", ("b", "other"): "r5"}
    assert {(r.tenant, r.spelling) for r in alias_conflicts(df).where("reason = 'not a realm'").collect()} == {("b", "bad realm"), ("b", None)}
    alerts = spark.createDataFrame([("a", "R30\\Bob"), ("a", "bob@r3"), ("a", "Bob"), ("a", "bob@x"), ("a", "r1\\a@b"), ("b", "bob"), ("b", "bob@OTHER"), ("c", "bob@r1"), (None, "bob@r1"), ("a", None)],
                                   "tenant_id string, actor string")
    folded = sorted(map(str, (r.actor for r in fold_alerts(alerts, aliases).collect())))
    assert folded == sorted(map(str, ["bob@r0", "bob@r0", "bob@r0", "bob@x", "r1\\a@b", "bob", "bob@r5", "bob@r1", "bob@r1", None]))


def test_quantiles_of_one_group_with_all_rows(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1e6, 20_000), [0.0, -0.0, 1e-300, -1e300, 5e-324], np.full(5000, 7.25)])
    rows = [("all", float(v)) for v in values] + [("one", 4.5), ("none", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    shares = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)
    got = {r.k: [r[f"q{i}"] for i in range(len(shares))] for r in quantiles(df, ["k"], "v", shares).collect()}
    assert got.keys() == {"all", "one", None} and got["one"] == [4.5] * 6 and got[None] == pytest.approx([1.0, 1.5, 2.0, 2.9, 2.98, 3.0])
    assert got["all"] == pytest.approx([float(np.quantile(values, p)) for p in shares], rel=1e-12)


def test_measures_share_a_pass(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(600):
        m = rng.choice(["count", "distinct", "cv"])
        rows.append((f"{m}{rng.randrange(3)}", m, f"v{rng.randrange(5)}" if m == "distinct" else None, rng.randrange(0, 40) * 250, 1000 * rng.choice([1, 3])))
    df = spark.createDataFrame([(r[0] + str(r[4]), *r[1:]) for r in rows], "k string, measure string, val string, t long, w long")
    keys = ["k", "w"]
    got = {(r.k, r.t): (r.n, None if r.cv is None else round(r.cv, 9)) for r in sliding.sliding_measures(df, keys, "w", fingerprint=F.lit(True)).collect()}
    want = {(r.k, r.t): (r.n, None) for r in sliding.sliding_count(df.where("measure = 'count'"), keys, "w").collect()}
    want |= {(r.k, r.t): (r.n, None) for r in sliding.sliding_distinct(df.where("measure = 'distinct'"), keys, "val", "w").collect()}
    want |= {(r.k, r.t): (r.n, None if r.cv is None else round(r.cv, 9)) for r in sliding.sliding_cv(df.where("measure = 'cv'"), keys, "w").collect()}
    assert got == want


ALERT = "alert_id string, time long, payload string, status string, note string"


def content(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def test_versioned_table(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), "alert_id", ALERT, buckets=4)
    batch = lambda *rows: spark.createDataFrame([(i, t, p, "new", None) for i, t, p in rows], ALERT)
    assert content(table) == [] and table.state()["version"] == 0
    assert table.apply(batch(("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")), sinks.upsert_alerts, "s", 0) == 1
    assert table.apply(batch(("a", 9, "again")), sinks.upsert_alerts, "s", 0) == 1  # the same batch once more
    first = content(table)
    assert [r[2] for r in first] == ["x", "y", "z"]
    untouched = dict(table.state()["buckets"])
    table.apply(batch(("a", 2, "x2"), ("a", 3, "x3")), sinks.upsert_alerts, "s", 1)
    assert [r[2] for r in content(table)] == ["x3", "y", "z"] and content(table, 1) == first
    assert sum(table.state()["buckets"][b] != v for b, v in untouched.items()) == 1  # one bucket was rewritten
    # a job that is lost before its version is published leaves nothing behind that a reader sees
    monkeypatch.setattr(table, "_publish", lambda state: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.apply(batch(("b", 5, "half")), sinks.upsert_alerts, "s", 2)
    monkeypatch.undo()
    assert [r[2] for r in content(table)] == ["x3", "y", "z"] and len(table.unnamed(keep=9)) == 1
    table.apply(batch(("b", 5, "whole")), sinks.upsert_alerts, "s", 2)
    assert [r[2] for r in content(table)] == ["x3", "whole", "z"]
    # triage by another stream, kept by later batches; and two writers of one version
    triage = spark.createDataFrame([("c", 1, "resolved", "done")], "alert_id string, at long, status string, note string")
    table.apply(triage, sinks.apply_triage, "triage", 0)
    table.apply(batch(("c", 7, "newer")), sinks.upsert_alerts, "s", 3)
    assert [r[1:] for r in content(table) if r[0] == "c"] == [(7, "newer", "resolved", "done")]
    with pytest.raises(RuntimeError):
        table._publish(table.state())
    assert math.isclose(len(content(table)), 3)


def test_insert_only_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "id", "id string, time long", buckets=2)
    once = lambda current, new: current.unionByName(sinks.insert_if_absent(current, new, "id"))
    for n, rows in enumerate([[("a", 5), ("a", 3)], [("a", 1), ("b", 2)]]):
        table.apply(spark.createDataFrame(rows, "id string, time long"), once, "s", n)
    assert content(table) == [("a", 3), ("b", 2)]
