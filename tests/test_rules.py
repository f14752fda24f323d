"""Null rules of predicates, id-less events, future times, and the shipped catalogue."""

from pyspark.sql import functions as F

from secflow.functions import predicates as P
from secflow.functions import scalars as S
from secflow.normalize.assemble import assemble, identity_leaves
from secflow.operators import joins
from secflow.plans import detect
from secflow.plans.correlate import components
from secflow.plans.rules import BY_NAME, RULES


def check(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_missing_values(spark):
    rows = [("a",), (None,)]
    assert check(spark, "x string", rows, P.eq("x", "a")) == [True, False]
    assert check(spark, "x string", rows, ~P.eq("x", "a")) == [False, True]
    assert check(spark, "x string", rows, P.not_in("x", ["a"])) == [False, True]
    assert check(spark, "x string", [("7",), ("q",), (None,)], P.cmp("x", "ne", 3)) == [True, False, False]


def test_networks_and_hours(spark):
    assert check(spark, "x string", [("172.31.9.1",), ("172.32.0.1",), ("x",), (None,)], P.not_in("x", [], ["172.16.0.0/12"])) == [False, True, True, True]
    monday = 1_704_096_000_000  # 2024-01-01 08:00 UTC
    assert check(spark, "x bigint", [(monday,), (monday - 1,), (monday + 5 * 86_400_000,)], P.outside_hours("x")) == [False, True, True]


def test_domains_and_outcomes(spark):
    names = [("a.b.example.co.uk",), ("x.example.com.",), ("10.0.0.1",), ("1.0.10.in-addr.arpa",), ("host",)]
    assert check(spark, "x string", names, S.parent_domain(F.col("x"))) == ["example.co.uk", "example.com", None, None, None]
    assert check(spark, "x string", [("Denied",), ("403",), ("302",), (None,), ("true",)], S.outcome(F.col("x"))) == ["Failure", "Failure", "Success", "Success", "Success"]


def test_longest_prefix(spark):
    nets = [("10.0.0.0/8", "a", 1), ("10.1.0.0/16", "b", 1), ("10.1.0.0/16", "c", 9), ("2001:db8::/32", "s", 1)]
    ips = [("10.1.2.3",), ("10.9.9.9",), ("2001:DB8::5",), ("8.8.8.8",), (None,)]
    out = joins.cidr_lpm(spark.createDataFrame(ips, "ip string"), "ip", spark.createDataFrame(nets, "cidr string, v string, score int"), "cidr", ["v"], "score")
    assert {r.ip: r.v for r in out.collect()} == {"10.1.2.3": "c", "10.9.9.9": "a", "2001:DB8::5": "s", "8.8.8.8": None, None: None}


def failures(spark, rows):
    df = spark.createDataFrame(rows, "id string, t bigint, ip string, user string")
    leaves = {"time": F.col("t"), "siem.ingest_id": F.col("id"), "siem.tenant": F.lit("acme"), "src_endpoint.ip": F.col("ip"), "actor.user.name": F.col("user")}
    return assemble(df, leaves | identity_leaves(F.lit(3002), F.lit(4)))


def test_bruteforce_threshold_and_redelivery(spark):
    rule = [BY_NAME["common_bruteforce"]]
    nine = [(f"e{i}", 1_000 * i, "10.0.0.1", "u") for i in range(9)]
    assert detect.run_rules(failures(spark, nine + [("e0", 0, "10.0.0.1", "u")]), rule).count() == 0
    hits = detect.collapse(detect.run_rules(failures(spark, nine + [("e9", 60_000, "10.0.0.1", "u")]), rule)).collect()
    assert [(h.n, h.hits) for h in hits] == [(10, 1)]
    assert detect.run_rules(failures(spark, nine + [("e9", 60_001, "10.0.0.1", "u")]), rule).count() == 0
    idless = [(None, 5, "10.0.0.1", "u")] * 20
    assert detect.run_rules(failures(spark, idless), rule).count() == 0
    late = [(f"e{i}", 400_000, "10.0.0.1", "u") for i in range(20)]
    assert detect.run_rules(failures(spark, late), rule, now_ms=1_000).count() == 0


def test_companion_speaks_only_when_its_sibling_does_not(spark):
    rules = [BY_NAME["common_bruteforce"], BY_NAME["common_bruteforce_by_account"]]
    one_source = [(f"e{i}", 1_000 * i, "10.0.0.1", "Root") for i in range(10)]
    names = lambda rows: {r.rule_id for r in detect.run_rules(failures(spark, rows), rules).collect()}
    assert names(one_source) == {rules[0].id}
    two_sources = [(f"e{i}", 1_000 * i, f"10.0.0.{i % 2}", "root" if i % 3 else " ROOT") for i in range(10)]
    assert names(two_sources) == {rules[1].id}


def test_catalogue_is_whole():
    assert len(RULES) == 48 and len({r.id for r in RULES}) == 48
    assert sum(r.companion_of is not None for r in RULES) == 5


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("zz", f"y{i}") for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {v for k, v in got.items() if k[0] == "n"} == {"n000"} and {v for k, v in got.items() if k[0] in "yz"} == {"y0"}
