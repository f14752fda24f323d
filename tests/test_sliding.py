"""Windows against a plain Python recomputation, with ties, exact edges and one hot key."""

import math
import random

import pytest

from secflow.operators import sliding
from secflow.operators.cooldown import cooldown
from secflow.plans.inventory import ip_history

W = 4_000_000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(rng.choice("aaab"), rng.randrange(0, 40_000_000) // rng.choice([1, 100_000]), rng.choice("uvwxyz")) for _ in range(300)]
    return out + [("a", t, "u") for t in (0, W, W + 1, 2 * W + 1, 2 * W + 2)] + [(None, 5, "u")]


def inside(rows, k, t):
    return [r for r in rows if r[0] == k and t - W <= r[1] <= t]


def test_count_distinct_and_regularity(spark, rows):
    df = spark.createDataFrame(rows, "k string, t bigint, v string").repartition(5)
    count = {(r.k, r.t): r.n for r in sliding.sliding_count(df, ["k"], W).collect()}
    distinct = {(r.k, r.t): r.n for r in sliding.sliding_distinct(df, ["k"], "v", W).collect()}
    regular = {(r.k, r.t): (r.n, r.cv) for r in sliding.sliding_cv(df, ["k"], W).collect()}
    assert not any(k is None for k, _ in count)
    for k, t, _ in rows:
        if k is None:
            continue
        win = inside(rows, k, t)
        times = sorted(r[1] for r in win)
        gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
        mean = sum(gaps) / len(gaps) if gaps else 0
        cv = math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) / mean if len(times) >= 3 and mean > 0 else None
        assert count[k, t] == len(win)
        assert distinct[k, t] == len({r[2] for r in win})
        assert regular[k, t][0] == len(win)
        assert regular[k, t][1] == (None if cv is None else pytest.approx(cv))


def test_fingerprint_tells_equal_value_sets(spark):
    rows = [("a", t, v) for t, v in ((0, "x"), (5, "y"))] + [("b", 3, "y"), ("b", 5, "x"), ("c", 5, "x"), ("c", 4, "z")]
    out = sliding.sliding_distinct(spark.createDataFrame(rows, "k string, t bigint, v string"), ["k"], "v", 10, fingerprint=True)
    at5 = {r.k: tuple(r[w] for w in ("n", *sliding.WORDS)) for r in out.collect() if r.t == 5}
    assert at5["a"] == at5["b"] != at5["c"]


def test_sessions_keep_an_exact_gap(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 100, 201, 301, 1_000_000_000)], "k string, t bigint")
    got = {r.t: r.session_start for r in sliding.sessions(df, ["k"], 100).collect()}
    assert got == {0: 0, 100: 0, 201: 201, 301: 201, 1_000_000_000: 1_000_000_000}


@pytest.mark.parametrize("width", [300, 1000, None])
def test_cooldown_equals_the_plain_walk(spark, width):
    rng = random.Random(3)
    rows = [(k, rng.randrange(0, span)) for k, span in (("a", 30_000), ("b", 3_000_000)) for _ in range(600)]
    want = set()
    for k in "ab":
        last = None
        for t in sorted({t for kk, t in rows if kk == k}):
            if last is None or t - last >= 300:
                want.add((k, t))
                last = t
    got = cooldown(spark.createDataFrame(rows, "k string, t bigint"), ["k"], 300, width=width)
    assert {(r.k, r.t) for r in got.collect()} == want


def test_ip_history_across_blocks(spark):
    day = 86_400_000
    obs = [("t", "m", ip, t) for ip, t in (("A", 0), ("A", 5 * day), ("B", 9 * day), ("A", 9 * day + 1))]
    got = ip_history(spark.createDataFrame(obs, "tenant_id string, mac string, ip string, t bigint")).orderBy("from_ts").collect()
    assert [(r.ip, r.from_ts, r.to_ts) for r in got] == [("A", 0, 9 * day), ("B", 9 * day, 9 * day + 1), ("A", 9 * day + 1, None)]
