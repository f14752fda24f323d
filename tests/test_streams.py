"""Windows of a stream against brute force: both orders of arrival, ties, late and future rows, and state that ends empty."""

import random

import pytest
from pyspark.sql import functions as F

from secflow.streaming.windows_stream import FED, KEYS, OUT, RuleWindows, added_up

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
W = 10_000


def rows_of(seed, low, high, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        measure = rng.choice(["count", "distinct", "cv"])
        t = rng.choice([rng.randrange(low, high), rng.randrange(low, high) // 1000 * 1000])
        out.append((f"r-{measure}", W, measure, "t", f"g{rng.randrange(3)}", f"v{rng.randrange(6)}" if measure == "distinct" else None, t, False, 1, None))
    return out


def brute(rows):
    """(rule, grp, t) to (rows, n, cv)."""
    out, by = {}, {}
    for r in rows:
        by.setdefault((r[0], r[2], r[4]), []).append((r[6], r[5]))
    for (rule, measure, grp), members in by.items():
        for t in {m[0] for m in members}:
            inside = sorted(m for m, _ in members if t - W <= m <= t)
            n = len({v for m, v in members if t - W <= m <= t}) if measure == "distinct" else len(inside)
            cv = None
            if measure == "cv" and len(inside) >= 3 and inside[-1] > inside[0]:
                gaps = [b - a for a, b in zip(inside, inside[1:])]
                mean = sum(gaps) / len(gaps)
                cv = round(max(sum(g * g for g in gaps) / len(gaps) - mean * mean, 0.0) ** 0.5 / mean, 9)
            out[rule, grp, t] = (sum(m == t for m, _ in members), n, cv)
    return out


def streamed(spark, tmp_path, parts, lateness):
    """The rows that a stream makes of parts, one availableNow run for each, and how much state is left."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for part in parts:
        spark.createDataFrame(part, FED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        fed = spark.readStream.schema(spark.createDataFrame([], FED).schema).parquet(str(tmp_path / "in"))
        marked = fed.withColumn("ts", F.timestamp_millis(F.when(~F.col("ahead"), F.col("t")))).withWatermark("ts", lateness).drop("ts")
        out = marked.mapInPandas(added_up, FED).groupBy(*KEYS).transformWithStateInPandas(RuleWindows(), OUT, "Append", "EventTime")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect(), q.recentProgress[-1].stateOperators[0].numRowsTotal


CLOSING = ("r-none", W, "alone", "t", "e-1", None, 10**12, False, 1, "e-1")  # moves the watermark past all others


@pytest.mark.parametrize("turned", [False, True])
def test_every_window_whatever_the_order(spark, tmp_path, turned):
    parts = [rows_of(1, 0, 60_000, 250), rows_of(2, 40_000, 120_000, 250)]
    got, left = streamed(spark, tmp_path, [*(parts[::-1] if turned else parts), [CLOSING]], "1 day")
    windows = [r for r in got if r.kind == "window"]
    want = brute(parts[0] + parts[1])
    assert {(r.rule_id, r.grp, r.t): (r.rows, r.n, None if r.cv is None else round(r.cv, 9)) for r in windows} == want and len(windows) == len(want)
    assert not any(r.kind == "late" for r in got)


def test_late_future_and_idle(spark, tmp_path):
    first, second = rows_of(3, 200_000, 260_000, 200), rows_of(4, 100_000, 240_000, 200)
    mark = max(r[6] for r in first) - 50_000
    early = [(*r[:7], True, *r[8:]) for r in rows_of(5, 10**12, 10**12 + 5000, 20)]
    got, left = streamed(spark, tmp_path, [first, second + early, [CLOSING]], "50 seconds")
    late = [r for r in second if r[6] < mark]
    in_time = first + [r for r in second if r[6] >= mark]
    total = lambda kind: sum(r.rows for r in got if r.kind == kind)
    assert (total("late"), total("future"), total("window")) == (len(late), len(early), len(in_time))
    want = brute(in_time)
    assert {(r.rule_id, r.grp, r.t): (r.rows, r.n) for r in got if r.kind == "window"} == {k: v[:2] for k, v in want.items()}
    assert left == 0  # all groups are idle by then
