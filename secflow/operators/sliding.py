"""Sliding windows that stay linear and never hold one key in one task.

Spark evaluates ``rangeBetween(-w, 0)`` by re-aggregating the frame for every row, and keeps a whole
key in one task. With a third of all rows on one key neither works. Here a sliding measure is a
*level*: an event raises it when it enters the window and lowers it ``w`` + 1 ms later, so the value
at time t is a running sum of changes up to t. A running sum splits anywhere: each key is cut into
time blocks, blocks are summed on their own, and one small row per (key, block) carries the total
into the next block. Changes of one (key, ms) are added up before they are shuffled, so a block holds
at most its length in milliseconds, whatever the number of events.

All windows are closed on both ends: ``[t - w, t]``. Times are BIGINT epoch ms. The window is a number,
or the name of one of the key columns when several window lengths share one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


Span = int | str


def _ms(span: Span) -> Column:
    return F.col(span) if isinstance(span, str) else F.lit(int(span)).cast("bigint")


def block_width(window_ms: Span) -> Column:
    """Block length: at least the window (so a neighbour is at most one block away), at least 1 h."""
    return F.greatest(_ms(window_ms), F.lit(HOUR_MS).cast("bigint"))


def _blocked(df: DataFrame, keys: Sequence[str], time: str, width: Column) -> DataFrame:
    """``df`` shuffled once by (keys, time block); rows with a null key or time are in no window."""
    present = reduce(and_, [F.col(c).isNotNull() for c in (*keys, time)])
    block = F.coalesce(F.floor(F.col(time) / width).cast("bigint"), F.lit(0))
    return df.where(present).withColumn("_blk", block).repartition(*keys, "_blk")


def _block_summary(base: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """One row per (keys, block) out of the exchange of ``base``.

    Both consumers of an exchange must read the same columns or Spark computes it twice, so the
    columns the summary has no use for are touched by a filter that is always true.
    """
    spare = [c for c in base.columns if c not in {*keys, "_blk"}]
    rows = base.groupBy(*keys, "_blk").agg(*aggs, *[F.max(c).alias(f"_use_{i}") for i, c in enumerate(spare)])
    used = reduce(or_, [F.col(f"_use_{i}").isNotNull() for i in range(len(spare))])
    return rows.where(used).drop(*[f"_use_{i}" for i in range(len(spare))])


def running(df: DataFrame, keys: Sequence[str], time: str, aggs: dict[str, tuple[str, str]],
            width: Column) -> DataFrame:
    """``df`` plus running aggregates per key over ``time`` (peers included).

    ``aggs`` maps an output name to ("sum" | "max", column). Rows are shuffled by (keys, block); a
    window over the per-block totals gives what each block starts from.
    """
    keys = list(keys)
    fold = {"sum": F.sum, "max": F.max}
    base = _blocked(df, keys, time, width)
    local = (Window.partitionBy(*keys, "_blk").orderBy(time)
             .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = _block_summary(base, keys, *[fold[kind](col).alias(f"_tot_{name}")
                                          for name, (kind, col) in aggs.items()])
    carry = totals.select(*keys, "_blk", *[
        fold[kind](f"_tot_{name}").over(before).alias(f"_carry_{name}") for name, (kind, _) in aggs.items()])
    joined = base.select("*", *[fold[kind](col).over(local).alias(f"_loc_{name}")
                                for name, (kind, col) in aggs.items()]).join(carry, [*keys, "_blk"])
    for name, (kind, _) in aggs.items():
        part, start = F.col(f"_loc_{name}"), F.col(f"_carry_{name}")
        total = F.coalesce(part, F.lit(0)) + F.coalesce(start, F.lit(0)) if kind == "sum" else F.greatest(part, start)
        joined = joined.withColumn(name, total)
    return joined.select(*df.columns, *aggs)


def neighbours(df: DataFrame, keys: Sequence[str], time: str, horizon_ms: Span) -> DataFrame:
    """``df`` (unique on keys + time) plus ``prev_t`` / ``next_t``: the nearest times of the same key
    that are at most ``horizon_ms`` away, else null.

    A block is at least as long as the horizon, so a row at the edge of its block only needs the last
    time of the block before and the first time of the block after.
    """
    keys = list(keys)
    base = _blocked(df, keys, time, block_width(horizon_ms))
    edges = _block_summary(base, keys, F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    around = edges.select(*keys, F.explode(F.array(
        F.struct((F.col("_blk") - 1).alias("_blk"), F.col("_lo").alias("_after"), F.lit(None).cast("bigint").alias("_before")),
        F.struct((F.col("_blk") + 1).alias("_blk"), F.lit(None).cast("bigint").alias("_after"), F.col("_hi").alias("_before"))
    )).alias("e")).groupBy(*keys, F.col("e._blk").alias("_blk")).agg(
        F.min("e._after").alias("_after"), F.max("e._before").alias("_before"))
    w = Window.partitionBy(*keys, "_blk").orderBy(time)
    out = (base.select("*", F.lag(time).over(w).alias("_p"), F.lead(time).over(w).alias("_n"))
           .join(around, [*keys, "_blk"], "left"))
    p, n = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    return out.select(*df.columns,
                      F.when(F.col(time) - p <= _ms(horizon_ms), p).alias("prev_t"),
                      F.when(n - F.col(time) <= _ms(horizon_ms), n).alias("next_t"))


def beside(df: DataFrame, keys: Sequence[str], time: str, value: str, out: str, after: bool = False,
           width_ms: int = 24 * HOUR_MS) -> DataFrame:
    """``df`` (unique on keys + time) plus ``out``: ``value`` of the row before (or after), however far."""
    keys = list(keys)
    base = _blocked(df, keys, time, F.lit(width_ms))
    pair = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    edge = _block_summary(base, keys, (F.min(pair) if after else F.max(pair)).alias("_e"))
    order = F.desc if after else F.asc
    carry = edge.select(*keys, "_blk", F.lag("_e.v").over(Window.partitionBy(*keys).orderBy(order("_blk"))).alias("_c"))
    local = F.lag(value).over(Window.partitionBy(*keys, "_blk").orderBy(order(time)))
    return (base.select("*", local.alias("_l")).join(carry, [*keys, "_blk"])
            .select(*df.columns, F.coalesce("_l", "_c").alias(out)))


def _level(changes: DataFrame, keys: Sequence[str], names: Sequence[str], window_ms: Span) -> DataFrame:
    """Running totals of ``names`` at every observed (key, t); ``_seen`` marks observed rows."""
    levels = running(changes, keys, "t", {f"_{n}": ("sum", n) for n in names}, block_width(window_ms))
    return (levels.where("_seen")
            .select(*keys, "t", *[F.col(f"_{n}").cast("bigint").alias(n) for n in names]))


def sliding_count(df: DataFrame, keys: Sequence[str], window_ms: Span, time: str = "t") -> DataFrame:
    """Events in ``[t - w, t]`` at every time of a key: (keys, t, n). ``df`` holds one row per event id."""
    per_ms = df.groupBy(*keys, F.col(time).alias("t")).agg(F.count(F.lit(1)).alias("c"))
    changes = per_ms.select(*keys, F.explode(F.array(
        F.struct(F.col("t").alias("t"), F.col("c").alias("n"), F.lit(True).alias("_seen")),
        F.struct((F.col("t") + _ms(window_ms) + 1).alias("t"), (-F.col("c")).alias("n"), F.lit(False).alias("_seen"))
    )).alias("x")).select(*keys, "x.*")
    return _level(changes, keys, ["n"], window_ms)


WORDS = ("f0", "f1", "f2", "f3")


def sliding_distinct(df: DataFrame, keys: Sequence[str], value: str, window_ms: Span, time: str = "t",
                     fingerprint: bool = False) -> DataFrame:
    """Distinct non-null ``value`` in ``[t - w, t]`` at every time of a key: (keys, t, n).

    A value is present from its first sighting until w after the last one of a run of sightings, so
    only the ends of each run change the level. Exact; no set is ever collected. ``fingerprint`` adds
    the sums of four 32-bit words of each value's sha256 (f0..f3): equal counts and sums mean equal
    sets, so two windows are compared without listing either.
    """
    seen = (df.where(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).alias("_v"), F.col(time).alias("t")).agg(F.lit(True).alias("_one")))
    runs = neighbours(seen.drop("_one"), [*keys, "_v"], "t", window_ms)
    names = ["n", *(WORDS if fingerprint else ())]
    digest = F.sha2(F.col("_v").cast("string"), 256)
    weights = [F.lit(1).cast("bigint")] + [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
                                           for i in range(len(names) - 1)]

    def step(at: Column, sign: int, when: Column, seen_here: bool) -> Column:
        return F.struct(at.alias("t"), *[F.when(when, w * sign).otherwise(F.lit(0).cast("bigint")).alias(n)
                                         for n, w in zip(names, weights, strict=True)],
                        F.lit(seen_here).alias("_seen"))

    opens, closes = F.col("prev_t").isNull(), F.col("next_t").isNull()
    changes = runs.select(*keys, F.explode(F.filter(F.array(
        step(F.col("t"), 1, opens, True),
        F.when(closes, step(F.col("t") + _ms(window_ms) + 1, -1, closes, False))
    ), lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")
    # Many values can change at one ms: add them up so that a block holds one row per ms.
    changes = changes.groupBy(*keys, "t").agg(*[F.sum(n).alias(n) for n in names], F.max("_seen").alias("_seen"))
    return _level(changes, keys, names, window_ms)


def sliding_cv(df: DataFrame, keys: Sequence[str], window_ms: Span, time: str = "t") -> DataFrame:
    """Count and regularity of the gaps in ``[t - w, t]``: (keys, t, n, cv).

    ``cv`` is the population standard deviation over the mean of the gaps between consecutive events,
    null below three events or for a mean of zero. Gap sums are integers, so the result does not
    depend on the order of addition.
    """
    per_ms = df.groupBy(*keys, F.col(time).alias("t")).agg(F.count(F.lit(1)).alias("c"))
    near = neighbours(per_ms, keys, "t", window_ms)
    gap_in = F.coalesce(F.col("t") - F.col("prev_t"), F.lit(0).cast("bigint"))
    gap_out = F.coalesce(F.col("next_t") - F.col("t"), F.lit(0).cast("bigint"))
    changes = near.select(*keys, F.explode(F.array(
        F.struct(F.col("t").alias("t"), F.col("c").alias("n"), gap_in.alias("s1"), (gap_in * gap_in).alias("s2"),
                 F.lit(True).alias("_seen")),
        F.struct((F.col("t") + _ms(window_ms) + 1).alias("t"), (-F.col("c")).alias("n"), (-gap_out).alias("s1"),
                 (-gap_out * gap_out).alias("s2"), F.lit(False).alias("_seen"))
    )).alias("x")).select(*keys, "x.*")
    level = _level(changes, keys, ["n", "s1", "s2"], window_ms)
    gaps = (F.col("n") - 1).cast("double")
    mean = F.try_divide(F.col("s1").cast("double"), gaps)
    var = F.greatest(F.try_divide(F.col("s2").cast("double"), gaps) - mean * mean, F.lit(0.0))
    cv = F.when((F.col("n") >= 3) & (mean > 0), F.sqrt(var) / mean)
    return level.select(*keys, "t", "n", cv.alias("cv"))


def sliding_measures(df: DataFrame, keys: Sequence[str], window_ms: Span, measure: str = "measure", value: str = "val", time: str = "t",
                     fingerprint: Column | None = None) -> DataFrame:
    """Counts, distinct values and regularity of many groups in one pass: (keys, t, n, cv[, f0..f3]).

    ``fingerprint`` says of which groups the content words are wanted; they are 0 for the others.

    ``measure`` says what is asked of a row's group: ``count``, ``distinct`` (of ``value``) or ``cv``; it must be one for all rows of a group, so rules with
    different measures have different keys. Changes of all three are one typed running state (events or values, gap sums, content words): they share the exchange of
    neighbours and that of running totals, where :func:`sliding_count`, :func:`sliding_distinct` and :func:`sliding_cv` take two each."""
    kind = F.col(measure)
    own = F.when(kind == "distinct", F.col(value).cast("string")).otherwise("")
    per = df.select(*keys, kind.alias("_m"), own.alias("_v"), F.col(time).alias("t")).groupBy(*keys, "_m", "_v", "t").agg(F.count(F.lit(1)).alias("c"))
    near = neighbours(per, [*keys, "_m", "_v"], "t", window_ms)
    distinct, cv = F.col("_m") == "distinct", F.col("_m") == "cv"
    zero = F.lit(0).cast("bigint")
    gap_in = F.when(cv, F.col("t") - F.col("prev_t"))
    gap_out = F.when(cv, F.col("next_t") - F.col("t"))
    weights = [F.when(distinct, 1).otherwise(F.col("c")).cast("bigint")]
    names = ["n", "s1", "s2"]
    if fingerprint is not None:
        digest = F.sha2(F.col("_v"), 256)
        names += WORDS
        weights += [F.when(distinct & fingerprint, F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")).otherwise(zero) for i in range(len(WORDS))]

    def change(at: Column, sign: int, when: Column, gap: Column, seen: bool) -> Column:
        gap = F.coalesce(gap, zero)
        amounts = [F.when(when, w * sign).otherwise(zero) for w in weights]
        return F.struct(at.alias("t"), *[a.alias(n) for n, a in zip(names, [amounts[0], gap * sign, gap * gap * sign, *amounts[1:]], strict=True)], F.lit(seen).alias("_seen"))

    opens, closes = ~distinct | F.col("prev_t").isNull(), ~distinct | F.col("next_t").isNull()
    changes = near.select(*keys, F.explode(F.filter(F.array(
        change(F.col("t"), 1, opens, gap_in, True),
        F.when(closes, change(F.col("t") + _ms(window_ms) + 1, -1, closes, gap_out, False))
    ), lambda x: x.isNotNull())).alias("x"), F.col("_m")).select(*keys, "_m", "x.*")
    changes = changes.groupBy(*keys, "t").agg(*[F.sum(n).alias(n) for n in names], F.max("_seen").alias("_seen"), F.max("_m").alias("_m"))
    levels = running(changes, keys, "t", {f"_{n}": ("sum", n) for n in names}, block_width(window_ms)).where("_seen")
    level = levels.select(*keys, "t", "_m", *[F.col(f"_{n}").cast("bigint").alias(n) for n in names])
    gaps = (F.col("n") - 1).cast("double")
    mean = F.try_divide(F.col("s1").cast("double"), gaps)
    var = F.greatest(F.try_divide(F.col("s2").cast("double"), gaps) - mean * mean, F.lit(0.0))
    regular = F.when((F.col("_m") == "cv") & (F.col("n") >= 3) & (mean > 0), F.sqrt(var) / mean)
    return level.select(*keys, "t", "n", regular.alias("cv"), *(WORDS if fingerprint is not None else ()))


def peak(levels: DataFrame, keys: Sequence[str], measure: str = "n") -> DataFrame:
    """Largest window per key and the first time it was reached: (keys, peak, peak_t)."""
    return (levels.groupBy(*keys)
            .agg(F.max(F.struct(F.col(measure).alias("m"), (-F.col("t")).alias("nt"))).alias("x"))
            .select(*keys, F.col("x.m").alias("peak"), (-F.col("x.nt")).alias("peak_t")))


def sessions(df: DataFrame, keys: Sequence[str], gap_ms: Span, time: str = "t") -> DataFrame:
    """(keys, t, session_start) per distinct time: a gap of exactly ``gap_ms`` stays in the session."""
    times = df.groupBy(*keys, F.col(time).alias("t")).agg(F.lit(1).alias("_one")).drop("_one")
    near = neighbours(times, keys, "t", gap_ms)
    opened = near.select(*keys, "t", F.when(F.col("prev_t").isNull(), F.col("t")).alias("_open"))
    return running(opened, keys, "t", {"session_start": ("max", "_open")}, block_width(gap_ms)).drop("_open")


def novelty(df: DataFrame, keys: Sequence[str], value: str, window_ms: Span, time: str = "t") -> DataFrame:
    """(keys, value, t, novel): whether the key did not show the value in the ``window_ms`` before t."""
    seen = (df.where(F.col(value).isNotNull()).groupBy(*keys, value, F.col(time).alias("t"))
            .agg(F.lit(1).alias("_one")).drop("_one"))
    near = neighbours(seen, [*keys, value], "t", window_ms)
    return near.select(*keys, value, "t", F.col("prev_t").isNull().alias("novel"))
