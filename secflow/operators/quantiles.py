"""Exact order statistics of many groups at once, by radix refinement.

A double's bits, turned so that they sort like numbers, are read 16 at a time from the top. Each round counts the values of
every group by their next digit, which partial aggregation does before the shuffle, and every rank asked for goes on in the
one digit that holds it. After four rounds a rank's bits are known, so it is one value. A window covers the 65,536 digits of a
round at most, never a group's values: a group that holds all rows is counted by all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secflow.session import cut_lineage

DIGIT, ROUNDS = 16, 4


def sortable(value: Column) -> Column:
    """The bits of a double as BIGINT whose unsigned order is that of the numbers (zeros are one, NaN is the largest)."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    low = F.lit(-(2**63)).cast("bigint")
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(low))


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(and_, [left[n].eqNullSafe(right[n]) for n in names])


def order_statistics(counted: DataFrame, keys: Sequence[str], wanted: DataFrame, value: str = "v", count: str = "c") -> DataFrame:
    """(keys, rank, value) of ``wanted`` (keys, rank from 0, each once). ``counted``: (keys, value, count), each value of a group once."""
    keys = list(keys)
    rows = counted.withColumn("_u", sortable(F.col(value)))
    state = wanted.select(*keys, "rank", F.col("rank").alias("rest"), F.lit(0).cast("bigint").alias("prefix"))
    place = [*keys, "prefix"]
    for i in range(ROUNDS):
        left = 64 - DIGIT * (i + 1)
        digit = F.shiftrightunsigned("_u", left).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("bigint"))
        prefix = F.shiftrightunsigned("_u", left + DIGIT) if i else F.lit(0).cast("bigint")
        read = rows.select(*keys, prefix.alias("prefix"), digit.alias("digit"), count, value)
        if i:
            asked = state.select(*place).distinct()
            read = read.join(asked, _same(read, asked, place), "left_semi")
        hist = read.groupBy(*place, "digit").agg(F.sum(count).alias("n"), F.max(value).alias(value))
        upto = F.sum("n").over(Window.partitionBy(*place).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hist = hist.withColumn("upto", upto)
        found = state.join(hist, _same(state, hist, place) & (state["rest"] < hist["upto"]) & (state["rest"] >= hist["upto"] - hist["n"]))
        grown = F.shiftleft(state["prefix"], DIGIT).bitwiseOR(hist["digit"])
        state = cut_lineage(found.select(*[state[k] for k in keys], "rank", (state["rest"] - hist["upto"] + hist["n"]).alias("rest"), grown.alias("prefix"), hist[value]))
        if i < ROUNDS - 1:
            state = state.drop(value)
    return state.select(*keys, "rank", value)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, n, q0, q1, ...): interpolated quantiles of the non-null values of each group."""
    keys = list(keys)
    counted = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    sizes = counted.groupBy(*keys).agg(F.sum("c").alias("n"))
    places = {i: (F.col("n") - 1) * F.lit(float(p)) for i, p in enumerate(shares)}
    ranks = [r for x in places.values() for r in (F.floor(x).cast("bigint"), F.least(F.floor(x).cast("bigint") + 1, F.col("n") - 1))]
    wanted = cut_lineage(sizes.select(*keys, "n", F.explode(F.array_distinct(F.array(*ranks))).alias("rank")))
    found = order_statistics(counted, keys, wanted)
    sized = wanted.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("rank").alias("_rank"), "n")
    rows = found.join(sized, reduce(and_, [found[k].eqNullSafe(sized[f"_{k}"]) for k in keys]) & (found["rank"] == sized["_rank"]))

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("v")))

    out = []
    for i, x in places.items():
        low, part = F.floor(x).cast("bigint"), x - F.floor(x)
        out.append((at(low) * (1 - F.max(part)) + at(F.least(low + 1, F.col("n") - 1)) * F.max(part)).alias(f"q{i}"))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *out)
