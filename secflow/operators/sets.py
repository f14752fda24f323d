"""Dedup, unions, top lists and caps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def latest_by(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """One row per key: the greatest in ``order``. Aggregates before the shuffle, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(
        *[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)])).alias("_row"))
    return ranked.select(*keys, "_row.*").select(*df.columns)


def earliest_by(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return ranked.select(*keys, "_row.*").select(*df.columns)


def distinct_events(df: DataFrame, keys: Sequence[str], event_id: str = "event_id", time: str = "t") -> DataFrame:
    """One row per event id and key, with its newest time; events without an id share one per ms."""
    ident = F.coalesce(F.col(event_id), F.concat(F.lit("@"), F.col(time).cast("string")))
    return df.withColumn("_id", ident).groupBy(*keys, "_id").agg(F.max(time).alias(time))


def top_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value (planned as a distributed top-k, no full sort)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(n)


def newest(df: DataFrame, n: int, time: str = "time", tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(time), F.asc(tie)).limit(n)


def cap_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key. Spark prunes to n rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def capped_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str], ident: str, cap: int,
               out: str = "event_ids") -> DataFrame:
    """Per key the first ``cap`` ids in ``order`` and how many were left out. Lists stay bounded."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    first = cap_per_key(df.select(*keys, *dict.fromkeys([*order, ident])), keys,
                        [F.asc_nulls_last(c) for c in order], cap)
    lists = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, ident])))).alias("_l"))
    return (totals.join(lists, list(keys))
            .select(*keys, F.transform("_l", lambda x: x[ident]).alias(out),
                    F.greatest(F.col("_total") - cap, F.lit(0).cast("bigint")).alias(f"{out}_omitted")))


def histogram(df: DataFrame, time: str, start: int, end: int, bins: int) -> DataFrame:
    """Counts in ``bins`` equal parts of [start, end); empty bins are listed with 0."""
    width = (end - start) / bins
    inside = df.where((F.col(time) >= start) & (F.col(time) < end))
    binned = inside.groupBy(F.least(F.lit(bins - 1), F.floor((F.col(time) - start) / width)).cast("int").alias("bin"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (all_bins.join(binned.agg(F.count(F.lit(1)).alias("n")), "bin", "left")
            .select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of several columns from one scan: (facet, value, n)."""
    sets = [[F.col(c)] for c in columns]
    grouped = df.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    bits = {c: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}
    facet = reduce(lambda acc, c: acc.when(F.col("_g") == bits[c], F.lit(c)), columns, F.when(F.lit(False), ""))
    return grouped.select(facet.alias("facet"), F.coalesce(*[F.col(c).cast("string") for c in columns]).alias("value"), "n")
