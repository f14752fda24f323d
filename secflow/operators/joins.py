"""Lookups: exact, longest network prefix, and interval (who held an address at a time).

No broadcast hint is given anywhere: Spark broadcasts a side by its measured size
(``spark.sql.autoBroadcastJoinThreshold``, AQE) and otherwise shuffles, with AQE splitting hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.functions.predicates import ipv4_number, is_ipv4
from secflow.functions.scalars import DAY_MS


def lookup(df: DataFrame, table: DataFrame, on: str, table_key: str, **fields: str) -> DataFrame:
    """Left lookup of unique ``table_key``; adds ``new_name=table_column`` columns."""
    side = table.select(F.col(table_key).alias("_k"), *[F.col(c).alias(n) for n, c in fields.items()])
    return df.join(side, F.col(on) == F.col("_k"), "left").drop("_k")


@F.pandas_udf(T.StringType())
def _ipv6_hex(values: pd.Series) -> pd.Series:
    import ipaddress

    def one(text):
        try:
            return format(int(ipaddress.IPv6Address(text.partition("%")[0])), "032x")
        except ValueError:
            return None

    table = {v: one(v) for v in values.dropna().unique()}
    return pd.Series([table.get(v) for v in values], dtype=object)


def _v4_key(number: Column, length: Column) -> Column:
    return F.concat_ws("/", F.lit("4"), F.call_function("shiftright", number, 32 - length).cast("string"),
                       length.cast("string"))


def _v6_key(hex32: Column, length: Column) -> Column:
    whole, bits = F.floor(length / 4).cast("int"), length % 4
    nibble = F.conv(F.substr(hex32, whole + 1, F.lit(1)), 16, 10).cast("int")
    partial = F.when(bits > 0, F.call_function("shiftright", nibble, (4 - bits).cast("int"))).otherwise(0)
    return F.concat_ws("/", F.lit("6"), F.substr(hex32, F.lit(1), whole), partial.cast("string"),
                       length.cast("string"))


def cidr_lpm(df: DataFrame, ip: str, nets: DataFrame, cidr: str, value_cols: Sequence[str],
             rank: str | None = None) -> DataFrame:
    """``df`` plus ``value_cols`` of the longest network of ``nets`` that contains ``ip``.

    Each distinct address is joined once, by hash, on (prefix length, masked address); only lengths
    that occur in ``nets`` (at most 33 + 129 values) are tried. Among equal lengths the highest
    ``rank`` wins. No range join, no pair enumeration.
    """
    has_v6 = F.contains(F.col(cidr), F.lit(":"))
    base = F.substring_index(F.col(cidr), "/", 1)
    given = F.when(F.contains(F.col(cidr), F.lit("/")), F.substring_index(F.col(cidr), "/", -1).cast("int"))
    length = F.coalesce(given, F.when(has_v6, 128).otherwise(32))
    table = nets.select(has_v6.alias("v6"), length.alias("len"), base.alias("base"), *value_cols,
                        *([F.col(rank).alias("_rank")] if rank else [F.lit(0).alias("_rank")]))
    lengths = {(r["v6"], r["len"]) for r in table.select("v6", "len").distinct().collect()}
    v4 = sorted(n for six, n in lengths if not six)
    v6 = sorted(n for six, n in lengths if six)
    keyed = table.where(~F.col("v6")).select(_v4_key(ipv4_number(F.col("base")), F.col("len")).alias("_k"),
                                             "len", "_rank", *value_cols)
    if v6:
        keyed = keyed.unionByName(table.where("v6").select(_v6_key(_ipv6_hex("base"), F.col("len")).alias("_k"),
                                                           "len", "_rank", *value_cols))
    best_net = keyed.groupBy("_k").agg(F.max(F.struct("len", "_rank", *value_cols)).alias("_net"))
    distinct = df.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct()
    probes = distinct.where(is_ipv4(F.col("_ip"))).select("_ip", F.explode(F.array(
        *[_v4_key(ipv4_number(F.col("_ip")), F.lit(n)) for n in v4] or [F.lit(None).cast("string")])).alias("_k"))
    if v6:
        six = distinct.where(F.contains(F.col("_ip"), F.lit(":"))).select("_ip", _ipv6_hex("_ip").alias("h"))
        probes = probes.unionByName(six.select("_ip", F.explode(F.array(
            *[_v6_key(F.col("h"), F.lit(n)) for n in v6])).alias("_k")))
    found = (probes.join(best_net, "_k").groupBy("_ip").agg(F.max("_net").alias("_net"))
             .select("_ip", *[F.col(f"_net.{c}").alias(c) for c in value_cols]))
    return df.join(found, F.col(ip) == F.col("_ip"), "left").drop("_ip")


def not_listed(df: DataFrame, value: str, entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Rows whose ``value`` is on no list entry (exact text or network); a missing value is kept."""
    is_net = F.contains(F.col(entry), F.lit("/"))
    exact = entries.where(~is_net).select(F.col(entry).alias("_e")).distinct()
    nets = entries.where(is_net).select(F.col(entry).alias("_cidr"), F.lit(True).alias("_hit"))
    kept = df.join(exact, F.col(value) == F.col("_e"), "left_anti")
    return cidr_lpm(kept, value, nets, "_cidr", ["_hit"]).where("_hit is null").drop("_hit")


def interval_lookup(points: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, lo: str, hi: str,
                    value_cols: Sequence[str], span_ms: int = DAY_MS) -> DataFrame:
    """``points`` plus ``value_cols`` of the newest interval ``[lo, hi)`` of the same key holding ``time``.

    An interval is copied to each time span it touches, so the join is an equi-join on (keys, span)
    and a hot address is spread over its spans. Open intervals (``hi`` null) end after the last point.
    Points are reduced to distinct (keys, time) first and joined back.
    """
    keys = list(keys)
    asked = points.select(*keys, F.col(time).alias("_t")).where("_t is not null").distinct()
    last = asked.agg(F.max("_t").alias("_last"))
    span = lambda c: F.floor(c / F.lit(span_ms)).cast("bigint")
    spans = (intervals.crossJoin(last)  # one-row side: the newest time asked for
             .withColumn("_end", F.least(F.coalesce(F.col(hi) - 1, F.col("_last")), F.col("_last")))
             .where(F.col(lo) <= F.col("_end"))
             .select(*keys, F.explode(F.sequence(span(F.col(lo)), span(F.col("_end")))).alias("_s"),
                     F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), *value_cols))
    hit = (asked.withColumn("_s", span(F.col("_t"))).join(spans, [*keys, "_s"])
           .where((F.col("_lo") <= F.col("_t")) & (F.col("_hi").isNull() | (F.col("_t") < F.col("_hi"))))
           .groupBy(*keys, "_t").agg(F.max(F.struct("_lo", *value_cols)).alias("_v")))
    joined = points.withColumn("_t", F.col(time)).join(hit, [*keys, "_t"], "left")
    return joined.select(*points.columns, *[F.col(f"_v.{c}").alias(c) for c in value_cols])


def fetch_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def first_match(left: DataFrame, left_id: str, handles: str, right: DataFrame, right_key: str,
                value_cols: Sequence[str]) -> DataFrame:
    """``left`` plus ``value_cols`` of the first of its ``handles`` (array order) found in ``right``."""
    tried = left.select(left_id, F.posexplode(handles).alias("_pos", "_h"))
    side = right.groupBy(F.col(right_key).alias("_h")).agg(F.max(F.struct(*value_cols)).alias("_v"))
    found = tried.join(side, "_h").groupBy(left_id).agg(F.min_by("_v", "_pos").alias("_v"))
    return (left.join(found, left_id, "left")
            .select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in value_cols]))
