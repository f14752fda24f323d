"""Which network holds an address: nested networks cut into segments once, addresses found among them by one sort.

Networks of a table are nested or apart, never crossing. Sorted by where they begin and end, a running depth says how
many are open, and the network in force behind an end is the last one that was opened at the depth that is left: so the
deepest network of every stretch comes out of two windows over one exchange, without a stack or a range join.

A network belongs to the bucket of its first ``LEVELS`` bits, the most that its length allows (16, 8 or 0 of an IPv4 address). An
address is looked up in the one bucket of each level: its rows are mixed with the bucket's segments by position, and the last segment
before an address is the one that holds it. The deepest level that has one counts. That is three rows for an IPv4 address and four
for an IPv6 one, however many lengths the networks have. Only distinct addresses are looked up; joined back, at most ``FEW`` addresses are all broadcast;
of more, those that hold more than one row in ``HOT_PARTS`` of all are broadcast (there are fewer than that many), the others are exchanged.

Defined cases: text that is no address or no network is in none and holds none; host bits of a network are ignored; a
network without a length is one address; networks of one version hold no addresses of the other; among equal networks
the one that ranks highest counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secflow.functions.predicates import ipv4_number, is_ipv4
from secflow.operators.joins import _ipv6_hex
from secflow.session import cut_lineage

#: Bits of a bucket by level, for IPv4 and IPv6.
LEVELS = {False: (16, 8, 0), True: (48, 32, 16, 0)}
HOT_PARTS = 1000
#: Found keys that are broadcast whole, so that no row is exchanged for them.
FEW = 50_000
PLACE = ["table", "six", "level", "bucket"]


def address_hex(text: Column) -> Column:
    """8 or 32 hexadecimal digits of an address; null for other text. Only IPv6 text goes through Arrow."""
    four = F.lower(F.lpad(F.hex(ipv4_number(text)), 8, "0"))
    return F.coalesce(four, F.lower(_ipv6_hex(F.when(~is_ipv4(text) & F.contains(text, F.lit(":")), text))))


def _end(digits: Column, length: Column, last: bool) -> Column:
    """First or last address of a network."""
    whole, bits = F.floor(length / 4).cast("int"), (length % 4).cast("int")
    nibble = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    size = F.call_function("shiftleft", F.lit(1), 4 - bits)
    low = nibble - nibble % size
    part = F.when(bits > 0, F.lower(F.hex((low + size - 1 if last else low).cast("bigint")))).otherwise("")
    return F.rpad(F.concat(F.substr(digits, F.lit(1), whole), part), F.length(digits), F.lit("f" if last else "0"))


def _level(six: Column, length: Column) -> Column:
    steps = {v: F.coalesce(*[F.when(length >= n, n) for n in LEVELS[v]]) for v in LEVELS}
    return F.when(six, steps[True]).otherwise(steps[False])


def segments(nets: DataFrame, cidr: str, value_cols: Sequence[str], rank: Column | None = None, table: str | Column = "") -> DataFrame:
    """The stretches of address space that ``nets`` make: (table, six, level, bucket, pos, side, val).

    From ``pos`` on (side 0, the beginning of a network) or behind it (side 2, an end) the network in force is ``val``, null for none.
    To be made once for a table and used for many lookups."""
    text = F.trim(F.col(cidr))
    base, tail = F.substring_index(text, "/", 1), F.when(F.contains(text, F.lit("/")), F.substring_index(text, "/", -1))
    parsed = nets.select((F.lit(table) if isinstance(table, str) else table).alias("table"), address_hex(base).alias("h"), F.contains(base, F.lit(":")).alias("six"), tail.alias("_tail"), *value_cols, (rank if rank is not None else F.lit(0)).alias("_rank"))
    most = F.when(F.col("six"), 128).otherwise(32)
    length = F.when(F.col("_tail").isNull(), most).otherwise(F.when(F.col("_tail").rlike(r"\A[0-9]{1,3}\z"), F.col("_tail")).try_cast("int"))
    valid = parsed.withColumn("len", length).where(F.col("h").isNotNull() & F.col("len").between(0, most))
    best = (valid.select("table", "six", "len", _end(F.col("h"), F.col("len"), False).alias("lo"), _end(F.col("h"), F.col("len"), True).alias("hi"), "_rank", *value_cols)
            .groupBy("table", "six", "len", "lo", "hi").agg(F.max(F.struct("_rank", *value_cols)).alias("_v")))
    placed = best.select("table", "six", _level(F.col("six"), F.col("len")).alias("level"), "len", "lo", "hi", F.struct(*[F.col(f"_v.{c}").alias(c) for c in value_cols]).alias("_v"))
    placed = placed.withColumn("bucket", F.substr("lo", F.lit(1), (F.col("level") / 4).cast("int")))
    ends = placed.select(*PLACE, F.explode(F.array(
        F.struct(F.col("lo").alias("pos"), F.lit(0).alias("side"), F.col("len").alias("turn"), F.lit(1).alias("by"), F.col("_v").alias("val")),
        F.struct(F.col("hi").alias("pos"), F.lit(2).alias("side"), (-F.col("len")).alias("turn"), F.lit(-1).alias("by"), F.lit(None).cast(placed.schema["_v"].dataType).alias("val"))
    )).alias("e")).select(*PLACE, "e.*")
    order = ["pos", "side", "turn"]
    walk = Window.partitionBy(*PLACE).orderBy(*order)
    deep = ends.withColumn("depth", F.sum("by").over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    in_force = F.last("val", ignorenulls=True).over(Window.partitionBy(*PLACE, "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # of several changes at one place the last one counts
    more = F.lead(F.struct("pos", "side")).over(walk)
    return (deep.select(*PLACE, *order, in_force.alias("val"), more.eqNullSafe(F.struct("pos", "side")).alias("_more"))
            .where(~F.col("_more")).select(*PLACE, "pos", "side", "val"))


def located(addresses: DataFrame, ip: str, cut: DataFrame) -> DataFrame:
    """(ip, table, val) for each of ``addresses`` (distinct) that a network of a table of ``cut`` holds; with a column
    ``table`` an address is looked up in that table only."""
    own = "table" in addresses.columns
    known = addresses.select(F.col(ip).alias("_ip"), address_hex(F.col(ip)).alias("pos"), *(["table"] if own else [])).where("pos is not null").withColumn("six", F.length("pos") > 8)
    levels = F.when(F.col("six"), F.array(*[F.lit(n) for n in LEVELS[True]])).otherwise(F.array(*[F.lit(n) for n in LEVELS[False]]))
    asked = known.withColumn("level", F.explode(levels))
    if not own:
        asked = asked.crossJoin(F.broadcast(cut.select("table").distinct()))  # one row for each table of networks
    asked = asked.withColumn("bucket", F.substr("pos", F.lit(1), (F.col("level") / 4).cast("int"))).withColumn("side", F.lit(1))
    mixed = cut.unionByName(asked, allowMissingColumns=True)
    # a struct around the value, so that a hole counts as well
    held = F.last(F.when(F.col("side") != 1, F.struct("val")), ignorenulls=True).over(Window.partitionBy(*PLACE).orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = mixed.withColumn("_held", held["val"]).where("_ip is not null and _held is not null")
    return found.groupBy(F.col("_ip").alias("ip"), "table").agg(F.max_by("_held", "level").alias("val"))


def joined_back(df: DataFrame, on: Column, found: DataFrame, key: str, count: str, value_cols: Sequence[str]) -> DataFrame:
    """``df`` with ``value_cols`` of ``found`` (one row for each ``key``) where ``on`` is the key; ``count`` says how many rows ask for it."""
    total, keys = found.agg(F.sum(count), F.count(F.lit(1))).first()
    hot = F.col(count) > max(1000, (total or 0) // HOT_PARTS)
    names = df.columns
    rows = df.withColumn("_on", on)
    side = lambda part: found.where(part).select(F.col(key).alias("_key"), F.struct(*value_cols).alias("_found"))
    if keys <= FEW:
        out = rows.join(F.broadcast(side(F.lit(True))), F.col("_on") == F.col("_key"), "left")
        return out.select(*names, *[F.col(f"_found.{c}").alias(c) for c in value_cols])
    first = rows.join(F.broadcast(side(hot)), F.col("_on") == F.col("_key"), "left").drop("_key").withColumnRenamed("_found", "_first")
    # rows without an address, and those of hot ones, ask for nothing more: they are spread by the number of their part, which a repeated task has again
    nothing = F.concat(F.lit("-"), F.spark_partition_id().cast("string"))
    both = first.withColumn("_rest", F.when(F.col("_first").isNull(), F.coalesce("_on", nothing)).otherwise(nothing))
    out = both.join(side(~hot), F.col("_rest") == F.col("_key"), "left")
    return out.select(*names, *[F.coalesce(F.col(f"_first.{c}"), F.col(f"_found.{c}")).alias(c) for c in value_cols])


def network_lookup(df: DataFrame, ip: str, cut: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    """``df`` plus ``value_cols`` of the deepest network of ``cut`` (of one table) that holds ``ip``."""
    asked = df.groupBy(F.col(ip).alias("_ip")).agg(F.count(F.lit(1)).alias("_n")).where("_ip is not null")
    found = located(asked, "_ip", cut).select(F.col("ip").alias("_a"), *[F.col(f"val.{c}").alias(c) for c in value_cols])
    counted = cut_lineage(found.join(asked, F.col("_a") == F.col("_ip")).drop("_ip"))
    return joined_back(df, F.col(ip), counted, "_a", "_n", value_cols)
