"""Sharding by histogram sort.

Documents are ordered by (checksum of the text, id). The splitters between the shards are found by
counting: each round counts the exact bytes and rows below candidate boundaries over the whole table,
and narrows the range in which a splitter must lie until it is within the tolerance. Only counts reach
the driver, at most ``PROBES`` in a round. Then the rows are exchanged once.

The law is ``bytes``: shard sizes are near equal. Equal texts are neighbours in the order, so a group of
equal texts stays in one shard unless the tolerance forces a cut through it.

Defined cases: a null text is empty; rows with an equal text and id lie together, in any order among
themselves; a null id sorts with the smallest id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from secflow.llm.common import stage, whole_text

N_SHARDS = 24
#: Candidate boundaries that a round counts, over all splitters that are still open.
PROBES = 4096
#: How far a splitter may be from its place, as a part of one shard's bytes.
TOLERANCE = 0.004
#: Ranges within a shard, so that numbering the rows of a shard is not one task.
PARTS = 4
#: Keys are checksum * 2^64 + (id - smallest id).
UNIT = 1 << 64
END = 1 << 96


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = whole_text(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))


def number(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def below(cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or below the row's key: a binary search as an expression."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("key") < number(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def step_of(lo: int, hi: int, probes: int) -> int:
    """Distance of the probes between two keys: whole checksums where that narrows the range, because
    a boundary between checksums doesn't cut a group of equal texts."""
    step = -(-(hi - lo) // probes)
    return -(-step // UNIT) * UNIT if lo % UNIT == 0 and hi - lo > UNIT else step


def count_below(rows: DataFrame, ranges: list[tuple[int, int]], known: dict[int, tuple[int, int]]) -> None:
    """Adds to ``known`` the exact (bytes, rows) below the probes of disjoint, sorted key ranges."""
    steps = [step_of(lo, hi, max(2, PROBES // len(ranges))) for lo, hi in ranges]
    edges = [x for r in ranges for x in r]
    at = below(edges)
    inside = rows.withColumn("_at", at).where("_at % 2 = 1").withColumn("_r", F.expr("(_at - 1) div 2").cast("int"))
    pick = lambda values: F.element_at(F.array(*[number(v) for v in values]), F.col("_r") + 1)
    inside = inside.withColumn("_lo", pick([lo for lo, _ in ranges])).withColumn("_step", pick(steps))
    probe = F.expr("(key - _lo) div _step")  # exact, unlike a quotient of decimals
    found = inside.groupBy("_r", probe.alias("p")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    sums: dict[int, dict[int, tuple[int, int]]] = {}
    for r in found:
        sums.setdefault(r["_r"], {})[r["p"]] = (r["b"], r["n"])
    for i, (lo, hi) in enumerate(ranges):
        b, n = known[lo]
        for p in sorted(sums.get(i, {})):
            start = lo + p * steps[i]
            known[start] = (b, n)
            b, n = b + sums[i][p][0], n + sums[i][p][1]
            if start + steps[i] < hi:
                known[start + steps[i]] = (b, n)


def splitters(rows: DataFrame, known: dict[int, tuple[int, int]], total: int, n_parts: int, tolerance: int) -> list[int]:
    """Keys of the ``n_parts - 1`` boundaries; ``known`` keeps what was counted."""
    goals = [total * i // n_parts for i in range(1, n_parts)]
    while True:
        keys = sorted(known)
        sums = [known[k][0] for k in keys]
        open_ranges = set()
        for goal in goals:
            at = min(bisect_right(sums, goal) - 1, len(keys) - 2)
            lo, hi = keys[at], keys[at + 1]
            if min(goal - sums[at], sums[at + 1] - goal) > tolerance and hi - lo > 1:
                open_ranges.add((lo, hi))
        if not open_ranges:
            return [min(keys, key=lambda k, g=goal: (abs(known[k][0] - g), k)) for goal in goals]
        count_below(rows, sorted(open_ranges), known)


def assign(docs: DataFrame, n_shards: int = N_SHARDS, tolerance: float = TOLERANCE, parts: int = PARTS,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): near equal bytes in each shard, slots gapless from 0."""
    rows = stage(sized(docs, id_col, text_col))
    total, n, first_id = rows.agg(F.sum("size"), F.count(F.lit(1)), F.min("doc_id")).first()
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    from_id = F.coalesce(F.col("doc_id").cast("decimal(38,0)") - number(first_id or 0), number(0))
    rows = rows.withColumn("key", (F.col("text_crc32").cast("decimal(18,0)") * number(UNIT).cast("decimal(20,0)")).cast("decimal(38,0)") + from_id)
    rows = rows.withColumn("key", F.col("key").cast("decimal(38,0)"))
    known = {0: (0, 0), END: (total, n)}
    ends = splitters(rows, known, total, n_shards, int(total * tolerance / n_shards))
    inner = splitters(rows, known, total, n_shards * parts, int(total * 0.2 / (n_shards * parts)))
    cuts = sorted({k for k in ends + inner if 0 < k < END})
    shard, rows_below = [bisect_right(ends, k) for k in [0, *cuts]], [known[k][1] for k in [0, *cuts]]
    first: dict[int, int] = {}
    for s, c in zip(shard, rows_below, strict=True):
        first.setdefault(s, c)
    look = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_part") + 1)
    offset = [c - first[s] for s, c in zip(shard, rows_below, strict=True)]
    within = W.partitionBy("_part").orderBy("key")
    return (rows.withColumn("_part", below(cuts))
            .withColumn("slot", F.row_number().over(within) - 1 + look(offset, "long"))
            .select("doc_id", "size", "text_crc32", look(shard, "int").alias("shard"), "slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """The documents themselves in one folder for each shard, by the placement of ``assign``."""
    placed = assign(docs, n_shards).select("doc_id", "text_crc32", "shard").dropDuplicates(["doc_id", "text_crc32"])
    rows = docs.withColumn("_crc", F.crc32(whole_text("text").cast("binary")))
    joined = rows.join(placed, rows["doc_id"].eqNullSafe(placed["doc_id"]) & (rows["_crc"] == placed["text_crc32"]))
    joined.select(*[rows[c] for c in docs.columns], placed["shard"].alias("_shard")).write.partitionBy("_shard").parquet(path)
