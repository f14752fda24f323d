"""Cooldown: keep an event only when the last kept event of its key is at least ``gap`` old.

What is kept depends on what was kept before, so it is a walk, not a window function. To keep a hot
key out of a single task the walk is done per (key, time block): a block reports, for every possible
first event, where its walk ends. That is a step function with few steps, because walks that start
differently meet soon. The functions are applied in block order per key (small rows), and each block
is then walked once more from its true start. A key of one block is only walked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secflow.operators.sliding import HOUR_MS, _blocked


def _next_kept(times: np.ndarray, gap: int) -> np.ndarray:
    return np.searchsorted(times, times + gap, side="left")


def _walk_ends(times: np.ndarray, gap: int) -> np.ndarray:
    """Index of the last kept event for a walk starting at each event (pointer doubling)."""
    size = len(times)
    jump = np.append(_next_kept(times, gap), size)
    end = np.arange(size + 1)
    while True:
        ahead = jump[:size] < size
        if not ahead.any():
            return end[:size]
        end[:size] = np.where(ahead, end[jump[:size]], end[:size])
        jump = jump[jump]


def _steps(times: np.ndarray, block_start: int, gap: int) -> list[tuple[int, int]]:
    """(largest first event, exit time) pairs: the walk function of the block, run-length encoded."""
    entry = int(np.searchsorted(times, block_start + gap, side="left")) + 1
    ends = times[_walk_ends(times, gap)][:entry]
    last_of_run = np.append(ends[1:] != ends[:-1], True)
    return [(int(a), int(b)) for a, b in zip(times[:entry][last_of_run], ends[last_of_run], strict=True)]


def _summaries(batches: Iterator[pd.DataFrame], keys: list[str], width: int, gap: int) -> Iterator[pd.DataFrame]:
    """The walk function of each block of sorted rows; ``_new`` marks where a block begins. Holds the times of one block."""
    head, times = None, []

    def done() -> pd.DataFrame:
        steps = _steps(np.concatenate(times), int(head["_blk"].iloc[0]) * width, gap)
        rows = head.iloc[[0] * len(steps)].reset_index(drop=True)
        return rows.assign(first_max=[s[0] for s in steps], exit_t=[s[1] for s in steps])

    for batch in batches:
        out, ordered = [], batch["t"].to_numpy()
        starts = np.flatnonzero(batch["_new"].to_numpy())
        first = int(starts[0]) if len(starts) else len(batch)
        if first:
            times.append(ordered[:first])
        for at, until in zip(starts, [*starts[1:], len(batch)]):
            if head is not None:
                out.append(done())
            head, times = batch[[*keys, "_blk"]].iloc[[at]], [ordered[at:until]]
        if out:
            yield pd.concat(out, ignore_index=True)
    if head is not None:
        yield done()


def _entries(batches: Iterator[pd.DataFrame], keys: list[str], gap: int) -> Iterator[pd.DataFrame]:
    """Last kept time before each block, by applying the walk functions of a key in block order. Rows are sorted; ``_new`` marks where a key
    begins, ``_next`` where a block does."""
    last, before, met = None, None, False
    for batch in batches:
        at, told = [], []
        for i, (new, block, first_max, exit_t) in enumerate(zip(*[batch[c].array for c in ("_new", "_next", "first_max", "exit_t")], strict=True)):
            if new:
                last = None
            if block:
                before, met = last, False
                at.append(i)
                told.append(before)
            if not met and (before is None or first_max >= before + gap):
                last, met = int(exit_t), True
        if at:
            yield batch[[*keys, "_blk"]].iloc[at].reset_index(drop=True).assign(last_t=pd.array(told, dtype="Int64"))


def _walks(batches: Iterator[pd.DataFrame], keys: list[str], gap: int) -> Iterator[pd.DataFrame]:
    """The kept rows of sorted blocks, each walked from the last kept time before it."""
    last = None
    for batch in batches:
        kept = []
        for i, (new, t, before) in enumerate(zip(batch["_new"].tolist(), batch["t"].tolist(), batch["last_t"].array, strict=True)):
            if new:
                last = None if pd.isna(before) else int(before)
            if last is None or t >= last + gap:
                last = t
                kept.append(i)
        if kept:
            yield batch[[*keys, "t"]].iloc[kept]


def cooldown(df: DataFrame, keys: Sequence[str], gap_ms: int, time: str = "t",
             width: int | None = None) -> DataFrame:
    """(keys, t) of the kept times. Exact for any skew; tasks see one block of one key at a time.

    Rows are sorted by block and streamed: there is no call for each block, since most keys have few times. Walk functions are only
    worked out for keys of more than one block."""
    keys, width = list(keys), width or max(24 * gap_ms, HOUR_MS)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    key_ddl = ", ".join(f"`{k}` {spark_types[k]}" for k in keys)
    times = df.groupBy(*keys, F.col(time).cast("bigint").alias("t")).agg(F.lit(1).alias("_one")).drop("_one")
    base = _blocked(times, keys, "t", F.lit(width))
    begins = F.lag("t").over(Window.partitionBy(*keys, "_blk").orderBy("t")).isNull()
    several = base.groupBy(*keys).agg(F.min("_blk").alias("_lo"), F.max("_blk").alias("_hi")).where("_lo < _hi").select(*keys)
    steps = (base.join(several, keys, "left_semi").withColumn("_new", begins)
             .mapInPandas(lambda b: _summaries(b, keys, width, gap_ms), f"{key_ddl}, _blk bigint, first_max bigint, exit_t bigint"))
    walk = Window.partitionBy(*keys).orderBy("_blk", "first_max")
    entry = (steps.withColumn("_was", F.lag("_blk").over(walk)).withColumn("_new", F.col("_was").isNull())
             .withColumn("_next", F.col("_new") | (F.col("_was") != F.col("_blk"))).drop("_was")
             .mapInPandas(lambda b: _entries(b, keys, gap_ms), f"{key_ddl}, _blk bigint, last_t bigint"))
    return (base.join(entry, [*keys, "_blk"], "left").withColumn("_new", begins).select(*keys, "t", "last_t", "_new")
            .mapInPandas(lambda b: _walks(b, keys, gap_ms), f"{key_ddl}, t bigint"))
