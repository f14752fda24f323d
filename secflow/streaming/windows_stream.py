"""All rules over one stream: matches, sliding windows, late and future rows out of one stateful operator.

A window is worked out when the watermark has passed its time, so every row up to it is in, and a window's value doesn't depend on the order in
which files arrive: over the rows that came in time the stream gives what the batch operators of ``operators.sliding`` give.

State of a group (rule, window length, tenant, group) lies in time buckets, ``BUCKETS`` to a window. A bucket has
its sums (events, squared gaps, first time) and its rows (one for each ms); whole buckets leave a window by their sums, and only the
bucket at a window's edge is read. Counts, distinct values and the regularity of gaps are running sums over what enters and leaves:

* count: events in the window;
* distinct: values by their last sighting; a value leaves when its last sighting does;
* cv: events, time from the first to the last, and the squares of the gaps between them.

Event-time timers end a wait: one fires when the watermark passes the earliest row that waits, the last one when the window is empty,
which removes the group's state. Rows behind the watermark come out as ``late``, rows too far ahead of their receipt as ``future``,
and neither moves a window; rows of rules without a window come out as ``hit``. So rows in = in time + late + future.

Rows are added up by (group, value, ms) inside each Arrow batch before the shuffle. Redelivered events must be taken out before
(``detect_stream.redelivered_once``). Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from secflow.functions.scalars import FUTURE_SKEW_MS
from secflow.plans import detect
from secflow.plans.rules import RULES, Rule

BUCKETS = 64
YEAR_ONE_MS = -62_135_596_800_000
OUT = "kind string, rule_id string, window_ms bigint, tenant string, grp string, t bigint, rows bigint, n bigint, cv double, event_key string"
COLUMNS = [part.split(" ")[0] for part in OUT.split(", ")]
KEYS = ["rule_id", "window_ms", "measure", "tenant", "grp"]
#: What goes in: KEYS, the counted value, the time, whether it is ahead, how many rows, and the event of a rule without a window.
FED = "rule_id string, window_ms bigint, measure string, tenant string, grp string, val string, t bigint, ahead boolean, rows bigint, event_key string"
ALONE = "alone"
#: Groups that the events of a rule without a window are dealt into: a group of its own for each would be a call for each.
ALONE_GROUPS = 64


class Buckets:
    """Rows and sums by bucket, read from the state on demand and written back once."""

    def __init__(self, width: int, sums: Any, rows: Any):
        self.width, self.stored_sums, self.stored_rows = width, sums, rows
        self.sums: dict[int, list[int]] = {k[0]: list(v) for k, v in sums.iterator()}
        self.rows: dict[int, list] = {}
        self.touched: set[int] = set()

    def of(self, t: int) -> int:
        return t // self.width

    def open(self, b: int) -> list:
        if b not in self.rows:
            self.rows[b] = json.loads(self.stored_rows.getValue((b,))[0]) if b in self.sums and b not in self.touched else []
        return self.rows[b]

    def add(self, row: list, n: int, squares: int) -> None:
        """Appends a row (its time first), later than or at the time of all others."""
        b = self.of(row[0])
        self.open(b).append(row)
        total = self.sums.setdefault(b, [0, 0, row[0], squares])
        total[0] += n
        total[1] += squares
        self.touched.add(b)

    def drop(self, b: int) -> None:
        self.sums.pop(b)
        self.rows[b] = []
        self.touched.add(b)

    def first(self) -> int | None:
        return min(self.sums, default=None)

    def save(self) -> None:
        for b in self.touched:
            if b in self.sums:
                self.stored_sums.updateValue((b,), tuple(self.sums[b]))
                self.stored_rows.updateValue((b,), (json.dumps(self.rows[b], separators=(",", ":")),))
            elif self.stored_sums.containsKey((b,)):
                self.stored_sums.removeKey((b,))
                self.stored_rows.removeKey((b,))


class RuleWindows(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # size and squares: of what the window holds; last: the newest time worked out; timer: the next to fire
        self.total = handle.getValueState("total", "size bigint, squares bigint, last bigint, timer bigint")
        self.waiting = handle.getMapState("waiting", "b bigint", "rows string")
        self.sums = handle.getMapState("sums", "b bigint", "n bigint, squares bigint, first bigint, first_squares bigint")
        self.rows = handle.getMapState("rows", "b bigint", "rows string")
        self.seen = handle.getMapState("seen", "val string", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[2] == ALONE:
            for part in rows:
                yield self.side(key, part, "hit")
            return
        fed = pd.concat(list(rows), ignore_index=True)
        mark = timerValues.getCurrentWatermarkInMs()
        ahead = fed["ahead"].astype(bool)
        late = ~ahead & (fed["t"] < mark)
        for kind, which in (("future", ahead), ("late", late)):
            if which.any():
                yield self.side(key, fed[which], kind)
        fed = fed[~ahead & ~late]
        if not len(fed):
            return
        width = max(1, int(key[1]) // BUCKETS)
        for b, part in fed.groupby(fed["t"] // width):
            held = json.loads(self.waiting.getValue((int(b),))[0]) if self.waiting.containsKey((int(b),)) else []
            held += [[int(t), v if isinstance(v, str) else None, int(n)] for t, v, n in zip(part["t"], part["val"], part["rows"], strict=True)]
            self.waiting.updateValue((int(b),), (json.dumps(held, separators=(",", ":")),))
        size, squares, last, timer = self.total.get() if self.total.exists() else (0, 0, None, None)
        due = int(fed["t"].min()) + 1
        if timer is None or due < timer:
            self.handle.registerTimer(due)
            timer = due
        self.total.update((size, squares, last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.total.exists():
            return
        mark = timerValues.getCurrentWatermarkInMs()
        window, width = int(key[1]), max(1, int(key[1]) // BUCKETS)
        size, squares, last, timer = self.total.get()
        if timer is None or timer > mark:  # an earlier timer has done this one's work
            return
        due, ahead = self.taken(mark, width)
        walk = Walk(key[2], window, Buckets(width, self.sums, self.rows), self.seen, size, squares, last)
        out = [(key, *walk.step(t, members)) for t, members in due]
        if ahead is None and walk.last + window < mark:
            for state in (self.total, self.waiting, self.sums, self.rows, self.seen):
                state.clear()
        else:
            walk.save()
            timer = ahead + 1 if ahead is not None else walk.last + window + 1
            self.handle.registerTimer(timer)
            self.total.update((walk.size, walk.squares, walk.last, timer))
        if out:
            yield pd.DataFrame([("window", k[0], int(k[1]), k[3], k[4], t, rows, n, cv, None) for k, t, rows, n, cv in out], columns=COLUMNS)

    def taken(self, mark: int, width: int) -> tuple[list[tuple[int, list]], int | None]:
        """The rows before the watermark by time, taken out of those that wait, and the earliest time left."""
        due: dict[int, list] = {}
        left: int | None = None
        for b in sorted(k[0] for k in self.waiting.keys()):
            if b * width >= mark:
                left = min((x[0] for x in json.loads(self.waiting.getValue((b,))[0])), default=None) if left is None else left
                break
            held = json.loads(self.waiting.getValue((b,))[0])
            stay = [x for x in held if x[0] >= mark]
            for t, val, n in held:
                if t < mark:
                    due.setdefault(t, []).append((val, n))
            if stay:
                self.waiting.updateValue((b,), (json.dumps(stay, separators=(",", ":")),))
                left = min(x[0] for x in stay)
            else:
                self.waiting.removeKey((b,))
        return sorted(due.items()), left

    def side(self, key, rows: pd.DataFrame, kind: str) -> pd.DataFrame:
        grp = None if key[2] == ALONE else key[4]
        return pd.DataFrame({"kind": kind, "rule_id": key[0], "window_ms": int(key[1]), "tenant": key[3], "grp": grp, "t": rows["t"].astype("Int64"), "rows": rows["rows"].astype("int64"),
                             "n": pd.Series([None] * len(rows), dtype="Int64", index=rows.index), "cv": pd.Series([None] * len(rows), dtype="float64", index=rows.index),
                             "event_key": rows["event_key"]})[COLUMNS]

    def close(self) -> None:
        pass


class Walk:
    """The running sums of one group, moved from one time to the next."""

    def __init__(self, measure: str, window: int, buckets: Buckets, seen: Any, size: int, squares: int, last: int | None):
        self.measure, self.window, self.buckets, self.stored = measure, window, buckets, seen
        self.size, self.squares, self.last = size, squares, last
        self.known: dict[str, int | None] = {}

    def step(self, t: int, members: list) -> tuple[int, int, int, float | None]:
        """Moves the window to ``t`` with what was seen then: (t, rows, n, cv)."""
        self.leave(t - self.window)
        rows = sum(n for _, n in members)
        if self.measure == "distinct":
            for value in dict.fromkeys(v for v, _ in members):
                self.size += self.sighting(value) is None
                self.known[value] = t
                self.buckets.add([t, value], 0, 0)
        else:
            gap = t - self.last if self.last is not None and t - self.last <= self.window else 0
            self.size += rows
            self.squares += gap * gap
            self.buckets.add([t, rows, gap * gap], rows, gap * gap)
        self.last = t
        return t, rows, self.size, self.regularity(t) if self.measure == "cv" else None

    def sighting(self, value: str) -> int | None:
        if value not in self.known:
            self.known[value] = self.stored.getValue((value,))[0] if self.stored.containsKey((value,)) else None
        return self.known[value]

    def leave(self, low: int) -> None:
        """Takes out what lies before ``low``."""
        while (b := self.buckets.first()) is not None and b * self.buckets.width < low:
            total = self.buckets.sums[b]
            whole = (b + 1) * self.buckets.width <= low
            if whole and self.measure != "distinct":
                self.size, self.squares = self.size - total[0], self.squares - total[1]
                self.buckets.drop(b)
                continue
            rows = self.buckets.open(b)
            gone = next((i for i, x in enumerate(rows) if x[0] >= low), len(rows))
            for x in rows[:gone]:
                if self.measure != "distinct":
                    self.size, self.squares = self.size - x[1], self.squares - x[2]
                    total[0], total[1] = total[0] - x[1], total[1] - x[2]
                elif self.sighting(x[1]) == x[0]:  # not seen again since
                    self.size -= 1
                    self.known[x[1]] = None
            if gone == len(rows):
                self.buckets.drop(b)
                continue
            if gone:
                self.buckets.rows[b] = rows[gone:]
                total[2], total[3] = rows[gone][0], rows[gone][2] if self.measure != "distinct" else 0
                self.buckets.touched.add(b)
            return

    def regularity(self, t: int) -> float | None:
        """Deviation over mean of the gaps between the window's events, as ``sliding_cv`` defines it."""
        head = self.buckets.sums[self.buckets.first()]
        gaps = self.size - 1
        if self.size < 3 or t == head[2]:
            return None
        mean = (t - head[2]) / gaps
        return max((self.squares - head[3]) / gaps - mean * mean, 0.0) ** 0.5 / mean

    def save(self) -> None:
        self.buckets.save()
        for value, t in self.known.items():
            if t is not None:
                self.stored.updateValue((value,), (t,))
            elif self.stored.containsKey((value,)):
                self.stored.removeKey((value,))


def ahead(time: Column, received: Column) -> Column:
    return F.coalesce(time > received + FUTURE_SKEW_MS, F.lit(False))


def fed(events: DataFrame, rules: Sequence[Rule] = RULES, mode: str = "clamp") -> DataFrame:
    """Rule matches as rows of FED. A time a little ahead of receipt counts as receipt, but for the regularity of gaps."""
    rows = detect.matches(events, rules, mode, received=True)
    received, windowed = F.col("received_ms"), F.col("grp").isNotNull()
    early = ahead(F.col("t"), received)
    t = F.when(windowed & ~early & (F.col("measure") != "cv"), F.least("t", received)).otherwise(F.col("t"))
    rows = rows.select("rule_id", "window_ms", F.when(windowed, F.col("measure")).otherwise(ALONE).alias("measure"), "tenant",
                       F.coalesce("grp", F.pmod(F.xxhash64("event_key"), F.lit(ALONE_GROUPS)).cast("string")).alias("grp"), "val", t.alias("t"), (early & windowed).alias("ahead"),
                       F.lit(1).cast("bigint").alias("rows"), F.when(~windowed, F.col("event_key")).alias("event_key"))
    return rows.mapInPandas(added_up, FED)


def added_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one group, value and ms as one, within a batch."""
    names = [part.split(" ")[0] for part in FED.split(", ")]
    for batch in batches:
        if len(batch):
            batch["t"] = batch["t"].astype("Int64")
            yield batch.groupby([c for c in names if c != "rows"], dropna=False, sort=False, as_index=False)["rows"].sum()[names]


def rule_windows(events: DataFrame, rules: Sequence[Rule] = RULES, lateness: str = "10 minutes", mode: str = "clamp") -> DataFrame:
    """The stream of OUT rows of a stream of events: ``hit``, ``window``, ``late`` and ``future``.

    ``rows`` is what a row stands for. All events move the watermark, whether a rule matches them or not, but for those ahead
    of their receipt. Its column is dropped: rows behind it then reach the operator, which names them, instead of being dropped without a word."""
    ts = F.timestamp_millis(F.when(~ahead(F.col("time"), F.col("siem.received_ms")), F.col("time")))
    marked = events.withColumn("_ts", ts).withWatermark("_ts", lateness)
    # A filter by class alone would be moved below the watermark, where events of other classes would not move it: the class reads the time.
    marked = marked.withColumn("class_uid", F.when(F.unix_millis("_ts") < YEAR_ONE_MS, None).otherwise(F.col("class_uid"))).drop("_ts")
    return fed(marked, rules, mode).groupBy(*KEYS).transformWithStateInPandas(RuleWindows(), OUT, "Append", "EventTime")


def replayed(parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], path: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """What a stream makes of ``parts`` that arrive one after another: each is appended to a folder, and the query goes on from its
    checkpoint. With ``each`` the batches go to that function and nothing is returned."""
    spark, provider = parts[0].sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            part.write.mode("append").parquet(f"{path}/in")
            made = build(spark.readStream.schema(parts[0].schema).parquet(f"{path}/in"))
            sink = made.writeStream.foreachBatch(each) if each else made.writeStream.format("parquet").option("path", f"{path}/out")
            sink.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return None if each else spark.read.schema(made.schema).parquet(f"{path}/out")
