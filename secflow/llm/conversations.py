"""Conversation structure repair by secondary-sorted streaming.

Rows are classified with built-in functions (role initial, fault), repartitioned by conversation and sorted by turn
inside the partitions. ``mapInPandas`` streams them and carries, across Arrow batches, the state of one
dynamic programme: for each place in the grammar ``(s?(ua)+)?`` the least cost, the order of the edit texts among
equal costs, and the running digest of the repaired rows. A row's step depends only on the carried state and the
row's class, so steps are worked out once and remembered. Each row leaves one 32-bit backpointer. The texts are never held.

A conversation's backpointers are traced back when it ends. Of a giant conversation they are spilled: every ``CHUNK``
rows go out as one compressed row to the shared folder, and a second job streams those chunks backwards and writes
the edits, so memory doesn't follow the length of a conversation. What remains per conversation is the ``audit`` itself, a letter
for each edit.

Defined cases: null roles and texts, and null ids and turns in the checksum, are one space; null turns come first;
rows of equal turn are ordered by role and text, equal ones as one first occurrence and its repetitions; rows with a null
``conv_id`` are one conversation; an empty role has no initial and can't be kept; a conversation whose rows all go has zeros, an empty
audit and the digest of nothing; no rows give no rows. Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from secflow.llm.common import stage

SPACE = " \t\n\x0b\x0c\r"
#: What a checksum's remainder by DAMAGE_OF does to a row.
DAMAGE_OF = 20
DROP, EMPTY, CUT, REPEAT, RENAME = range(5)
#: Faults of a row; the first that holds counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of edits.
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1
#: Places in the grammar: nothing yet, after s, after u, after a. What may come next, where that leads, what an insertion adds.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
TURN = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
LEGAL = ("su", "ua", "au")
EDITS = "DKR"
#: A place that costs more than the cheapest by this can't be on a cheapest path: from any place, deleting an s and two
#: insertions lead to what any other place can still become.
FAR = DELETE_COST + 3 * INSERT_COST
#: Rows whose backpointers a task holds at a time.
CHUNK = 1 << 16

OUT = ("conv_id string, chunk long, data binary, place int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, "
       "cost long, audit string, repaired_sha256 string")
NAMES = [part.split(" ")[0] for part in OUT.split(", ")]
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive): the rows after damage; dropped ones stay, not alive, for their id."""
    what = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % DAMAGE_OF
    text = F.when(what == EMPTY, "").when(what == CUT, F.regexp_replace(spaced("text"), "[.!?]", "")).when(what == DROP, "").otherwise(spaced("text"))
    role = F.when(what == RENAME, "user").otherwise(spaced("role"))
    times = F.array_repeat(F.lit(0), F.when(what == REPEAT, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (what != DROP).alias("alive"), F.explode(times).alias("_n")).drop("_n")


def classified(rows: DataFrame) -> DataFrame:
    """Rows with ``seen`` (its number among rows of equal role and text) and ``fault``, partitioned by conversation."""
    within = W.partitionBy("conv_id", "alive", "role", "text").orderBy("turn")
    left = F.rtrim(F.col("text"), F.lit(SPACE))
    numbered = rows.repartition("conv_id").withColumn("seen", F.row_number().over(within))
    fault = F.when(left == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.right(left, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return numbered.withColumn("fault", fault)


Best = tuple[int, int] | None


@lru_cache(maxsize=1 << 16)
def step(now: tuple[Best, ...], initial: str, fault: int) -> tuple[tuple[Best, ...], int, int, tuple[tuple[int, int, int, int], ...]]:
    """One row's step. ``now`` has for each place (cost above the cheapest, order of its edits among the places).

    Returns the same after the row, what the cheapest rose by, the backpointer, and (place, place before, insertions, edit)
    for each place reached. Edits of a row end the texts that are compared, so none is the beginning of another."""
    best: dict[int, tuple] = {}
    for place, value in enumerate(now):
        if value is None:
            continue
        at = place
        for inserted in range(3):
            moves = [("D", at, DELETE_COST)]
            if fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED_COST if fault == TRUNCATED else 0
                if initial in NEXT[at]:
                    moves.append(("K", NEXT[at][initial], extra))
                moves.append(("R", TURN[at], REROLE_COST + extra))
            for edit, to, cost in moves:
                found = (value[0] + INSERT_COST * inserted + cost, (value[1], "I" * inserted + edit), place, inserted, edit)
                if to not in best or found < best[to]:
                    best[to] = found
            at = TURN[at]
    low = min(x[0] for x in best.values())
    best = {to: x for to, x in best.items() if x[0] - low <= FAR}
    order = {to: i for i, to in enumerate(sorted(best, key=lambda to: best[to][1]))}
    after = tuple((best[to][0] - low, order[to]) if to in best else None for to in range(4))
    links = tuple((to, x[2], x[3], EDITS.index(x[4])) for to, x in sorted(best.items()))
    packed = 0
    for to, place, inserted, edit in links:
        packed |= (place | inserted << 2 | edit << 4) << 8 * to
    return after, low, packed, links


def traced(pointers: array, place: int) -> tuple[str, int]:
    """The edits of a run of rows that ends at ``place``, and the place where it begins."""
    out = []
    for packed in reversed(pointers):
        link = packed >> 8 * place & 255
        out.append("I" * (link >> 2 & 3) + EDITS[link >> 4])
        place = link & 3
    return "".join(reversed(out)), place


class Walk:
    """The carried state of one conversation."""

    def __init__(self, conv: str | None, chunk: int):
        self.conv, self.most = conv, chunk
        self.now: tuple[Best, ...] = ((0, 0), None, None, None)
        self.shas = [hashlib.sha256(), None, None, None]
        self.pointers, self.chunks = array("I"), 0
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> dict | None:
        """Takes a row in; a full chunk of backpointers is returned."""
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.now, rise, packed, links = step(self.now, initial, fault)
        self.cost += rise
        shas = [None] * 4
        for to, place, inserted, edit in links:
            shas[to] = self.grown(place, inserted, None if EDITS[edit] == "D" else (role if EDITS[edit] == "K" else "", text))
        self.shas = shas
        self.pointers.append(packed)
        return self.spilled() if len(self.pointers) >= self.most else None

    def grown(self, place: int, inserted: int, row: tuple[str, str] | None):
        """The digest of the rows up to ``place``, with insertions and a row (an empty role: the one of its place) behind them."""
        sha = self.shas[place]
        lines = []
        for _ in range(inserted):
            place = TURN[place]
            lines.append(f"{ROLE[place]}:")
        if row:
            lines.append(f"{row[0] or ROLE[TURN[place]]}:{row[1]}")
        if not lines:
            return sha
        began = self.shas[0] is not sha
        sha = sha.copy()
        sha.update((("\n" if began else "") + "\n".join(lines)).encode())
        return sha

    def spilled(self) -> dict:
        row = {"conv_id": self.conv, "chunk": self.chunks, "data": zlib.compress(self.pointers.tobytes(), 1)}
        self.pointers, self.chunks = array("I"), self.chunks + 1
        return row

    def ended(self) -> list[dict]:
        ends = []
        for place, value in enumerate(self.now):
            for inserted in range(3) if value else ():
                at = place
                for _ in range(inserted):
                    at = TURN[at]
                if at in (START, AFTER_A):
                    ends.append((value[0] + INSERT_COST * inserted, (value[1], "I" * inserted), place, inserted))
        more, (_, tail), place, inserted = min(ends)
        out = {"conv_id": self.conv, "place": place, "tail": tail, "gaps": self.high - self.low + 1 - self.turns if self.turns else 0, "blank": self.blank, "duplicate": self.duplicate,
               "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost + more, "repaired_sha256": self.grown(place, inserted, None).hexdigest()}
        if not self.chunks:
            return [out | {"audit": traced(self.pointers, place)[0] + tail}]
        return [self.spilled(), out] if self.pointers else [out]


def frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in NAMES})


def streamed(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk: Walk | None = None
        for batch in batches:
            out: list[dict] = []
            columns = [batch[c].array for c in ("conv_id", "turn", "role", "text", "fault", "alive")]
            for conv, turn, role, text, fault, alive in zip(*columns, strict=True):
                conv = conv if isinstance(conv, str) else None
                if walk is None or walk.conv != conv:
                    out += walk.ended() if walk else []
                    walk = Walk(conv, chunk)
                if alive:
                    full = walk.add(int(turn) if isinstance(turn, str) else None, role, text, int(fault))
                    out += [full] if full else []
            if out:
                yield frame(out)
        if walk:
            yield frame(walk.ended())

    return run


def backwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of each chunk; a conversation's last row comes first, then its chunks from the last to the first."""
    place = 0
    for batch in batches:
        out = []
        for conv, chunk, data, end, tail in zip(*[batch[c].array for c in ("conv_id", "chunk", "data", "place", "tail")], strict=True):
            if isinstance(tail, str):
                place, edits = int(end), tail
            else:
                edits, place = traced(array("I", zlib.decompress(data)), place)
            out.append((conv if isinstance(conv, str) else None, int(chunk), edits))
        yield pd.DataFrame(out, columns=["conv_id", "chunk", "edits"])


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each ``conv_id`` of ``rows``: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    ready = classified(damaged(rows)).sortWithinPartitions("conv_id", "turn", "role", "text", "seen")
    # whole numbers that may be null go through pandas as text
    ready = ready.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "fault", "alive")
    done = stage(ready.mapInPandas(streamed(chunk), OUT))
    ends = done.where("tail is not null")
    giant = done.where("chunk is not null")
    if not giant.isEmpty():
        last = ends.where("audit is null").withColumn("chunk", F.lit(2**62))
        order = giant.unionByName(last).repartition("conv_id").sortWithinPartitions("conv_id", F.col("chunk").desc())
        pieces = order.select("conv_id", "chunk", "data", "place", "tail").mapInPandas(backwards, "conv_id string, chunk long, edits string")
        whole = pieces.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "edits"))), lambda x: x["edits"]), "").alias("_whole"))
        ends = ends.join(whole.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").withColumn("audit", F.coalesce("audit", "_whole"))
    return ends.select(F.col("conv_id").cast(rows.schema["conv_id"].dataType), *RESULT)
