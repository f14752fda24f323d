"""Routing for repeated stretches: makes equal windows of a fixed length meet, without moving unique text.

A window's anchor is the smallest hash of the short grams in it, so equal windows have equal anchors.
Consecutive windows of one anchor form a segment. A window can be repeated only if its anchor is, so only
segments of repeated anchors go on: equal segments are counted first (copies cost one row each), and
different segments of one anchor are compared by the operator that uses this module.

Hot anchors and segments: counts are combined before the shuffle, and joins with them are between two
exchanges of staged tables, whose large partitions Spark splits at run time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import keyed, same, stage, whole_text
from secflow.llm.near import mix

U = np.uint64
#: Places that a key of the window minimum can hold.
PLACES = 1 << 24
#: place is start * 2^16 + number of windows
SEGMENT = "anchor long, digest long, id long, fp long, place long"
#: Repeated windows of a segment, from the off-th on.
MARKS = "anchor long, digest long, runs array<struct<off:int,k:int>>"


@dataclass(frozen=True)
class Unit:
    """What texts are made of: ``split`` gives a text's units and their hashes, ``digest`` names a run of units."""

    window: int
    gram: int  # a power of two
    split: Callable
    digest: Callable


def window_anchors(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, n) of the segments: consecutive windows whose anchor is the same gram of the text, the
    leftmost if several are smallest. So text that repeats within itself falls into several segments of one
    anchor, and a segment has ``window - gram + 1`` windows at most."""
    if len(hashes) < window:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    h, k, base = hashes, 1, 0x9E3779B97F4A7C15
    while k < gram:
        h, k, base = h[:-k] * U(base) + h[k:], 2 * k, base * base % (1 << 64)
    h = mix(h)
    width, k, n = window - gram + 1, 1, len(hashes) - window + 1
    # the upper bits of a hash, then its place: the smallest is the leftmost of the smallest
    if len(h) > PLACES:
        return by_pieces(hashes, window, gram)
    low = (h & ~U(PLACES - 1)) | np.arange(len(h), dtype=U)
    while 2 * k <= width:
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    place = (np.minimum(low[:n], low[width - k : width - k + n]) & U(PLACES - 1)).astype(np.int64)
    edge = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [n]])
    return h[place[edge[:-1]]], edge[:-1], np.diff(edge)


def by_pieces(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for very long texts, in pieces that overlap by a window. A segment that a piece's end cuts becomes two;
    each of its windows keeps its anchor."""
    step, out = PLACES // 2, []
    for at in range(0, len(hashes) - window + 1, step):
        a, start, n = window_anchors(hashes[at : at + step + window - 1], window, gram)
        out.append((a, start + at, n))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def anchors(rows: DataFrame, unit: Unit) -> DataFrame:
    """The anchor of every segment."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                out.append(window_anchors(unit.split(text)[1], unit.window, unit.gram)[0])
            yield pd.DataFrame({"anchor": (np.concatenate(out) if out else np.empty(0, U)).view(np.int64)})

    return rows.select("text").mapInPandas(run, "anchor long")


def segments(rows: DataFrame, unit: Unit) -> DataFrame:
    """(anchor, digest, id, fp, place): every segment. Anchor and digest, 64 bits each, name its content."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, digests = [], []
            for i, text in enumerate(batch["text"]):
                units, hashes = unit.split(text)
                a, start, n = window_anchors(hashes, unit.window, unit.gram)
                parts.append((a, np.full(len(start), i), start, n))
                digests += [unit.digest(units[s:e]) for s, e in zip(start.tolist(), (start + n + unit.window - 1).tolist(), strict=True)]
            a, at, start, n = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, U), *[np.empty(0, np.int64)] * 3)
            doc = batch[["id", "fp"]].iloc[at].reset_index(drop=True)
            names = np.frombuffer(b"".join(digests), np.int64)
            yield pd.DataFrame({"anchor": a.view(np.int64), "digest": names, "id": doc["id"].astype("Int64"), "fp": doc["fp"], "place": (start << 16) + n})

    return rows.mapInPandas(run, SEGMENT)


@dataclass
class Repeats:
    """``every``: occurrences of segments with repeated anchors, with their ``copies``; ``open``: one occurrence of each
    segment of anchors with different segments, with ``copies`` and the anchor's ``n_anchor``; ``again``: do
    rows with equal id and text exist?"""

    rows: DataFrame
    every: DataFrame
    open: DataFrame
    again: bool


def find(docs: DataFrame, unit: Unit, id_col: str = "doc_id", text_col: str = "text") -> Repeats:
    rows = keyed(docs, whole_text(text_col), id_col).select(F.col("id").cast("long").alias("id"), "text", "fp")
    twice = stage(anchors(rows, unit).groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"))
    met = stage(segments(rows, unit).join(twice, "anchor"))
    groups = met.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "fp", "place")).alias("one"))
    groups = stage(groups.select("anchor", "digest", "copies", "one.*"))
    several = stage(groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_anchor")).where("n_anchor > 1"))
    again = not rows.groupBy("id", "fp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()
    return Repeats(rows, met, stage(groups.join(several, "anchor")), again)


def with_units(found: Repeats, chosen: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Runs ``work(text, segments of the text)`` on the documents that hold the chosen segments.

    ``work`` gives rows of ``schema``. Both sides are shuffled by document, since the segments grow with
    the table; the texts aren't sorted."""
    wanted = chosen.groupBy("id", "fp").agg(F.collect_list(F.struct("anchor", "digest", "place", "copies")).alias("segments"))
    texts = found.rows
    met = texts.join(wanted.hint("shuffle_hash"), same(texts, wanted, ["id", "fp"])).select(texts["text"], "segments")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for text, mine in zip(batch["text"], batch["segments"], strict=True):
                out += work(text, [(s["anchor"], s["digest"], s["copies"], s["place"] >> 16, s["place"] & 65535) for s in mine])
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    made = met.mapInPandas(run, schema)
    return made.distinct() if found.again else made


def runs_of(marked: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def joined_runs(runs: Column) -> Column:
    """Sorted runs of windows, those that touch made one."""
    kind = "array<struct<start:long,k:long>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        end = F.greatest(last["start"] + last["k"], x["start"] + x["k"])
        one = F.struct(last["start"].alias("start"), (end - last["start"]).alias("k"))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["start"] + F.try_element_at(acc, F.lit(-1))["k"]),
                      F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.sort_array(runs), F.array().cast(kind), step)


def removals(found: Repeats, marks: DataFrame) -> DataFrame:
    """(id, fp, runs): the repeated windows of each document as (first window, windows).

    A segment that is found twice repeats all its windows; ``marks`` has those of the others."""
    first, n = F.shiftright("place", 16), F.col("place").bitwiseAND(F.lit(65535))
    groups = found.every.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"))
    groups = stage(groups.where("copies > 1").select("anchor", "digest", F.lit(None).cast("array<struct<off:int,k:int>>").alias("runs")).unionByName(marks))
    hit = found.every.join(groups, ["anchor", "digest"])
    mine = F.when(F.col("runs").isNull(), F.array(F.struct(first.alias("start"), n.alias("k")))).otherwise(
        F.transform("runs", lambda r: F.struct((first + r["off"]).alias("start"), r["k"].cast("long").alias("k"))))
    per_doc = hit.select("id", "fp", mine.alias("runs")).groupBy("id", "fp").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return stage(per_doc.withColumn("runs", joined_runs(F.col("runs"))))


def merged(runs, window: int) -> list[tuple[int, int]]:
    """Maximal (start, end) of the units that the windows cover."""
    out: list[tuple[int, int]] = []
    for start, k in sorted((r["start"], r["k"]) for r in runs):
        end = start + k - 1 + window
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def finish(found: Repeats, runs: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(text, runs)`` for every document; runs is None for most."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    rows = found.rows
    met = rows.join(runs.hint("shuffle_hash"), same(rows, runs, ["id", "fp"]), "left").select(rows["id"], rows["text"], "runs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = pd.DataFrame([work(t, r if r is not None else []) for t, r in zip(batch["text"], batch["runs"], strict=True)], columns=names[1:])
            done.insert(0, names[0], batch["id"].reset_index(drop=True).astype("Int64"))
            yield done

    return met.mapInPandas(run, schema)
