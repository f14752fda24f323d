"""Evidence packages: an incident, its alerts, their events and its graph as blocks in order, chained by header hashes.

A package is rows, one for each block: (incident_id, index, type, block_id, content, content_hash, prev_hash, header_hash). Blocks stand
incident first, then alerts and events by time and id, then the graph. A content is JSON with keys in order, without spaces and without
nulls; its hash is worked out by Spark. A header commits to type, id, index, the previous header and the content hash, and the digest to
type, id and content hash of all blocks in order. Both are a walk along the package, so slim rows are sorted within their package and streamed:
what a task holds doesn't grow with a package.

``verify`` walks the stored blocks the same way and names each fault.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_NAME = "evidence-package.v1"
ZERO_HASH = "0" * 64
TYPES = ("incident", "alert", "event", "graph")
WALKED = "incident_id string, kind string, index bigint, type string, block_id string, content_hash string, prev_hash string, header_hash string, digest string"
NAMES = [part.split(" ")[0] for part in WALKED.split(", ")]


def ordered(value: Column, kind: T.DataType) -> Column:
    """A value whose structs have their fields in order of names."""
    if isinstance(kind, T.StructType):
        fields = [ordered(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType | T.ArrayType):
        return F.transform(value, lambda x: ordered(x, kind.elementType))
    return value


def canonical(df: DataFrame, names: list[str] | None = None) -> Column:
    """The JSON of a row (of the named columns): keys in order, no nulls."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.to_json(F.struct(*[ordered(F.col(n), kinds[n]).alias(n) for n in sorted(names or df.columns)]))


def story_events(events: DataFrame) -> DataFrame:
    """``events`` (incident_id, event_id, ingest_id, time, ...) with ``handle``, each once for an incident: the first seen of a handle, or of a
    content where there is none."""
    handle = F.coalesce(F.when(F.length("event_id") > 0, F.col("event_id")), F.when(F.length("ingest_id") > 0, F.col("ingest_id")))
    rows = events.withColumn("handle", handle).withColumn("_content", canonical(events))
    key = F.coalesce(F.concat(F.lit("h"), "handle"), F.concat(F.lit("c"), F.sha2("_content", 256)))
    first = rows.groupBy("incident_id", key.alias("_key")).agg(F.min_by(F.struct(*events.columns, "handle"), F.struct(F.coalesce("time", F.lit(0)), "_content")).alias("x"))
    return first.select("x.*")


def contents(incidents: DataFrame, alerts: DataFrame, events: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """(incident_id, rank, time, name, type, block_id, content): the blocks of all packages, not yet chained.

    ``alerts`` and ``events`` have the incident they belong to; ``graphs``: (incident_id, graph)."""
    def part(df: DataFrame, kind: str, time: Column, name: Column, block: Column, content: Column) -> DataFrame:
        return df.select("incident_id", F.lit(TYPES.index(kind)).alias("rank"), F.coalesce(time.cast("bigint"), F.lit(0)).alias("time"), F.coalesce(name, F.lit("")).alias("name"),
                         F.lit(kind).alias("type"), block.alias("block_id"), content.alias("content"))

    none = F.lit(None).cast("bigint")
    once = story_events(events)
    parts = [part(incidents, "incident", none, F.lit(""), F.lit("incident"), canonical(incidents)),
             part(alerts, "alert", F.col("time"), F.col("alert_id"), F.concat(F.lit("alert:"), "alert_id"), canonical(alerts, [c for c in alerts.columns if c != "incident_id"])),
             part(once, "event", F.col("time"), F.col("handle"), F.coalesce(F.concat(F.lit("event:"), "handle"), F.concat(F.lit("event:#"), F.sha2(canonical(once), 256))),
                  canonical(once, [c for c in once.columns if c not in ("incident_id", "handle")]))]
    if graphs is not None:
        parts.append(part(graphs, "graph", none, F.lit(""), F.lit("graph"), F.col("graph")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("content_hash", F.sha2("content", 256))


def header(kind: str, block: str, index: int, prev: str, content: str) -> str:
    text = json.dumps({"type": kind, "block_id": block, "index": index, "prev_hash": prev, "content_hash": content}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


class Digest:
    """The running digest of a package's blocks."""

    def __init__(self) -> None:
        self.sha, self.n = hashlib.sha256(b"["), 0

    def add(self, kind: str, block: str, content: str) -> None:
        self.sha.update((("," if self.n else "") + json.dumps({"type": kind, "block_id": block, "content_hash": content}, sort_keys=True, separators=(",", ":"))).encode())
        self.n += 1

    def text(self) -> str:
        whole = self.sha.copy()
        whole.update(b"]")
        return whole.hexdigest()


def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks in order to chained blocks, and one row for each package behind its last block."""
    now, index, prev, digest = None, 0, ZERO_HASH, Digest()
    for batch in batches:
        out = []
        for incident, kind, block, content in zip(*[batch[c].array for c in ("incident_id", "type", "block_id", "content_hash")], strict=True):
            if now is not None and incident != now:
                out.append((now, "package", index, None, None, None, None, prev, digest.text()))
            if incident != now:
                now, index, prev, digest = incident, 0, ZERO_HASH, Digest()
            head = header(kind, block, index, prev, content)
            out.append((incident, "block", index, kind, block, content, prev, head, None))
            digest.add(kind, block, content)
            index, prev = index + 1, head
        yield pd.DataFrame(out, columns=NAMES)
    if now is not None:
        yield pd.DataFrame([(now, "package", index, None, None, None, None, prev, digest.text())], columns=NAMES)


def build(blocks: DataFrame, prefix: str = "evidence") -> tuple[DataFrame, DataFrame]:
    """(blocks, packages) of :func:`contents`. Packages: (package_id, incident_id, schema, block_count, head_hash); the id holds the digest,
    so the same incident gives the same id whenever it is built. Incidents without an id have no package."""
    from secflow.session import cut_lineage

    rows = cut_lineage(blocks.where("incident_id is not null"))
    slim = rows.select("incident_id", "rank", "time", "name", "type", "block_id", "content_hash")
    order = slim.repartition("incident_id").sortWithinPartitions("incident_id", "rank", "time", "name", "content_hash")
    walked = cut_lineage(order.select("incident_id", "type", "block_id", "content_hash").mapInPandas(chained, WALKED))
    texts = rows.select("incident_id", "type", "block_id", "content_hash", "content").dropDuplicates(["incident_id", "type", "block_id", "content_hash"])
    done = walked.where("kind = 'block'").drop("kind", "digest").join(texts, ["incident_id", "type", "block_id", "content_hash"])
    packages = walked.where("kind = 'package'").select(F.concat_ws(":", F.lit(prefix), "incident_id", "digest").alias("package_id"), "incident_id", F.lit(SCHEMA_NAME).alias("schema"),
                                                       F.col("index").alias("block_count"), F.col("header_hash").alias("head_hash"))
    return done.select("incident_id", "index", "type", "block_id", "content", "content_hash", "prev_hash", "header_hash"), packages


def walked_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Faults of stored blocks in order; each block row carries what its package says."""
    now, at, prev, digest, said = None, 0, ZERO_HASH, Digest(), None

    def closing() -> list[tuple]:
        count, head, package = said
        faults = []
        if not isinstance(package, str):
            return [(now, "no package")]
        if count != at:
            faults.append("block count")
        if head != prev:
            faults.append("head hash")
        if not package.endswith(f":{now}:{digest.text()}"):
            faults.append("package id")
        return [(now, f) for f in faults]

    for batch in batches:
        out: list[tuple] = []
        names = ("incident_id", "index", "type", "block_id", "content_hash", "prev_hash", "actual", "names", "block_count", "head_hash", "package_id")
        for incident, index, kind, block, content, before, actual, named, count, head, package in zip(*[batch[c].array for c in names], strict=True):
            if incident != now:
                out += closing() if now is not None else []
                now, at, prev, digest, said = incident, 0, ZERO_HASH, Digest(), (count, head, package)
                if kind != "incident":
                    out.append((now, "first block"))
                elif named != incident:
                    out.append((now, "incident block"))
            if index != at:
                out.append((now, f"{block}: position"))
            if kind not in TYPES:
                out.append((now, f"{block}: type"))
            if actual != content:
                out.append((now, f"{block}: content"))
            if before != prev:
                out.append((now, f"{block}: link"))
            prev = header(kind, block, int(index), before, content)
            digest.add(kind, block, content)
            at += 1
        yield pd.DataFrame(out, columns=["incident_id", "failure"])
    if now is not None:
        yield pd.DataFrame(closing(), columns=["incident_id", "failure"])


def verify(blocks: DataFrame, packages: DataFrame) -> DataFrame:
    """(incident_id, failure): faults of stored packages, none for those that are whole.

    Positions, types, contents, links and the first block are checked block by block; count, head and id against the package; ids of blocks must
    differ, and a package without blocks is one fault."""
    told = packages.select("incident_id", "block_count", "head_hash", F.when(F.col("schema") == SCHEMA_NAME, F.col("package_id")).alias("package_id"))
    rows = blocks.withColumn("actual", F.sha2("content", 256)).withColumn("names", F.get_json_object(F.when(F.col("type") == "incident", F.col("content")), "$.incident_id")).drop("content")
    known = rows.join(told, "incident_id", "left")
    order = known.repartition("incident_id").sortWithinPartitions("incident_id", "index", "block_id")
    faults = order.select("incident_id", "index", "type", "block_id", "content_hash", "prev_hash", "actual", "names", "block_count", "head_hash", "package_id").mapInPandas(
        walked_again, "incident_id string, failure string")
    twice = blocks.groupBy("incident_id", "block_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("incident_id", F.concat("block_id", F.lit(": id twice")).alias("failure"))
    empty = packages.join(blocks.select("incident_id").distinct(), "incident_id", "left_anti").select("incident_id", F.lit("no blocks").alias("failure"))
    return faults.unionByName(twice).unionByName(empty)


def cited_events(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """(incident_id, alert_id, event_id, block_id): each event an alert cites and the block that holds it, null where none does.

    ``alerts``: (incident_id, alert_id, event_id), one row for each citation."""
    held = story_events(events)
    by = held.select("incident_id", F.explode(F.array_distinct(F.array("event_id", "ingest_id"))).alias("event_id"), F.concat(F.lit("event:"), "handle").alias("block_id")).where("event_id is not null")
    first = by.groupBy("incident_id", "event_id").agg(F.min("block_id").alias("block_id"))
    return alerts.select("incident_id", "alert_id", "event_id").distinct().join(first, ["incident_id", "event_id"], "left").select("incident_id", "alert_id", "event_id", "block_id")
