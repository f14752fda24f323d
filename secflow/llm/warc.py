"""WARC archives: writing, and reading by boundary-chain verification.

Records are written with Spark's text writer, whose line end is the blank lines that close a record, so
archives go to any store that Spark writes. Reading splits the files at the record magic: each task
emits a candidate at every magic, with the offset where the next record must begin by the candidate's
header. Magic inside a payload makes false candidates, so only those reachable from the start of the file
count: pointer jumping doubles the known part of every chain in a round, until nothing is added.
Payloads that hold magic are put together again from their segments.

Defined cases: null html is an empty payload; a null url is empty; line breaks in a url are escaped, and so is the
slash of a ``WARC/1.0`` that ends it, which the line end would make a magic; a header may have any length; a
null page id is written as an empty name and read back as null; equal payloads of ``REVISIT_FROM`` bytes or more share one
response (the largest id); a record cut off by the end of its file is dropped; no pages give no records.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from secflow.llm.common import join_split, stage
from secflow.session import checkpoint_dir

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
REVISIT_FROM = 1000
#: Most records of one archive file.
PER_FILE = 20_000
DATE = "2024-01-01T00:00:00Z"
SEGMENT = "file string, block long, rel long, size long, head int, length long, page_id long, kind string, refers_to long, digest string, full long, sha1 string, body binary"


def responses(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, n) of payloads that can be revisited, and (digest, keeper) of those found twice or more."""
    groups = pages.where(F.col("_len") >= REVISIT_FROM).groupBy("_digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("_keeper"))
    many = stage(groups.where("n > 1"))
    return many.select("_digest", "n"), many.select("_digest", "_keeper")


def write(pages: DataFrame, path: str) -> None:
    """One record for each page."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A"), r"WARC/1\.0\z", "WARC%2F1.0").alias("url"),
                        body.alias("_body"), F.octet_length(body).alias("_len"), F.sha1(body.cast("binary")).alias("_digest"))
    counts, keepers = responses(rows)
    rows = join_split(rows, keepers, "_digest", counts, "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = (F.col("_len") >= REVISIT_FROM) & (F.col("_keeper") != F.col("page_id"))
    revisit = F.coalesce(revisit, F.col("_keeper").isNotNull() & (F.col("_len") >= REVISIT_FROM))
    record = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"), F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit(f"\r\nWARC-Date: {DATE}"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("_len").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name("_keeper"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("_len").cast("string")),
        F.lit(END), F.when(revisit, "").otherwise(F.col("_body")))
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", PER_FILE).text(path)


def number(text: bytes | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def named(text: bytes | None) -> int | None:
    return number(text[len(b"<urn:page:") : -1]) if text and text.startswith(b"<urn:page:") else None


def candidate(data: bytes) -> tuple:
    """(head, length, page id, kind, refers to, digest, full length) of what follows a magic; nulls if it is no header."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return (None,) * 7
    fields = dict(line.split(b": ", 1) for line in data[:end].split(b"\r\n") if b": " in line)
    length, kind = number(fields.get(b"Content-Length")), fields.get(b"WARC-Type")
    if length is None or length < 0 or kind is None:
        return (None,) * 7
    digest = fields.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha1:")
    return (end + 4, length, named(fields.get(b"WARC-Record-ID")), kind.decode("latin-1"), named(fields.get(b"WARC-Refers-To")),
            digest.decode("latin-1"), number(fields.get(b"WARC-Payload-Length")))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics: file, block, place in the block's lines, parsed head and the bytes.

    Every line belongs to one block and blocks are read in order, so the sizes of lines add up to offsets."""
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    names = [part.split(" ")[0] for part in SEGMENT.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rel = None, 0
        for batch in batches:
            out: list[tuple] = []
            for data, file, block in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != (file, block):
                    at, rel = (file, block), 0
                size = len(data) + len(MAGIC)
                head = candidate(data)
                whole = head[0] is not None and len(data) >= head[0] + head[1]
                sha1 = hashlib.sha1(memoryview(data)[head[0] : head[0] + head[1]]).hexdigest() if whole else None
                out.append((file, block, rel, size, *head, sha1, data))
                rel += size
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)

    return lines.mapInArrow(run, SEGMENT)


def placed(found: DataFrame) -> DataFrame:
    """Segments with ``offset``, where their magic begins in the file. A file has few blocks."""
    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", before.alias("_before"))
    return found.join(starts, ["file", "block"]).withColumn("offset", F.col("_before") + F.col("rel") - len(MAGIC)).drop("_before")


def reachable(candidates: DataFrame) -> DataFrame:
    """Candidates (file, offset, next) on the chain from the start of their file, by pointer jumping."""
    jumps = candidates.select("file", "offset", "next")
    known, n = stage(jumps.where("offset = 0").select("file", "offset")), -1
    while (more := known.count()) > n:
        n = more
        ahead = known.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        known = stage(known.unionByName(ahead.join(candidates.select("file", "offset"), ["file", "offset"])).distinct())
        onward = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("_far"))
        jumps = stage(jumps.join(onward, ["file", "next"]).select("file", "offset", F.col("_far").alias("next")))
    return candidates.join(known, ["file", "offset"])


#: Segments of payloads with magic inside are looked up by a broadcast up to this many, else by a shuffle.
FEW = 100_000
RECORD = ("page_id", "kind", "refers_to", "digest", "full", "length")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, page_id, kind, refers_to, digest, full, length, sha1) of the records of all archives
    below a folder; ``sha1`` is that of the payload as read."""
    found = segments(spark, path)
    slim = stage(placed(found.drop("body")))
    candidates = slim.where("head is not null and offset >= 0").withColumn("next", F.col("offset") + len(MAGIC) + F.col("head") + F.col("length") + len(END))
    chain = stage(reachable(candidates).select("file", "offset", *RECORD, "sha1", "head"))
    whole, split = chain.where("sha1 is not null").drop("head"), chain.where("sha1 is null")
    if split.isEmpty():
        return whole
    body = split_bodies(found, slim, split).withColumn("sha1", F.sha1("payload"))
    return whole.unionByName(split.drop("sha1", "head").join(body.select("file", "offset", "sha1"), ["file", "offset"]))


def split_bodies(found: DataFrame, slim: DataFrame, split: DataFrame) -> DataFrame:
    """(file, offset, payload) of records whose payload holds magic: the segments up to the next record, joined
    by the magic between them. A record cut off by the end of its file is not returned."""
    until = F.col("offset") + len(MAGIC) + F.col("head") + F.col("length")
    ends = split.select("file", F.col("offset").alias("owner"), until.alias("until"), "head", "length")
    # the latest such record at or before a segment owns it, if it reaches that far
    marks = slim.select("file", "offset", "block", "rel").join(ends.withColumn("offset", F.col("owner")), ["file", "offset"], "left")
    last = W.partitionBy("file").orderBy("offset")
    owned = marks.select("file", "block", "rel", "offset", *[F.last(c, ignorenulls=True).over(last).alias(c) for c in ("owner", "until", "head", "length")])
    owned = stage(owned.where(F.col("offset") < F.col("until")))
    pieces = found.select("file", "block", "rel", "body").join(F.broadcast(owned) if owned.count() <= FEW else owned, ["file", "block", "rel"])
    one = pieces.groupBy("file", "owner", "head", "length").agg(F.sort_array(F.collect_list(F.struct("offset", "body"))).alias("parts"))
    data = F.aggregate(F.slice("parts", 2, F.size("parts")), F.element_at("parts", 1)["body"], lambda acc, x: F.concat(acc, F.lit(MAGIC), x["body"]))
    full = one.withColumn("_data", data).where(F.octet_length("_data") >= F.col("head") + F.col("length"))
    return full.select("file", F.col("owner").alias("offset"), F.substring(F.col("_data"), F.col("head") + 1, F.col("length").cast("int")).alias("payload"))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """``records`` with ``payload``."""
    found, kept = segments(spark, path), records(spark, path)
    bodies = placed(found).where("head is not null and octet_length(body) >= head + length").select(
        "file", "offset", F.expr("substring(body, head + 1, cast(length as int))").alias("payload"))
    whole = kept.join(bodies, ["file", "offset"])
    slim = placed(found.drop("body"))
    cut = kept.join(bodies.select("file", "offset"), ["file", "offset"], "left_anti").join(slim.select("file", "offset", "head"), ["file", "offset"])
    return whole.unionByName(cut.join(split_bodies(found, slim, cut.select("file", "offset", "head", "length")), ["file", "offset"]).select(whole.columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages written to archives in the shared folder and read back: one row for each record."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return records(spark, path)
