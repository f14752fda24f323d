"""Token ids in binary files: every document compressed for itself with one shared zstandard dictionary.

A folder holds ``shards`` (the files), ``dictionary`` (one row: its bytes and SHA-256) and ``index`` (one row for each document:
file, place, size). Documents stand in ascending order of their ids, across files and in them. Layout of a file, numbers little-endian::

    header   JSON line: format, shard number, dictionary hash, end id
    frames   one for each document: the ids as unsigned 32-bit integers with the end id, one zstandard frame, then a line feed
    index    an array of INDEX rows (id, null flag, offset, size, ids), then a line feed
    tail     offset of the index, its rows, ids of the file, MARK; then a line feed

Spark's text writer writes each part as one line, so files go to any store that Spark writes, and a lost task is written again.
One document is read by its place alone (``fetch``): a seek and one frame.

The dictionary is trained on at most ``SAMPLE`` documents of at most ``SHORT`` characters, chosen by a hash: short documents
are those it serves. Every document is encoded whole: white space separates what the tokenizer treats for itself, so a
worker remembers the ids of the runs between spaces and line feeds.

Defined cases: a null text is an empty text, which has the end id only; null ids come first; rows with equal ids are
ordered by their texts, and equal rows stay as many; no rows give no files and no rows. Columns other than the two are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from secflow.llm.common import stage, whole_text
from secflow.session import checkpoint_dir

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
FORMAT, MARK = "token-shard-1", b"TOKSHRD1"
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u8"), ("n", "<u8")])
TAIL = "<QQQ8s"
TAIL_BYTES = struct.calcsize(TAIL)
#: Documents in training, and characters of each at most.
SAMPLE, SHORT = 2000, 8000
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
#: Bytes of text for each file, about.
FILE_BYTES = 32 << 20
#: Bytes of text that a worker holds encoded at a time.
SLICE_BYTES = 1 << 20
#: Runs of each half of a worker's memory (more by one slice at most), and characters of a run in it.
REMEMBERED, LONGEST = 350_000, 48
LATIN = "[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u024F]+"
#: Words of Latin letters that normalisation leaves as many letters (a capital I with a dot becomes two characters); such words with
#: marks behind them, which are a piece of their own (no quote, and nothing that a special token is made of).
PLAIN_WORD = re.compile(LATIN).fullmatch
MARKED = re.compile(rf"({LATIN})([!-&(-/:;=?@\[-`{{}}~]+)").fullmatch


class Encoder:
    """Ids of whole texts as little-endian bytes.

    A text is looked up by runs between spaces and line feeds; new runs go to the tokenizer. Found runs stay in the
    young half of the memory, the old half goes when the young one is full."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def fresh(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of runs. A plain word is one piece, whose last id ends a word, so words are encoded together and cut there."""
        out, words, others = {}, [], []
        for run in runs:
            (words if PLAIN_WORD(run) else others).append(run)
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                others += part
                continue
            data, last = ids.tobytes(), 0
            for run, cut in zip(part, (4 * cuts).tolist(), strict=True):
                out[run] = data[last:cut]
                last = cut
        if others:
            out.update((r, np.asarray(e.ids, "<u4").tobytes()) for r, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True))
        return out

    def learned(self, runs: list[str]) -> None:
        """Brings runs into the young half: from the old half, from a stem and its marks, or from the tokenizer."""
        young, old = self.young, self.old
        stems, new = {}, set()
        for run in runs:
            if (ids := old.get(run)) is not None:
                young[run] = ids
            elif match := MARKED(run):
                stems[run] = match.groups()
            else:
                new.add(run)
        for part in set().union(*stems.values()).difference(young):
            if part in old:
                young[part] = old[part]
            else:
                new.add(part)
        young.update(self.fresh(list(new)))
        young.update((run, young[stem] + young[marks]) for run, (stem, marks) in stems.items())

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Each different run of the texts is looked up once; its ids are then copied to wherever the run stands."""
        split = runs_of(texts)
        every = split.values.dictionary_encode()
        runs = every.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.young.get, runs))
        missing = [i for i, x in enumerate(known) if x is None]
        if missing:
            self.learned([runs[i] for i in missing])
        for i in missing:
            known[i] = self.young[runs[i]]
        for i in missing:
            if len(runs[i]) > LONGEST:
                self.young.pop(runs[i], None)
        if len(self.young) > REMEMBERED:
            self.young, self.old = {"": b""}, self.young
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        which = every.indices.to_numpy()
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        first = (np.cumsum(sizes) - sizes)[which] - ends[:-1]  # from a run's place in the texts to that of its ids
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(first, n) + np.arange(ends[-1])]
        at = ends[split.offsets.to_numpy()].tolist()
        return [ids[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)]


def runs_of(texts: list[str]) -> pa.ListArray:
    """The runs of texts. Capitals of plain texts are small letters to the tokenizer, which makes fewer different runs; a text
    that may hold special tokens keeps its letters."""
    plain = [(t.lower() if t.isascii() and "<|" not in t else t).replace("\n", " ") for t in texts]
    return pc.split_pattern(pa.array(plain, pa.large_string()), " ")


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def end_bytes(end: int) -> bytes:
    return struct.pack("<I", end)


def dictionary(docs: DataFrame, path: str, rows: int, end: int) -> bytes:
    """A dictionary trained on the ids of a bounded sample; empty if there is too little to train on."""
    share = min(1.0, 1.2 * SAMPLE / max(rows, 1))
    chosen = docs.where(F.length("text") <= SHORT).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    encoder = encoder_of(path)
    samples = [x + end_bytes(end) for x in encoder.ids_of([r["text"] for r in chosen.select("text").limit(SAMPLE).collect()])]
    if len(samples) < 8 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT) if data else None
    if held:
        held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True)


def decompressor(data: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT) if data else None)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lines_of(path: str, held, end: int):
    """A partition's documents, in order, to the lines of its file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer, ending = encoder_of(path), compressor(held.value), end_bytes(end)
        index, at, total = [], 0, 0
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), np.asarray(pc.binary_length(batch.column(1)), np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                out = []
                if not index and hi > lo:
                    out.append(json.dumps({"format": FORMAT, "shard": TaskContext.get().partitionId(), "dictionary": sha(held.value), "end": end}).encode())
                    at = len(out[0]) + 1
                for doc, data in zip(ids[lo:hi], encoder.ids_of(batch.column(1).slice(lo, hi - lo).to_pylist()), strict=True):
                    data += ending
                    out.append(packer.compress(data))
                    index.append((doc or 0, doc is None, at, len(out[-1]), len(data) // 4))
                    at += len(out[-1]) + 1
                    total += len(data) // 4
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if index:
            rows = np.array(index, INDEX).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([rows, struct.pack(TAIL, at, len(index), total, MARK)], pa.binary())], ["value"])

    return run


def write(docs: DataFrame, path: str, vocabulary: str = "", end: int = END_ID) -> None:
    """The documents (doc_id, text) as token files in folder ``path``."""
    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    slim = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    rows, size = slim.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    data = dictionary(slim, vocabulary, rows, end)
    spark.createDataFrame([(bytearray(data), sha(data))], "data binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")
    keys = ["doc_id", "_mark", "_tie"]  # the last splits equal rows
    marked = slim.withColumn("_mark", F.xxhash64("text")).withColumn("_tie", F.monotonically_increasing_id())
    parts = marked.repartitionByRange((size or 0) // FILE_BYTES + 1, *keys).sortWithinPartitions("doc_id", "text")
    held = spark.sparkContext.broadcast(data)
    parts.select("doc_id", "text").mapInArrow(lines_of(vocabulary, held, end), "value binary").select(F.col("value").cast("string")).write.text(f"{path}/shards")
    listed(spark, path).write.parquet(f"{path}/index")


def parsed(content: bytes) -> tuple[dict, np.ndarray]:
    """The header and the index of a file."""
    start, rows, _, mark = struct.unpack(TAIL, content[-TAIL_BYTES - 1 : -1])
    if mark != MARK:
        raise ValueError("not a whole token file")
    header = json.loads(content[: content.index(b"\n")])
    return header, np.frombuffer(content, INDEX, rows, start)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/shards").select("path", "content")


PLACE = T.StructType().add("doc_id", "long").add("shard", "long").add("file", "string").add("offset", "long").add("size", "long").add("before", "long").add("n_tokens", "long")


def placed(header: dict, index: np.ndarray, file: str) -> list[pa.Array]:
    """The columns of PLACE for a file; ``before`` are the ids of the documents before in the file."""
    n = index["n"].astype(np.int64)
    return [pa.array(index["id"].copy(), mask=index["null"].astype(bool)), pa.array(np.full(len(index), header["shard"], np.int64)), pa.array([file] * len(index), pa.string()),
            pa.array(index["offset"].astype(np.int64)), pa.array(index["size"].astype(np.int64)), pa.array(np.cumsum(n) - n), pa.array(n)]


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Where each document stands: the index rows of all files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays(placed(*parsed(batch.column(1)[i].as_py()), batch.column(0)[i].as_py()), PLACE.fieldNames())

    return files(spark, path).mapInArrow(run, PLACE)


def kept_dictionary(spark: SparkSession, path: str) -> bytes:
    data, known = spark.read.parquet(f"{path}/dictionary").first()
    if sha(bytes(data)) != known:
        raise ValueError("the dictionary doesn't match its hash")
    return bytes(data)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, from the files; with ``ids`` on demand."""
    held = spark.sparkContext.broadcast(kept_dictionary(spark, path))
    schema = T.StructType([*PLACE.fields, T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = T.StructType([*schema.fields, T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, known = decompressor(held.value), sha(held.value)
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_py()
                header, index = parsed(content)
                if header["dictionary"] != known:
                    raise ValueError("the file was written with another dictionary")
                place, step = placed(header, index, batch.column(0)[i].as_py()), 4096
                view = memoryview(content)
                for lo in range(0, len(index), 256 if with_ids else step):
                    hi = min(len(index), lo + (256 if with_ids else step))
                    crc, ids = [], []
                    for offset, size, n in zip(*[index[c][lo:hi].tolist() for c in ("offset", "size", "n")], strict=True):
                        data = unpacker.decompress(view[offset : offset + size])
                        if len(data) != 4 * n:
                            raise ValueError("a document's size differs from the index")
                        crc.append(zlib.crc32(data))
                        if with_ids:
                            ids.append(np.frombuffer(data, "<u4").astype(np.int64))
                    more = [pa.array(ids, pa.list_(pa.int64()))] if with_ids else []
                    yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in place], pa.array(crc, pa.int64()), *more], schema.fieldNames())

    rows = stage(files(spark, path).mapInArrow(run, schema))
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    # one row for each file
    bases = sums.select("shard", F.coalesce(F.sum("_n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return rows.join(bases, "shard").select("doc_id", (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with an id, each by a seek to its frame: no file is read whole."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    unpacker, out = decompressor(kept_dictionary(spark, path)), []
    found = spark.read.parquet(f"{path}/index").where(F.col("doc_id") == doc_id).orderBy("shard", "offset")
    for row in found.select("file", "offset", "size").collect():
        file = jvm.org.apache.hadoop.fs.Path(row["file"])
        stream = file.getFileSystem(conf).open(file)
        try:
            stream.seek(row["offset"])
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, row["size"]))
        finally:
            stream.close()
        out.append(np.frombuffer(unpacker.decompress(data), "<u4").tolist())
    return out


def round_trip(docs: DataFrame) -> DataFrame:
    """The documents written to files in the shared folder and read back: one row for each."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path)
    return read(spark, path)
