"""Exact substring de-duplication on words by Rabin-Karp windows.

The rolling hash of every window of ``WINDOW`` words that can be repeated is counted in Spark, and repeated
windows merge into maximal removal intervals. Windows come in segments (see ``repeats``): a segment found
twice repeats all its windows; windows of segments that differ are hashed one by one and counted over the table.

Defined cases: null, empty and short texts have no window and lose nothing; equal rows are repeats of each
other; windows never cross documents; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.llm import repeats
from secflow.llm.common import join_split, stage

WINDOW = 35
REMEMBERED = 400_000
U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03))
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
known: dict[bytes, int] = {}


def split(text: str) -> tuple[list[bytes], np.ndarray]:
    """Words and their hashes. bytes.split() splits at the six white space characters of ASCII."""
    words = text.encode("utf-8", "surrogatepass").split()
    if len(known) > REMEMBERED:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return words, np.fromiter(map(known.__getitem__, words), dtype=U, count=len(words))


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=8).digest()


UNIT = repeats.Unit(WINDOW, 8, split, digest)


def rolling(hashes: np.ndarray, window: int, base: np.uint64) -> np.ndarray:
    """The polynomial hash of each window modulo 2^64, each from the one before it: the hash of a prefix is
    kept, the part before the window taken off and the power of its place divided out."""
    n = len(hashes)
    inverse = U(pow(int(base), -1, 1 << 64))
    powers = np.concatenate([[U(1)], np.cumprod(np.full(n, base, dtype=U))])
    undo = np.concatenate([[U(1)], np.cumprod(np.full(n, inverse, dtype=U))])
    prefix = np.concatenate([[U(0)], np.cumsum(hashes * powers[:n], dtype=U)])
    m = n - window + 1
    return (prefix[window:] - prefix[:m]) * undo[:m]


WINDOWS = "anchor long, digest long, off int, copies long, h1 long, h2 long"


def window_rows(text: str, segments: list[tuple]) -> list[tuple]:
    hashes = split(text)[1]
    out = []
    for anchor, name, copies, start, n in segments:
        part = hashes[start : start + n + WINDOW - 1]
        a, b = (rolling(part, WINDOW, base).view(np.int64).tolist() for base in BASES)
        out += [(anchor, name, off, copies, x, y) for off, (x, y) in enumerate(zip(a, b, strict=True))]
    return out


def counted(each: DataFrame) -> DataFrame:
    """Marks of the windows (anchor, digest, off, copies, h1, h2) whose hash pair is counted twice or more. Segments
    found twice need no marks."""
    twice = each.groupBy("h1", "h2").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("n")).where("c > 1")
    twice = stage(twice.select("h1", "h2", "n"))
    hit = join_split(each.where("copies = 1").select("anchor", "digest", "off", "h1", "h2"), twice.drop("n"), ["h1", "h2"], twice)
    offs = hit.groupBy("anchor", "digest").agg(F.collect_set("off").alias("offs"))
    return stage(offs.select("anchor", "digest", F.transform("offs", lambda o: F.struct(o.alias("off"), F.lit(1).alias("k"))).alias("runs")))


def kept_words(text: str, runs) -> tuple:
    words = text.encode("utf-8", "surrogatepass").split()
    keep, removed, at = [], 0, 0
    for start, end in repeats.merged(runs, WINDOW):
        keep += words[at:start]
        removed, at = removed + end - start, end
    keep += words[at:]
    return len(words), removed, hashlib.sha256(b" ".join(keep)).hexdigest()


def removal_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[repeats.Repeats, DataFrame]:
    """The found repeats and (id, fp, runs) of repeated windows by document."""
    found = repeats.find(docs, UNIT, id_col, text_col)
    return found, repeats.removals(found, counted(stage(repeats.with_units(found, found.open, window_rows, WINDOWS))))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256."""
    found, runs = removal_intervals(docs, id_col, text_col)
    return repeats.finish(found, runs, kept_words, RESULT)


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the texts without their repeated words."""
    def work(text: str, runs) -> tuple:
        words = text.encode("utf-8", "surrogatepass").split()
        at, keep = 0, []
        for start, end in repeats.merged(runs, WINDOW):
            keep += words[at:start]
            at = end
        return (b" ".join(keep + words[at:]).decode("utf-8", "surrogatepass"),)

    found, runs = removal_intervals(docs, id_col, text_col)
    return repeats.finish(found, runs, work, "doc_id long, text string")
