"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

Each vocabulary entry becomes a BPE piece whose bytes are mapped to one printable character each, with
the negative rank as score and identity normalisation: the piece model then merges the pair with the best
score, leftmost first, which is the pair of the lowest rank. Pre-tokens are encoded one by one; decoding
maps ids back to their bytes. Entries that no sequence of merges reaches are found when the model is
built and looked up whole, as a rank file demands.

Defined cases: null is the empty text, which has no ids; repeated rows are encoded row by row; other
columns are ignored; long texts are encoded whole (a pre-token's cost is n log n).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.llm.common import whole_text

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 200_000, 48
#: A character for each byte that is neither white space nor a control character.
ALPHABET = "".join(chr(0x100 + b) for b in range(256))
TO_CHARS = {b: ALPHABET[b] for b in range(256)}
NAMES = ("n_tokens", "ids_sha256", "decoded_sha256")
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks."""
    with open(path, "rb") as f:
        ranks = {int(n): base64.b64decode(t) for t, n in (line.split() for line in f if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARS)


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def flag(number: int, value: int) -> bytes:
    return varint(number << 3) + varint(value)


def float32(number: int, value: float) -> bytes:
    import struct

    return varint(number << 3 | 5) + struct.pack("<f", value)


def model_proto(tokens: list[bytes]) -> bytes:
    """The serialised model: pieces 0..n-1 are the tokens, piece n is the obligatory unknown piece."""
    pieces = [message(1, mapped(t).encode()) + float32(2, -i) + flag(3, 1) for i, t in enumerate(tokens)]
    pieces.append(message(1, "⁇".encode()) + float32(2, 0.0) + flag(3, 2))
    n = len(tokens)
    trainer = flag(3, 2) + flag(4, n + 1) + flag(40, n) + flag(41, -1) + flag(42, -1) + flag(43, -1)
    normalizer = message(1, b"identity") + message(2, b"") + flag(3, 0) + flag(4, 0) + flag(5, 0)
    return b"".join(message(1, p) for p in pieces) + message(2, trainer) + message(3, normalizer)


@dataclass(frozen=True)
class Spec:
    """What a worker needs: the model, the tokens and the entries that merges don't reach."""

    model: bytes
    tokens: tuple[bytes, ...]
    whole: tuple[tuple[bytes, int], ...]
    pattern: str


def build(path: str, pattern: str = public_tokenizers.PATTERN) -> Spec:
    tokens = read_ranks(path)
    model = model_proto(tokens)
    found = sentencepiece.SentencePieceProcessor(model_proto=model).encode([mapped(t) for t in tokens], num_threads=1)
    whole = tuple((t, i) for i, (t, ids) in enumerate(zip(tokens, found, strict=True)) if ids != [i])
    return Spec(model, tuple(tokens), whole, pattern)


class Codec:
    def __init__(self, spec: Spec):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=spec.model)
        self.find = regex.compile(spec.pattern).findall
        self.tokens = spec.tokens
        self.numbers = [str(i) for i in range(len(spec.tokens))]
        self.whole = dict(spec.whole)
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        pieces = self.find(text)
        known = self.known
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        if new:
            if len(known) > REMEMBERED:
                self.known = known = {}
                new = list(dict.fromkeys(pieces))
            data = [p.encode("utf-8") for p in new]
            ids = self.processor.encode([mapped(d) for d in data], num_threads=1)
            fresh = {p: (self.whole[d],) if d in self.whole else tuple(i) for p, d, i in zip(new, data, ids, strict=True)}
            known.update((p, i) for p, i in fresh.items() if len(p) <= LONGEST)
            if any(len(p) > LONGEST for p in new):
                return list(chain.from_iterable(known[p] if p in known else fresh[p] for p in pieces))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        ids = self.encode(text)
        return (len(ids), hashlib.sha256(",".join(map(self.numbers.__getitem__, ids)).encode()).hexdigest(),
                hashlib.sha256(self.decode(ids)).hexdigest())


@lru_cache(maxsize=2)
def codec_of(spec: Spec) -> Codec:
    return Codec(spec)


def _over(docs: DataFrame, schema: str, make, path: str, text_col: str, name: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(build(path))

    def run(texts):
        codec = codec_of(held.value)
        for batch in texts:
            yield make(codec, batch)

    return docs.withColumn(name, F.pandas_udf(run, schema, F.PandasUDFType.SCALAR_ITER)(whole_text(text_col)))


#: Texts whose ids a worker holds at a time.
SLICE = 128


def _with_ids(docs: DataFrame, keep: list[str], path: str, text_col: str, digests_too: bool) -> DataFrame:
    """The kept columns with ``ids`` (and digests), a slice of texts at a time, so that a worker's memory doesn't
    follow the size of a batch."""
    held = docs.sparkSession.sparkContext.broadcast(build(path or public_tokenizers.path(VOCABULARY)))
    rows = docs.select(*[F.col(c) for c in keep], whole_text(text_col).alias("_text"))
    added = T.StructType().add("ids", T.ArrayType(T.IntegerType()))
    if digests_too:
        added = added.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "_text"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(held.value)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                texts = part.column(len(keep)).to_pylist()
                columns = [pa.array([np.array(codec.encode(t), np.int32) for t in texts], pa.list_(pa.int32()))]
                if digests_too:
                    found = list(zip(*[codec.digests(t) for t in texts], strict=True))
                    columns += [pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], [*keep, *added.names])

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str = "", text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``."""
    return _with_ids(docs, [c for c in docs.columns if c != "ids"], path, text_col, False)


def decode(rows: DataFrame, path: str = "", ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes that the ids stand for. Null ids are no bytes."""
    held = rows.sparkSession.sparkContext.broadcast(build(path or public_tokenizers.path(VOCABULARY)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(held.value)
        for batch in batches:
            yield pd.Series([codec.decode(list(ids) if ids is not None else []) for ids in batch], dtype=object)

    return rows.withColumn("decoded", F.pandas_udf(run, "binary")(F.col(ids_col)))


def checked(docs: DataFrame, path: str = "", text_col: str = "text") -> DataFrame:
    """``docs`` without the text and with the ids, their number and the digests of the ids and of the decoded bytes."""
    return _with_ids(docs, [c for c in docs.columns if c not in (text_col, "ids", *NAMES)], path, text_col, True)


def digests(docs: DataFrame, path: str = "", text_col: str = "text") -> DataFrame:
    """``docs`` without the text and with the number of ids, the digest of the ids and of the decoded bytes."""
    def make(codec: Codec, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codec.digests(t) for t in texts], columns=list(NAMES))

    rows = _over(docs, DIGESTS, make, path or public_tokenizers.path(VOCABULARY), text_col, "_digests")
    return rows.select(*[c for c in docs.columns if c not in (text_col, *NAMES)], "_digests.*")
