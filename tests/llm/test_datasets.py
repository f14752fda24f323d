"""Manifest, conversation repair and token files against brute force, on nulls, ties, repeated rows, clashing columns and empty tables."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from secflow.llm import conversations, merkle, token_files
from tests.llm import brute

CLASH = ("node", "tree", "pos", "n", "block", "seen", "fault", "alive", "chunk", "_tie", "start", "shard")
ORDER = lambda x: (x[0] is not None, x[0] or 0, *map(str, x[1:]))


def with_others(df):
    return df.withColumns({c: F.lit("other") for c in CLASH})


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    rows = [{"doc_id": i, "text": f"text {i} é" * rng.randint(0, 4), "lang": rng.choice(["en", "en", "en", "de", "", None, "ü", "zz"]), "source": rng.choice(["a", "b", None]),
             "n_chars": rng.choice([i, None, 2**63 - 1])} for i in range(90)]
    rows += [dict(rows[i]) for i in (4, 4, 4, 9)] + [rows[12] | {"text": "another"}, rows[13] | {"doc_id": None}, rows[14] | {"doc_id": None, "text": None}, rows[15] | {"doc_id": 2**60 + 1}]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_merkle(spark, docs, levels):
    got = merkle.manifest(with_others(spark.createDataFrame(docs, SCHEMA).repartition(3)), levels)
    assert sorted(map(tuple, got.collect()), key=ORDER) == sorted(brute.merkle(docs), key=ORDER)


def test_merkle_lone_leaf_and_nothing(spark, docs):
    one = spark.createDataFrame(docs[:1], SCHEMA)
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == brute.sha("")
    assert merkle.manifest(one.limit(0)).count() == 0


def test_merkle_one_language_holds_all(spark):
    rows = [{"doc_id": i // 3, "text": "same", "lang": "en", "source": "s", "n_chars": 4} for i in range(700)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(4), 4)
    assert sorted(map(tuple, got.collect()), key=ORDER) == sorted(brute.merkle(rows), key=ORDER)


def talks(seed=5, n=250):
    rng, rows = random.Random(seed), []
    for k in range(n):
        for t in range(rng.choice([1, 2, 3, 9, 14, 30])):
            rows.append({"conv_id": None if k % 40 == 0 else k, "turn": rng.choice([t, t, t, t, t + 3, None]), "role": rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "aide"]),
                         "text": rng.choice(["Yes.", "No!", "cut", "", " \n", "Hm?  ", None, f"text {t}.", f"open {t}"])})
    return rows + rows[:30]


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk", [conversations.CHUNK, 3])
def test_conversations(spark, chunk):
    """Also with chunks so small that backpointers of most conversations are spilled and streamed backwards."""
    rows = talks()
    got = conversations.repaired(with_others(spark.createDataFrame(rows, TALK).repartition(4)), chunk).collect()
    want = brute.repair(rows)
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want


def test_conversations_of_one_giant(spark):
    """One conversation over many Arrow batches whose cheapest edits are settled by its last rows only."""
    rows = [{"conv_id": 7, "turn": i, "role": "tool", "text": f"t {i}."} for i in range(30_000)]
    row = conversations.repaired(spark.createDataFrame(rows, TALK), 1000).first()
    again = conversations.repaired(spark.createDataFrame(rows, TALK)).first()
    left = conversations.damaged(spark.createDataFrame(rows, TALK)).where("alive").count()
    assert tuple(row) == tuple(again) and len(row.audit.replace("I", "")) == left


def test_conversations_nothing(spark):
    assert conversations.repaired(spark.createDataFrame([], TALK)).count() == 0


def test_conversation_steps_are_few():
    """The carried states are a small set, whatever the length."""
    seen, todo = set(), [((0, 0), None, None, None)]
    while todo:
        now = todo.pop()
        if now not in seen:
            seen.add(now)
            todo += [conversations.step(now, i, f)[0] for i in ("s", "u", "a", "x") for f in range(4)]
    assert len(seen) < 2000


TEXTS = ["a <|endoftext|> b", "x<|startoftext|>y", None, "", " ", "\t\x0b\x1c\x85\u00a0\u3000z", "e\u0301 \u0301x A\u030a \u212b", "ΣΑΣ ΟΔΟΣ. İI", "don't I'LL we've 's", "가각 \u1100\u1161\u11a8",
         "x" * 5000, "ab1234567 " * 3000, " line\r\nfeed\x00 nul", "😀😀 ☂️", "\ufeffbom"]


@pytest.fixture(scope="module")
def texts():
    rng, letters = random.Random(1), "abcDEF  \n\t.,'!12é\u0301 <|>ßΣσς"
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))) for i in range(200)]
    return rows + [(None, "n one"), (None, None), (7, "again"), (7, "again"), (2**62, "big id")]


def test_token_files(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 1 << 13)  # many files
    path = str(tmp_path / "t")
    token_files.write(with_others(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)), path)
    got = sorted(token_files.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    encode = lambda t: plain.encode(t, add_special_tokens=False).ids
    assert [tuple(r)[:4] for r in got] == brute.token_rows(texts, encode)
    assert {r.doc_id: r.ids for r in got}[5] == [*encode(TEXTS[5]), 1] == token_files.fetch(spark, path, 5)[0]
    assert len(token_files.fetch(spark, path, 7)) == 3 and token_files.fetch(spark, path, -1) == []
    assert len(list((tmp_path / "t" / "shards").glob("part-*"))) > 3


def test_token_files_use_a_trained_dictionary(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(150))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.write(docs, str(tmp_path / "a"))
    assert len(token_files.kept_dictionary(spark, str(tmp_path / "a"))) > 1000
    got = sorted(map(tuple, token_files.read(spark, str(tmp_path / "a")).collect()))
    plain = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    assert got == brute.token_rows(rows, lambda t: plain.encode(t, add_special_tokens=False).ids)


def test_token_files_nothing(spark):
    assert token_files.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_run_is_looked_up_once_for_all_its_places():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    path = public_tokenizers.path(token_files.VOCABULARY)
    encoder, text = token_files.Encoder(path), "one two, three\nfour"
    encoder.young = Counted(encoder.young)
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    got = encoder.ids_of([text] * 500 + ["", " "])
    assert got == [np.asarray(want, "<u4").tobytes()] * 500 + [b"", b""] and encoder.ids_of([]) == []
    assert Counted.asked < 50


def test_encoder_forgets_and_stays_right(monkeypatch, texts):
    path = public_tokenizers.path(token_files.VOCABULARY)
    plain = Tokenizer.from_file(path)
    more = [*[t or "" for _, t in texts], "Stop, then. go;now! \u0301. e\u0301, É. <|ENDOFTEXT|> <|endoftext|>. don't. it's,", "THE End. of, It", "a.b. c", "x.\ty,\r\nZ."]
    want = [b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids) for t in more]
    assert token_files.Encoder(path).ids_of(more) == want
    monkeypatch.setattr(token_files, "REMEMBERED", 20)
    small = token_files.Encoder(path)
    assert [small.ids_of([t])[0] for t in [*more, *more]] == [*want, *want]
