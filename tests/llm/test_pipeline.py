"""The pipeline's stages against brute force, each on what the one before kept."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from secflow.llm import toxicity
from tests.llm import brute
from tests.llm.test_operators import VOICE, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(30, 90))) for i in range(400)]
    for i in range(0, 400, 5):
        words = rows[i][1].split(" ")
        for _ in range(2):
            words[rng.randrange(len(words))] = rng.choice(["blockhead", "vermin", "nitwit"])
        rows[i] = (i, " ".join(words))
    item = prose(rng, 25)
    rows += [(500, rows[1][1]), (501, rows[2][1] + " end"), (502, prose(rng, 20) + " " + item + " " + prose(rng, 20)), (503, "call +1 (234) 555-6789 or mail a.b@c.example.org today"),
             (504, None), (505, ""), (506, " "), (507, rows[3][1])]
    base = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(f"{base}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, rows, item


def test_stages(spark, tables):
    base, rows, item = tables
    docs, kept = spark.read.parquet(f"{base}/documents.parquet"), dict(rows)
    for name, apply in P.STAGES:
        out = P.stage(apply(spark, docs, base))
        if name != "tokens":
            assert out.columns == docs.columns
            got = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            chain = toxicity.fit(docs, spark.read.parquet(f"{base}/labels.parquet"), ~toxicity.held_out())
            scores = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), chain).collect()}
            assert got == {i: t for i, t in kept.items() if scores[i] < 0.3}
            assert sum((i in got) == (i % 5 != 0) for i in range(400)) >= 390
        elif name == "near_duplicates":
            low = brute.near(list(kept.items()), 5, 80)
            assert got == {i: t for i, t in kept.items() if low[i][1] == i}
            assert not {500, 501, 507} & set(got)
        elif name == "decontamination":
            hit = brute.decontaminate(kept.values(), [(1, item), (2, None)])
            assert got == {i: t for (i, t), h in zip(kept.items(), hit) if not h[4]}
            assert 502 not in got and 504 in got
        elif name == "personal_data":
            assert got[503] == "call [PHONE] or mail [EMAIL] today" and got[504] is None
            assert all(got[i] == t for i, t in kept.items() if not brute.private(t))
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
        else:
            by = {r.doc_id: r for r in out.collect()}
            assert set(by) == set(kept)
            assert all(by[i].decoded_sha256 == brute.sha(t or "") and by[i].n_tokens == len(by[i].ids) for i, t in kept.items())
            assert all(by[i].ids_sha256 == brute.sha(",".join(map(str, by[i].ids))) for i in by)
        docs, kept = out, got
    assert {r.doc_id for r in P.run(spark, base).collect()} == set(kept)


def test_empty_table(spark, tables, tmp_path):
    base = tables[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{base}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_voice_has_no_insult():
    assert not {"blockhead", "vermin", "nitwit"} & set(VOICE)
