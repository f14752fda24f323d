"""Every operator against brute force on nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from secflow.llm import byte_bpe, decontaminate, near, privacy, quality, shards, substrings, suffixes, toxicity, warc
from tests.llm import brute

VOICE = "alpha bravo carbon delta ember fjord gamma harbor indigo jungle kernel lantern meadow nickel orbit pepper quartz river sigma timber umber violet walnut yonder zephyr".split()
CLASH = ("w", "fp", "id", "n", "band", "key", "size", "spans", "score", "start", "_t", "_fp", "anchor", "hub", "ids", "gone")


def prose(rng, n):
    return " ".join(rng.choice(VOICE) + rng.choice(["", "ing", "ed", "s", ","]) for _ in range(n))


def texts_of(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    shared = prose(rng, 90)
    out = [None, "", " \n\t ", "one", "two words", "Two WORDS", "é" * 300, "die " * 120, "a\n" * 40, prose(rng, 9000)]
    out += base + base[:6] + [base[0] + " end", "Start " + base[1].upper()]
    out += [prose(rng, 20) + " " + shared + " " + prose(rng, 20) for _ in range(8)]
    out += [b.replace(" ", "  ", 1) for b in base[10:14]]
    for b in base[20:30]:
        w = b.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += ["Zeile\r\nmit \x0b Tab\t\x0c und   hart   weit \U0001f600 " * 12, "x" * 900, "x" * 901 + "y", "# $ % | <b> " * 30]
    return out


def frame(spark, rows):
    """doc_id and text with other columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("other") for c in CLASH})


@pytest.fixture(scope="module")
def rows():
    texts = texts_of()
    return list(enumerate(texts)) + [(3, texts[3]), (20, texts[20])]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_quality(docs, rows, none):
    ledger = quality.ledger(docs)
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judged(ledger).collect())
    assert got == sorted((i, *brute.quality(t)) for i, t in rows)
    judged = quality.judged(ledger).collect()
    assert all(not r.kept for r in judged if r.base_failed)
    one = {r.rule: r for r in quality.ablations(ledger).collect()}
    mask = quality.PRODUCTION.required
    assert one["symbols"].only_this == sum(r.fail_bits & mask == quality.BIT["symbols"] for r in judged)
    assert one["too_short"].failed == sum(bool(r.fail_bits & quality.BIT["too_short"]) for r in judged)
    assert quality.judged(quality.ledger(none)).count() == 0


def test_shards(spark, docs, rows, none):
    got = shards.assign(docs.where("doc_id <> 9"), 6).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows if i != 9)
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(6)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    for s in range(6):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r["size"] == len((dict(rows)[r.doc_id] or "").encode()) + 8 for r in got)
    # one text holds most rows: the group has to be cut, the law still holds
    hot = frame(spark, [(i, "same text" if i % 10 else f"own text {i}") for i in range(3000)])
    counts = shards.assign(hot, 24).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(counts) == 24 and max(r.b for r in counts) <= 1.02 * min(r.b for r in counts)
    assert shards.assign(none).count() == 0
    assert shards.assign(frame(spark, [(None, None), (None, "a"), (-(1 << 63), "b"), ((1 << 63) - 1, "b")]), 2).count() == 4


def test_write_shards(spark, docs, rows, tmp_path):
    shards.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.select("_shard").distinct().count() == 4


def chance(scores, moves):
    """Marginal odds of state 1 by summing over all paths."""
    n, total = len(scores), np.zeros((len(scores), 2))
    for path in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(s for s, y in zip(scores, path) if y) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        for i, y in enumerate(path):
            total[i, y] += p
    return np.log(total[:, 1] / total[:, 0])


def test_chain_marginals():
    rng = np.random.default_rng(3)
    lengths, moves = np.array([3, 1, 6, 0, 5]), rng.normal(size=(2, 2))
    scores = rng.normal(size=lengths.sum()) * 2
    starts = np.cumsum(lengths) - lengths
    got = toxicity.log_odds(scores, starts, lengths, moves)
    for s, n in zip(starts, lengths):
        if n:
            assert np.allclose(got[s : s + n], chance(scores[s : s + n], moves))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        words = prose(rng, rng.randint(20, 90)).split(" ")
        if i % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["blockhead", "vermin", "nitwit", "dreckkerl", "dreckhaufen", "drecksau"])
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    return rows, labels


def test_toxicity(spark, labelled, none):
    rows, labels = labelled
    docs = frame(spark, rows + [(1000, None), (1001, ""), (1002, "12 .. 34"), (1003, "a " * 30_000 + "vermin nitwit vermin")])
    chain = toxicity.fit(docs, labels, ~toxicity.held_out())
    assert isinstance(chain.weights, dict)
    scored = toxicity.score(docs.select("doc_id", "text"), chain).withColumn("held_out", toxicity.held_out()).collect()
    assert len(scored) == 904 and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id < 1000]
    assert sum((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in scored}
    assert by[1000].score < 0.3 and by[1001].score == by[1000].score and by[1002].spans == []
    assert by[1003].spans[-1].end == 60_000 + len("vermin nitwit vermin")
    text = dict(rows)[0]
    assert {text[s.start : s.end] for s in by[0].spans} <= {"blockhead", "vermin", "nitwit", "dreckkerl", "dreckhaufen", "drecksau"}
    kept = {r.doc_id for r in toxicity.clean_rows(docs, chain).collect()}
    assert kept == {r.doc_id for r in scored if r.score < 0.3}
    assert toxicity.score(none.select("doc_id", "text"), chain).count() == 0
    untaught = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs.select("doc_id", "text").limit(3), untaught).collect()} == {0.0}


def test_byte_bpe(spark, docs, rows, none):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path(byte_bpe.VOCABULARY)
    ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode(docs.select("doc_id", "text")).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((i, want.encode_ordinary(t or "")) for i, t in rows)
    digests = {r.doc_id: r for r in byte_bpe.digests(docs.select("doc_id", "text")).collect()}
    for i, t in rows:
        ids = want.encode_ordinary(t or "")
        assert tuple(digests[i])[1:] == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or ""))
    back = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"))).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert byte_bpe.digests(none).count() == 0
    assert "ids" in byte_bpe.checked(docs).columns


def test_byte_bpe_random():
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path(byte_bpe.VOCABULARY)
    ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(byte_bpe.build(path))
    rng = random.Random(9)
    pool = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070), 0x180E, 0x3000, 0xFEFF, 0x1F600, 0x4E00, 0x0E01, 0x0660, 0x1D7D8)] + list(" \n\t'stredmvl") * 20
    for _ in range(800):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        ids = codec.encode(text)
        assert ids == want.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_warc(spark):
    rng = random.Random(2)
    big = prose(rng, 300)
    magic = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    html = [None, "", "small", "small", big, big, big + magic + big, magic * 30 + big, big + "\r\n\r\n", "WARC/1.0\r\n", big + magic + big, "é\u0000\n" * 400]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nWARC-Type: x" if i % 3 else None, h, "other") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.round_trip(pages.repartition(3)).collect()}
    assert sorted(got) == list(range(len(html)))
    for i, h in enumerate(html):
        data = (h or "").encode()
        keeper = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        revisit = len(data) >= 1000 and keeper != i
        r = got[i]
        assert (r.kind, r.refers_to) == (("revisit", keeper) if revisit else ("response", None))
        assert (r.full if revisit else r.length) == len(data)
        assert (r.digest if revisit else r.sha1) == hashlib.sha1(data).hexdigest()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_payloads(spark, tmp_path):
    html = ["plain", "WARC/1.0\r\n" * 5 + "x" * 2000, None]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").withColumn("url", F.lit("u"))
    warc.write(pages, str(tmp_path / "a"))
    got = {r.page_id: bytes(r.payload) for r in warc.payloads(spark, str(tmp_path / "a")).collect()}
    assert got == {i: (h or "").encode() for i, h in enumerate(html)}


def test_warc_urls(spark):
    """A url of 100 KB and one that ends in the magic, with further records behind them in one file."""
    urls = ["https://a.example/" + "q" * 100_000, "https://a.example/WARC/1.0", "https://a.example/WARC/1.0/b"]
    rows = [(i, urls[i] if i < 3 else "https://a.example/x", f"page {i}") for i in range(8)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert sorted((r.page_id, r.sha1) for r in got) == [(i, hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows]


def test_decontaminate(spark, rows, docs, none):
    texts = dict(rows)
    items = [(1, texts[15]), (2, "Two words"), (3, None), (4, "... !!"), (5, texts[15]), (6, " ".join(texts[80].split()[30:60])), (10, "one"), (11, "alpha bravo carbon delta ember fjord gamma harbor indigo jungle absent")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("other") for c in CLASH})
    got = decontaminate.contamination(docs, bench)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, brute.sha(",".join(r["items"])), r.n_hit > 0) for r in got.collect())
    want = brute.decontaminate([t for _, t in rows], items)
    assert got == sorted((i, *w) for (i, _), w in zip(rows, want))
    assert sum(w[4] for w in want) >= 5
    kept = sorted(r.doc_id for r in decontaminate.clean_rows(docs, bench).collect())
    assert kept == sorted(i for (i, _), w in zip(rows, want) if not w[4])
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.contamination(none, bench).count() == 0


def test_suffixes(docs, rows, none):
    got = sorted(tuple(r) for r in suffixes.deduplicated(docs).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, brute.bytes_removed([t for _, t in rows])))
    assert sum(r[2] for r in got) > 10_000
    assert suffixes.deduplicated(none).count() == 0


def test_suffixes_large_anchor(docs, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "LIMIT", 1)
    got = sorted(tuple(r) for r in suffixes.deduplicated(docs).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, brute.bytes_removed([t for _, t in rows])))


def test_run_index():
    rng = random.Random(4)
    for case in range(60):
        letters = b"ab" if case % 2 else b"abcdefgh\x00\xff"
        segments = list({bytes(rng.choice(letters) for _ in range(rng.randint(1, 30))) * rng.randint(1, 3) for _ in range(rng.randint(1, 5))})
        index, starts = suffixes.build(segments)
        got = index.statistics()
        assert index.lengths.sum() == index.size
        for i, s in enumerate(segments):
            for p in range(len(s)):
                best = max((next((k for k in range(len(s)) if p + k >= len(s) or q + k >= len(o) or s[p + k] != o[q + k]), len(s))
                            for j, o in enumerate(segments) for q in range(len(o)) if (i, p) != (j, q)), default=0)
                assert got[starts[i] + p] == best


def test_substrings(docs, rows, none):
    got = sorted(tuple(r) for r in substrings.deduplicated(docs).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, brute.words_removed([t for _, t in rows])))
    assert sum(r[2] for r in got) > 1000
    kept = substrings.kept_texts(docs).collect()
    by = {r[0]: r for r in got}
    assert all(brute.sha(r.text) == by[r.doc_id][3] for r in kept)
    assert substrings.deduplicated(none).count() == 0


def test_privacy(spark, docs, rows, none):
    rng = random.Random(8)
    parts = list("abZ09.@-+ %_()1234567890@..  ") + ["a@b.co", "+1 (234) 555-6789", "4111 1111 1111 1111", "10.0.0.1", "256.1.1.1", "", "", "é", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "1" * 30_000, "a" * 40_000 + "@", "1 " * 10_000, "a." * 10_000 + "@" + "b." * 10_000 + "c", "1.2.3.4" * 1500, "x@a.b.c%d@e.f"]
    got = {r.id: r.found for r in privacy.spans(frame(spark, list(enumerate(texts)))).select("id", privacy.listed(F.filter("spans", lambda x: x["kind"] < 4)).alias("found")).collect()}
    assert got == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in brute.private(t)) for i, t in enumerate(texts)}
    assert sum(bool(v) for v in got.values()) > 100
    assert privacy.sanitise(none).count() == 0
    same = privacy.sanitise(docs)
    assert sorted((r.doc_id, r.text or "") for r in same.collect()) == sorted((i, t or "") for i, t in rows)
    assert same.columns == docs.columns


def test_privacy_terms(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 30)) for i in range(150)]
    rows += [(200 + i, prose(rng, 8) + f" Wintergreen {rng.choice(VOICE)} boss@corp.example.org " + prose(rng, 8)) for i in range(12)]
    rows += [(300, "A note on Wintergreen, no address"), (301, "Wintergreens aren't meant")]
    rows += [(400 + i, "Copied Summerfield chief@firm.example.org text") for i in range(20)]  # copies prove nothing
    docs = frame(spark, rows)
    assert {r.term for r in privacy.disclosing(privacy.found(privacy.keyed(docs, privacy.whole_text()))).collect()} == {"Wintergreen"}
    done = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert done[300] == "A note on [REMOVED], no address" and done[301] == rows[-21][1]
    assert done[400] == "Copied Summerfield [EMAIL] text"
    assert all("Wintergreen " not in t and "boss" not in t for i, t in done.items() if 200 <= i < 300)


def disclosed(spark, rows):
    return {r.term for r in privacy.disclosing(privacy.found(privacy.keyed(frame(spark, rows), privacy.whole_text()))).collect()}


def test_privacy_footer(spark):
    """One footer, the same around the value for more than its surroundings, in many different documents."""
    rng = random.Random(9)
    footer = " sent from the northern office of our house where every letter is answered Contact Jane Wintergreen boss@corp.example.org on weekdays before noon or write to the registry of the house by the old harbour "
    rows = [(i, prose(rng, 30)) for i in range(150)] + [(200 + i, prose(rng, 12) + footer + prose(rng, 12)) for i in range(12)]
    assert "Wintergreen" in disclosed(spark, rows)
    assert disclosed(spark, rows[:150] + [(200 + i, rows[150][1]) for i in range(12)]) == set()


def test_privacy_edges(spark):
    """Terms at the start and end of a text, and terms with digits."""
    rng = random.Random(10)
    rows = [(i, prose(rng, 30)) for i in range(150)]
    rows += [(200 + i, f"Wintergreen, boss@corp.example.org {i}") for i in range(8)] + [(300 + i, f"{i} chief@firm.example.org Summerfield") for i in range(8)]
    rows += [(400 + i, f"{prose(rng, 6)} emp4711 {rng.choice(VOICE)} clerk@desk.example.org {prose(rng, 6)}") for i in range(8)]
    assert disclosed(spark, rows) >= {"Wintergreen", "Summerfield", "emp4711"}


def test_near(spark, docs, rows, none):
    want = brute.near(rows)
    got = near.classes(docs)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == sorted((i, *want[i], i == want[i][1]) for i, _ in rows)
    assert len({c for _, c in want.values()}) < len(want) - 8
    five = brute.near(rows, 5, 80)
    kept = {r.doc_id for r in near.one_of_each(docs).collect()}
    assert kept == {i for i, (_, c) in five.items() if i == c}
    assert near.classes(none).count() == 0
    lone = near.classes(frame(spark, [(None, "a b c d"), (None, "a b c d"), (5, None)])).collect()
    assert all(r.kept for r in lone)


def test_near_hub(spark):
    """Copies that are near their source but not near each other are one class, and a large class of equal texts stays whole."""
    rng = random.Random(11)
    source = prose(rng, 300).split(" ")
    rows = [(900, " ".join(source))] + [(2000 + i, "equal words in every row of a large class") for i in range(1500)]
    for i in range(40):
        w = list(source)
        for p in rng.sample(range(300), 11):
            w[p] = f"new{i}x{p}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near.classes(frame(spark, rows)).collect()}
    want = brute.near([r for r in rows if r[0] < 2000])
    assert {i: got[i] for i in want} == {i: c for i, (_, c) in want.items()}
    assert {got[i] for i in range(2000, 3500)} == {2000}


def swapped(rng, words, n):
    """``words`` with ``n`` of them changed."""
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**9)}"
    return out


def test_near_chain(spark):
    """Near pairs whose members are both near no hub: in a chain, and among pages of one template."""
    rng = random.Random(8)
    words = prose(rng, 400).split(" ")
    page = [f"w{k}" for k in range(200)]
    rows, chain = [], words
    for i in range(12):
        rows.append((i, " ".join(chain)))
        chain = swapped(rng, chain, 8)
    rows += [(100 + i, " ".join(swapped(rng, page, 9))) for i in range(700)]
    for i in range(5):  # pairs far from the other pages
        one = swapped(rng, page, 10)
        rows += [(1000 + 2 * i, " ".join(one)), (1001 + 2 * i, " ".join(swapped(rng, one, 4)))]
    want = brute.near(rows)
    got = {r.doc_id: r.component_id for r in near.classes(frame(spark, rows).repartition(4)).collect()}
    assert got == {i: w[1] for i, w in want.items()}
    assert all(got[1001 + 2 * i] == 1000 + 2 * i for i in range(5)) and len(set(got.values())) > 500


def test_near_one_bucket(spark):
    """Members of a bucket that are near each other and not near its hub: where the hub is near none, and in a chain."""
    rng = random.Random(12)
    a, x = prose(rng, 200).split(" "), prose(rng, 200).split(" ")
    b = a[:-10] + [f"b{k}" for k in range(10)]
    c = [f"c{k}" for k in range(10)] + b[10:]
    rows = [(0, prose(rng, 200)), (1, " ".join(x)), (2, " ".join(x[:-5]) + " end"), (10, " ".join(a)), (11, " ".join(b)), (12, " ".join(c))]
    sets = spark.createDataFrame([(i, brute.near([(i, t)])[i][0], [i // 10]) for i, t in rows], "id long, n long, bands array<long>")
    got = near.links(sets, frame(spark, rows), near.Measure(), "doc_id", "text").collect()
    want = brute.near(rows)
    assert {i: w[1] for i, w in want.items()} == {0: 0, 1: 1, 2: 1, 10: 10, 11: 10, 12: 10}
    assert {tuple(sorted((r.u, r.v))) for r in got} == {(1, 2), (10, 11), (11, 12)}
