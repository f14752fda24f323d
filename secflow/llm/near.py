"""Near-duplicate documents by one-permutation hashing.

The set of a document is its distinct word shingles (a shorter text is one shingle). One hash
of every shingle gives a bin and a value; the smallest value of each bin is the signature, and an empty
bin takes the value of the first filled bin in its own fixed random order (optimal densification). Bands
of the signature are bucket keys. In a bucket, every document is compared with one hub only: the member
whose bands are the most popular, which is the text that the others were copied from where there is one.
So a bucket of n documents gives n - 1 pairs. Pairs are confirmed on the full sets. Then every pair of other
members of a bucket that the links so far don't join is compared too: members are dealt in blocks, and a pair
of blocks is one product of their shingle tables, so no row is made for a pair.

Equal sets are joined before the bands, so copies cost one row each.

Recall: with 48 bands of 8 bins a pair at the threshold 0.85 shares a bucket with probability 1 - 2e-7.
No pair of one bucket is left out: it is compared, joined by other links, or too unlike in size.

Defined cases: null and empty texts, and texts without words, have no set and are linked with nothing; rows
with equal ids are one document; a null id is never linked and is kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import HOT_PARTS, components, join_split, stage, whole_text

#: Bins of a signature: bands times rows of every measure.
BINS = 384
#: Members of a hub that one task compares.
BLOCK = 512
#: Members of a bucket in a block, shingles of a table that are multiplied at once.
SIDE, WIDE = 256, 8192
#: Texts that are signed together, words whose hash a worker remembers.
SLICE, REMEMBERED = 2000, 400_000
U = np.uint64


@dataclass(frozen=True)
class Measure:
    """What is near: shingle length, least similarity in hundredths, and the bands that find it."""

    shingle: int = 3
    near: int = 85
    bands: int = 48

    @property
    def rows(self) -> int:
        return BINS // self.bands


#: The usual measure of word shingles: a pair at 0.8 shares none of the 64 bands of 6 with probability 4e-9.
FIVE_WORDS = Measure(5, 80, 64)
NONE = np.iinfo(np.uint64).max
words: dict[bytes, int] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles. bytes.lower() changes A-Z only, and
    bytes.split() splits at the six white space characters of ASCII."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, U)
    if len(words) > REMEMBERED:
        words.clear()
    for w in set(found).difference(words):
        words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(words.__getitem__, found), dtype=U, count=len(found))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, U(k))
    for i in range(k):
        out = mix(out + h[i : len(h) - k + 1 + i])
    return np.unique(out)


@lru_cache(maxsize=1)
def orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which it looks for a filled bin, and the rank of each bin in that order."""
    keys = mix(np.arange(BINS * BINS, dtype=U) + U(0x9E3779B9)).reshape(BINS, BINS)
    order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
    return order, np.argsort(order, axis=1, kind="stable").astype(np.int32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BINS`` values for each non-empty set."""
    order, rank = orders()
    sig = np.full((len(sets), BINS), NONE, dtype=U)
    for row, s in zip(sig, sets, strict=True):
        h = mix(s + U(0x5851F42D4C957F2D))
        placed = np.sort(((h >> U(40)) % U(BINS) << U(40)) | (h & U((1 << 40) - 1)))
        bins = (placed >> U(40)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        row[bins[first]] = placed[first]
    filled = sig != NONE
    few = filled.sum(1) <= 48
    for i in np.flatnonzero(few):
        have = np.flatnonzero(filled[i])
        pick = have[rank[:, have].argmin(1)]
        sig[i] = np.where(filled[i], sig[i], sig[i][pick])
    at, col = np.nonzero(~filled & ~few[:, None])
    step = 0
    while len(at):
        source = order[col, step]
        ok = filled[at, source]
        sig[at[ok], col[ok]] = sig[at[ok], source[ok]]
        at, col, step = at[~ok], col[~ok], step + 1
    return sig


def band_keys(sig: np.ndarray, measure: Measure) -> np.ndarray:
    key = np.tile(np.arange(measure.bands, dtype=U), (len(sig), 1))
    for r in range(measure.rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, r :: measure.rows])
    return key.view(np.int64)


def signed(docs: DataFrame, measure: Measure, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set_key, bands): set size, digest of the set and bucket keys; null digest without words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                part = batch.iloc[i : i + SLICE]
                sets = [shingles(t, measure.shingle) for t in part["text"]]
                some = [j for j, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                for j, b in zip(some, band_keys(signatures([sets[j] for j in some]), measure) if some else [], strict=True):
                    keys[j], bands[j] = hashlib.blake2b(sets[j].tobytes(), digest_size=16).digest(), b
                yield pd.DataFrame({"id": part["id"], "n": [len(s) for s in sets], "set_key": pd.Series(keys, dtype=object, index=part.index),
                                    "bands": pd.Series(bands, dtype=object, index=part.index)})

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInPandas(run, "id string, n long, set_key binary, bands array<long>").withColumn("id", F.expr("try_cast(id as long)"))


def buckets(rows: DataFrame) -> DataFrame:
    """(band, id, n, pop) of buckets with two different sets or more; pop is the sum of a document's bucket sizes."""
    each = rows.select("id", "n", F.explode("bands").alias("band"))
    sizes = stage(each.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    met = stage(join_split(each, sizes, "band", sizes.select("band", F.col("k").alias("n"))))
    pop = met.groupBy("id").agg(F.sum("k").alias("pop"))
    return stage(met.join(pop, "id").select("band", "id", "n", "pop"))


def hubs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, hub, hub_n, k) of each bucket, and its ``members`` but the hub, with ``hub`` and ``hub_n``."""
    best = members.groupBy("band").agg(F.max(F.struct("pop", (-F.col("id")).alias("low"), "n")).alias("h"), F.count(F.lit(1)).alias("k"))
    best = stage(best.where("k > 1").select("band", (-F.col("h.low")).alias("hub"), F.col("h.n").alias("hub_n"), "k"))
    met = join_split(members, best.drop("k"), "band", best.select("band", F.col("k").alias("n")))
    return best, stage(met.where("id <> hub"))


def confirmed(pairs: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """The (hub, id) whose full sets are near. A hub's members are compared in blocks of about ``BLOCK``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, np.empty(0, U)
        for batch in batches:
            ok = []
            for hub, hub_text, text in zip(batch["hub"], batch["hub_text"], batch["text"], strict=True):
                if last != hub:
                    last, mine = hub, shingles(hub_text, measure.shingle)
                other = shingles(text, measure.shingle)
                same = len(np.intersect1d(mine, other, assume_unique=True))
                ok.append(100 * same >= measure.near * (len(mine) + len(other) - same))
            yield batch.loc[ok, ["hub", "id"]]

    counts = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.count()
    hot = stage(counts.where(F.col("n") > max(BLOCK, total // HOT_PARTS)))  # fewer than HOT_PARTS rows
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    left = pairs.join(F.broadcast(hot), "hub", "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks)).drop("n")
    hub_texts = texts.join(pairs.select(F.col("hub").alias("id")).distinct(), "id").withColumnsRenamed({"id": "hub", "text": "hub_text"})
    hub_texts = hub_texts.join(F.broadcast(hot), "hub", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("block", F.col("block").cast("long")).drop("n")
    met = left.join(texts, "id").join(hub_texts, ["hub", "block"])
    return met.select("hub", "id", "hub_text", "text").mapInPandas(run, "hub long, id long").distinct()


def unsettled(best: DataFrame, met: DataFrame, found: DataFrame) -> DataFrame:
    """Members, without hubs, of the buckets that ``found`` doesn't join into one component: (band, p, q, block, id,
    n, component), a row for each pair of blocks (p, q) that a member's block is in. The hub's component isn't
    compared with itself. Buckets of the same members count once."""
    groups = stage(components(found.select(F.col("hub").alias("u"), F.col("id").alias("v"))))
    mine = met.join(groups, met["id"] == groups["node"], "left").select("band", "id", "n", F.coalesce("component", "id").alias("component"))
    mine = stage(mine)
    homes = best.join(groups, best["hub"] == groups["node"], "left").select("band", F.coalesce("component", "hub").alias("home"))
    parts = mine.groupBy("band", "component").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"))
    away = F.coalesce(F.sum(F.when(F.col("component") != F.col("home"), F.col("c"))), F.lit(0))
    each = parts.join(homes, "band").groupBy("band", "home").agg(F.sum("c").alias("k"), away.alias("away"), F.count(F.lit(1)).alias("kinds"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"))
    one = each.where("kinds > 1").groupBy("k", "s", "x").agg(F.min(F.struct("band", "home", "away")).alias("b"))
    one = stage(one.select("b.band", "b.home", "b.away", "k"))
    rows = join_split(mine, one, "band", one.select("band", F.col("k").alias("n")))
    few = F.col("k") <= SIDE
    outer = F.when(few, 1).otherwise(F.ceil(F.col("away") / SIDE)).cast("int")
    inner = F.when(few, 0).otherwise(F.ceil((F.col("k") - F.col("away")) / SIDE)).cast("int")
    at_home = ~few & (F.col("component") == F.col("home"))
    rows = rows.withColumn("outer", outer).withColumn("all", F.col("outer") + inner).withColumn("at_home", at_home)
    place = F.when(F.col("at_home"), F.col("outer") + F.pmod(F.xxhash64("id"), F.col("all") - F.col("outer"))).otherwise(F.pmod(F.xxhash64("id"), F.col("outer"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("at_home"), F.col("outer")).otherwise(F.col("all")) - 1)
    rows = rows.withColumn("block", place).withColumn("other", F.explode(others))
    return rows.select("band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "n", "component")


def held(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    """Which of ``some`` sorted shingles each set has, as a table of 0 and 1."""
    out = np.zeros((len(sets), len(some)), np.float32)
    for row, s in zip(out, sets, strict=True):
        s = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], "right")]
        at = np.searchsorted(some, s)
        row[at[some[at] == s]] = 1
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each set of one side shares with each of the other; without ``right``, the sets of one side
    with one another (the diagonal isn't filled). Shingles of a single set don't matter and are dropped."""
    if right is None:
        found, n = np.unique(np.concatenate(left), return_counts=True)
        both = found[n > 1]
    else:
        both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(left if right is None else right)), np.float32)
    for i in range(0, len(both), WIDE):
        a = held(left, both[i : i + WIDE])
        out += a @ (a if right is None else held(right, both[i : i + WIDE])).T
    return out.astype(np.int64)


def joined(part: pd.DataFrame, measure: Measure) -> list[tuple[int, int]]:
    """Links (u, v) that join the components of the members of one pair of blocks as all its near pairs do."""
    alone = part["p"].iat[0] == part["q"].iat[0]
    sides = [part] if alone else [part[part["block"] == part["p"]], part[part["block"] == part["q"]]]
    n, c = [x["n"].to_numpy() for x in sides], [x["component"].to_numpy() for x in sides]
    fits = np.minimum(n[0][:, None], n[-1]) * 100 >= np.maximum(n[0][:, None], n[-1]) * measure.near
    fits &= c[0][:, None] != c[-1]
    if not fits.any():
        return []
    rows, cols = fits.any(1), fits.any(0)
    sets = [[shingles(t, measure.shingle) for t in x["text"][keep]] for x, keep in zip(sides, (rows, cols))]
    size = [np.array([len(s) for s in x]) for x in sets]
    same = overlaps(sets[0], None if alone else sets[1])
    near = fits[np.ix_(rows, cols)] & (100 * same >= measure.near * (size[0][:, None] + size[-1] - same))
    ids, of = [x["id"].to_numpy()[k] for x, k in zip((sides[0], sides[-1]), (rows, cols))], (c[0][rows], c[-1][cols])
    low: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := low.get(x, x)) != x:
            low[x] = low.get(y, y)
            x = y
        return x

    out = []
    for i, j in np.argwhere(near):
        a, b = find(int(of[0][i])), find(int(of[1][j]))
        if a != b:
            low[max(a, b)] = min(a, b)
            out.append((int(ids[0][i]), int(ids[1][j])))
    return out


def crossed(rows: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """Links (u, v) between members of different components in the pairs of blocks of ``rows``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, parts = None, []
        for batch in batches:
            out = []
            for key, part in batch.groupby(["band", "p", "q"], sort=False):
                if key != last and parts:
                    out += joined(pd.concat(parts), measure)
                    parts = []
                last = key
                parts.append(part)
            yield pd.DataFrame(out, columns=["u", "v"])
        if parts:
            yield pd.DataFrame(joined(pd.concat(parts), measure), columns=["u", "v"])

    met = rows.join(texts, "id").repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    return met.select("band", "p", "q", "block", "id", "n", "component", "text").mapInPandas(run, "u long, v long").distinct()


def links(rows: DataFrame, docs: DataFrame, measure: Measure, id_col: str, text_col: str) -> DataFrame:
    """Confirmed (u, v) that join documents with different sets as all near pairs of the buckets do. ``rows`` has
    one row for each set."""
    members = buckets(rows)
    # texts are moved once: those of documents in a bucket
    texts = stage(docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).join(members.select("id").distinct(), "id"))
    best, met = hubs(members)
    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * measure.near
    found = stage(confirmed(stage(met.where(fits).select("hub", "id").distinct()), texts, measure))
    more = stage(crossed(stage(unsettled(best, met, found)), texts, measure))
    return found.select(F.col("hub").alias("u"), F.col("id").alias("v")).unionByName(more)


def classes(docs: DataFrame, measure: Measure = Measure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows = stage(signed(docs, measure, id_col, text_col))
    sets = rows.where("set_key is not null and id is not null").groupBy("set_key").agg(
        F.min(F.struct("id", "n", "bands")).alias("one"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"))
    sets = stage(sets.select("set_key", "one.id", "one.n", "one.bands", "copies"))
    # rows with one id are one document, also if their texts differ
    together = rows.where("set_key is not null and id is not null").select("id", "set_key").distinct()
    reps = together.join(sets.select("set_key", F.col("id").alias("rep")), "set_key") if has_repeats(rows) else None
    found = links(sets, docs, measure, id_col, text_col)
    if reps is not None:
        found = found.unionByName(reps.select(F.col("id").alias("u"), F.col("rep").alias("v")))
    groups = components(found)
    label = sets.join(groups, sets["id"] == groups["node"], "left").select("set_key", F.coalesce("component", "id").alias("component"))
    label = stage(label)
    with_set, without = rows.where("set_key is not null").drop("bands"), rows.where("set_key is null")
    met = join_split(with_set, label, "set_key", sets.select("set_key", F.col("copies").alias("n")))
    done = met.select("id", "n", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")).unionByName(
        without.select("id", "n", F.col("id").alias("component")))
    return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                       F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def has_repeats(rows: DataFrame) -> bool:
    return not rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()


def one_of_each(docs: DataFrame, measure: Measure = FIVE_WORDS, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id."""
    gone = stage(classes(docs, measure, id_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
