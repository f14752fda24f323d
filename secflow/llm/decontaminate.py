"""Benchmark decontamination by a prefix-filtered set join.

An item's windows of ``WINDOW`` consecutive words are the units to be contained in a document; an item of
fewer words is one window. A window's shingles (three words, or all words of a shorter window) are ordered
by rarity: by how often they start anywhere in the documents, counted exactly. Containment needs every
shingle, so the rarest one alone is the necessary prefix of a window: a document meets a window only where
that shingle occurs. The place of the shingle in the window gives the only possible start (positional
bound), the document's words the room (length bound); what is left is verified on the words themselves.

The side of the items is broadcast only while it has at most ``FEW`` shingles, else it is shuffled.

Defined cases: null texts have no words and are never hit; items without a word have no windows; equal
windows of several items count for each of them; equal (id, text) rows get equal results; an empty
benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from secflow.llm.common import NO_LETTERS, keyed, lower_ascii, same, stage, whole_text, words_of

WINDOW = 10
SHINGLE = 3
#: Most rows of the items' side that are broadcast (32 bytes and a window's text each).
FEW = 200_000


def word_array(text_col: str = "text") -> Column:
    return words_of(lower_ascii(whole_text(text_col)), NO_LETTERS)


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (wid, wtext, m, words): wid is the digest of the window's words, m their number."""
    rows = items.select("item_id", word_array().alias("w")).where(F.size("w") > 0)
    m = F.least(F.size("w"), F.lit(size))
    rows = rows.withColumn("m", m).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("m"))))
    rows = rows.withColumn("words", F.slice("w", F.col("at") + 1, F.col("m")))
    text = F.array_join("words", " ")
    return rows.select("item_id", F.sha2(text, 256).alias("wid"), text.alias("wtext"), "m", "words")


def shingle(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def window_shingles(windows: DataFrame) -> DataFrame:
    """(wid, wtext, m, k, off, sh): every shingle of each distinct window and its place."""
    one = windows.dropDuplicates(["wid"]).select("wid", "wtext", "m", "words")
    out = None
    for k in range(1, SHINGLE + 1):
        mine = one.where(F.col("m") >= k if k == SHINGLE else F.col("m") == k)
        mine = mine.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("m") - k))).select(
            "wid", "wtext", "m", F.lit(k).alias("k"), "off", shingle(F.col("words"), F.col("off"), k).alias("sh"))
        out = mine if out is None else out.unionByName(mine)
    return out


def places(docs: DataFrame, k: int) -> DataFrame:
    """Every place of a document where ``k`` words start, with the shingle there."""
    long_enough = docs.where(F.size("w") >= k)
    at = long_enough.select("id", "fp", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("pos"))
    return at.withColumn("sh", shingle(F.col("w"), F.col("pos"), k))


def small(df: DataFrame) -> DataFrame:
    """``df``, a staged table, broadcast if its size is within the bound."""
    return F.broadcast(df) if df.count() <= FEW else df


def rarest(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The rarest shingle of each window by its exact count in the documents."""
    asked = small(stage(shingles.select("k", "sh").distinct()))
    counts = None
    for k in sorted(r["k"] for r in shingles.select("k").distinct().collect()):
        one = places(docs, k).select("sh").join(asked.where(F.col("k") == k).select("sh"), "sh").groupBy("sh").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k))
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        return shingles.limit(0)
    ranked = shingles.join(counts, ["k", "sh"], "left").fillna(0, ["n"])
    # a window with a shingle that no document has can not occur
    first = F.row_number().over(W.partitionBy("wid").orderBy("n", "sh", "off"))
    return ranked.withColumn("_r", first).where("_r = 1 and n > 0").drop("_r", "n")


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Verified (id, fp, start, m, wid) of every occurrence of a window; ``docs`` is (id, fp, w)."""
    shingles = stage(window_shingles(windows))
    prefix = stage(rarest(docs, shingles))
    side, out = small(prefix), None
    for k in range(1, SHINGLE + 1):
        wanted = side.where(F.col("k") == k).select("sh", "off", "m", "wid", "wtext")
        met = places(docs, k).join(wanted, "sh").withColumn("start", F.col("pos") - F.col("off"))
        fits = met.where((F.col("start") >= 0) & (F.col("start") + F.col("m") <= F.size("w")))
        exact = fits.where(F.array_join(F.slice("w", F.col("start") + 1, F.col("m")), " ") == F.col("wtext"))
        mine = exact.select("id", "fp", "start", "m", "wid")
        out = mine if out is None else out.unionByName(mine)
    return out


def covered(runs: Column) -> Column:
    """Words covered by a sorted array of (start, m)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["start"] + x["m"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], F.least(x["start"], end))).alias("n"))

    return F.aggregate(runs, zero, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, fp, n_words, n_hit, n_items, items (sorted as strings), runs."""
    rows = keyed(docs, whole_text(), id_col).select("id", "fp", word_array().alias("w"))
    windows = stage(item_windows(items))
    found = stage(occurrences(rows, windows).distinct())
    hit = found.groupBy("id", "fp").agg(F.sort_array(F.collect_set(F.struct("start", "m"))).alias("runs"))
    named = found.select("id", "fp", "wid").distinct().join(windows.select("wid", F.col("item_id").cast("string").alias("item")).distinct(), "wid")
    items_of = named.groupBy("id", "fp").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit = stage(hit.join(items_of, same(hit, items_of, ["id", "fp"]), "left").select(hit["id"], hit["fp"], "runs", "items"))
    sizes = rows.select("id", "fp", F.size("w").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return sizes.join(hit, same(sizes, hit, ["id", "fp"]), "left").select(
        sizes["id"].alias("doc_id"), sizes["fp"], "n_words", F.coalesce(covered(F.col("runs")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), "runs")


def clean_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an occurrence of a window."""
    rows = docs.withColumn("_fp", F.xxhash64(whole_text()))
    found = keyed(docs, whole_text()).select("id", "fp", word_array().alias("w"))
    hit = stage(occurrences(found, stage(item_windows(items))).select("id", "fp").distinct())
    return rows.join(hit, rows["doc_id"].eqNullSafe(hit["id"]) & (rows["_fp"] == hit["fp"]), "left_anti").drop("_fp")
