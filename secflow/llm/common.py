"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.session import checkpoint_dir

#: Java patterns of the characters between words.
SPACES = r"[\x20\x09-\x0D]+"
NO_LETTERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A group above one part in so many of all rows is hot; there are fewer than so many hot groups.
HOT_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder of the session and read back, so that later jobs and
    retried tasks start from files and not from the whole lineage."""
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words_of(text: Column, between: str = SPACES) -> Column:
    """The words of a text as an array without empty entries."""
    return F.array_remove(F.split(text, between), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case; all other characters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def keyed(docs: DataFrame, text: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint of the text, text): rows with an equal id and text are the same document,
    so results that are joined back by (id, fingerprint) stay right when ids repeat."""
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("fp", F.xxhash64("text"))


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality of columns."""
    cond = F.lit(True)
    for name in names:
        cond = cond & left[name].eqNullSafe(right[name])
    return cond


def join_split(left: DataFrame, right: DataFrame, key: str | list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row for each key) where some keys of ``left`` are hot.

    ``counts`` is (key, n) with the rows of ``left`` by key. Fewer than ``HOT_PARTS`` keys can hold more
    than one part in ``HOT_PARTS`` of all rows, so their rows of ``right`` are broadcast with a proven
    bound; all other keys go through an ordinary shuffled join.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    names = [key] if isinstance(key, str) else key
    hot = counts.where(F.col("n") > max(1000, total // HOT_PARTS)).select(*names)
    hot_right = right.join(F.broadcast(hot), key, "left_semi")
    flagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    cool = flagged.where(F.col("_hot").isNull()).drop("_hot").join(right, key, how)
    return cool.unionByName(flagged.where("_hot").drop("_hot").join(F.broadcast(hot_right), key, how))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (u, v): the smallest node that each node reaches.

    Large-star and small-star rounds: neighbours are moved to the smallest one around a node, until nothing
    moves. The state is the edges; minima are combined before the shuffle, hot nodes are split."""
    edges = stage(links.select("u", "v").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = stage(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = stage(starred(both, F.col("v") > F.col("u")))
        edges = stage(starred(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), F.lit(True)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    low = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return nodes.join(low, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def starred(edges: DataFrame, moved) -> DataFrame:
    """Edges (u, v) with the chosen neighbours, and u itself, moved to the smallest node around u."""
    edges = stage(edges.distinct())
    around = stage(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
    kept = join_split(edges.where(moved), around.select("u", "m"), "u", around.select("u", "n"))
    out = kept.select(F.col("m").alias("u"), "v").unionByName(around.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return out.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
