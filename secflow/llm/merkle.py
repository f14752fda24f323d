"""Merkle manifest of a data set by cogrouped subtree exchange.

Every row is a leaf. The leaves of one tree (a language) stand in order of their ids; runs of two become their
digest, level by level, until one node remains, the subroot. Subroots by language go the same way to the root.

A tree is cut into superblocks of ``2 ** levels`` leaves in order. A block is reduced to its top in
``applyInPandas``; the tops are the leaves of a tree that is ``2 ** levels`` times smaller, and so on. On the way
down leaves and the outer nodes that their block needs (one row for each block: the siblings from its top to the
root) are cogrouped by superblock, which finishes the local reduction, joins the proofs and folds them. No task holds more than one block,
however many rows a language has.

Places in the order come from one range exchange of the short leaves: ids number the rows of each part, and the
sizes of the parts before are added.

Defined cases: a null value is ``-`` in its leaf; null languages are a tree, which comes first; null ids come first;
rows with equal ids are ordered by their leaves, so equal rows are interchangeable; a null id isn't tampered with; a
null ``n_chars`` stays; no rows give no rows. Columns other than the five are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from secflow.llm.common import stage

#: Levels inside a superblock of the production query: it has up to 2 ** LEVELS leaves.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose checksum of the id this divides are tampered with.
TAMPER = 7
#: Steps of a proof: the sibling stands before, behind, or the node is alone in its run.
BEFORE, BEHIND, ALONE = "<", ">", "="


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(values[c]) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, node, forged): the leaf of each row, and the leaf with one character more where the
    row is tampered with (else null)."""
    own = {c: F.col(c) for c in FIELDS}
    more = own | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), "doc_id", leaf_of(own).alias("node"), F.when(hit, leaf_of(more)).alias("forged"))


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` (tree, node, ...) with ``pos``, their place in their tree by ``order``, and ``n``, the leaves of the tree."""
    names = rows.columns
    keys = ["tree", order, "node", "_tie"]  # the last splits equal rows
    sorted_ = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(sorted_.select(*names, F.monotonically_increasing_id().alias("_at")).withColumn("_part", F.shiftright("_at", 33)))
    parts = placed.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("tree").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "_part", "_low", before.alias("_before"), F.sum("_n").over(W.partitionBy("tree")).alias("n"))
    return placed.join(parts, ["tree", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_low")).select(*names, "pos", "n")


def levels_of(nodes: list[str], n: int, most: int) -> list[list[str]]:
    """The nodes of a block of a tree of ``n`` leaves, level by level up to its top, ``most`` levels above at most."""
    out = [nodes]
    for _ in range(min(most, (n - 1).bit_length())):
        below = out[-1]
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def siblings(tree: list[list[str]], i: int) -> list[str]:
    """Steps from node ``i`` of the lowest level to the top of the block."""
    out = []
    for level in tree[:-1]:
        j = i ^ 1
        out.append(ALONE if j >= len(level) else (BEFORE if j < i else BEHIND) + level[j])
        i >>= 1
    return out


def folded(node: str, path: Iterable[str]) -> str:
    for step in path:
        if step[0] == BEFORE:
            node = digest(step[1:], node)
        elif step[0] == BEHIND:
            node = digest(node, step[1:])
        else:
            node = digest(node)
    return node


def top(levels: int, block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("pos")
    n = int(block["n"].iloc[0])
    node = levels_of(block["node"].tolist(), n, levels)[-1][0]
    return pd.DataFrame({"tree": [block["tree"].iloc[0]], "node": [node], "pos": [int(block["pos"].iloc[0]) >> levels], "n": [((n - 1) >> levels) + 1]})


def paths(levels: int, block: pd.DataFrame, outer: pd.DataFrame) -> list[list[str]]:
    """The path of each node of a block: the steps inside it, then those of its top."""
    tree, beyond = levels_of(block["node"].tolist(), int(block["n"].iloc[0]), levels), list(outer["path"].iloc[0])
    return [siblings(tree, i) + beyond for i in range(len(block))]


def inner(levels: int, block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("pos")
    return pd.DataFrame({"tree": block["tree"], "pos": block["pos"], "path": paths(levels, block, outer), "subroot": outer["subroot"].iloc[0]})


def crown(levels: int, block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The path of each subroot to the root."""
    block = block.sort_values("pos")
    return pd.DataFrame({"tree": block["name"], "rest": paths(levels, block, outer), "root": outer["subroot"].iloc[0]})


def prove(levels: int, block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("pos")
    steps, leaf, root = paths(levels, block, outer), block["node"].tolist(), outer["root"].iloc[0]
    shown = [f if isinstance(f, str) else x for x, f in zip(leaf, block["forged"], strict=True)]
    out = block[["doc_id"]].assign(leaf=leaf, subroot=outer["subroot"].iloc[0], root=root, proof_sha256=[digest(*[s[1:] for s in p]) for p in steps],
                                   folded_root=[folded(x, p) for x, p in zip(shown, steps, strict=True)])
    return out.assign(verified=out["folded_root"] == root)


def cogrouped(nodes: DataFrame, outer: DataFrame, finish, schema: str, levels: int) -> DataFrame:
    """``finish`` over the nodes and the one outer row of each superblock."""
    blocks = nodes.withColumn("block", F.shiftright("pos", levels))
    above = outer.withColumnRenamed("pos", "block")
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(bound(finish, levels), schema)


def bound(finish, levels: int):
    return lambda block, outer: finish(levels, block, outer)


def outer_nodes(nodes: DataFrame, most: int, levels: int) -> DataFrame:
    """(tree, pos, path, subroot) for the superblock tops of ``nodes``, (tree, node, pos, n) with at most ``most`` in a tree."""
    slim = nodes.select("tree", "node", "pos", "n")
    tops = stage(slim.groupBy("tree", F.shiftright("pos", levels)).applyInPandas(lambda block: top(levels, block), "tree string, node string, pos long, n long"))
    if most <= 2**levels:
        return tops.select("tree", "pos", F.array().cast("array<string>").alias("path"), F.col("node").alias("subroot"))
    above = outer_nodes(tops, ((most - 1) >> levels) + 1, levels)
    return stage(cogrouped(tops, above, inner, "tree string, pos long, path array<string>, subroot string", levels))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf where there is one) and verified."""
    rows = stage(ranked(stage(leaves(docs)), "doc_id"))
    outer = outer_nodes(rows, rows.agg(F.max("n")).first()[0] or 0, levels)
    # the subroots are the leaves of one tree above all trees
    trees = stage(ranked(outer.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("node")), "name"))
    above = outer_nodes(trees, trees.agg(F.max("n")).first()[0] or 0, levels)
    ends = stage(cogrouped(trees, above, crown, "tree string, rest array<string>, root string", levels))
    full = outer.join(ends, "tree").select("tree", "pos", F.concat("path", "rest").alias("path"), "subroot", "root")
    # ids go through pandas as text, so that nulls among them don't make floats of the others
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    done = cogrouped(rows, full, prove, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", levels)
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
