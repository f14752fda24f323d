"""All list tests of all rules as one membership join: exact entries and networks, tagged by list.

What a test says depends on the tested values alone, so events are reduced to their distinct tuples of tested values. Each value is looked
up once for each list it is tested against, exactly and by network, and the lists that hold it go back to the events as one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.functions import scalars as S
from secflow.functions.predicates import fld
from secflow.operators.networks import joined_back, located, segments
from secflow.session import cut_lineage

#: The column of test names that an event's values pass.
LISTED = "_listed"
Test = tuple[str, str]


def test_name(path: str, name: str) -> str:
    return f"{path}|{name}"


def members(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """(list, value) of ``asked`` (list, value, each once) that are on their list: as an entry's text, or inside an entry that is a network."""
    entries = lists.select(F.col("list"), F.col("entry").cast("string").alias("entry")).where("list is not null and entry is not null").distinct()
    exact = asked.join(entries.withColumnRenamed("entry", "value"), ["list", "value"], "left_semi")
    cut = segments(entries, "entry", ["entry"], table=F.col("list"))
    inside = located(asked.select(S.canonical_ip(F.col("value")).alias("ip"), F.col("list").alias("table")).where("ip is not null").distinct(), "ip", cut)
    spelt = asked.withColumn("ip", S.canonical_ip(F.col("value"))).join(inside.select("ip", F.col("table").alias("list")), ["ip", "list"], "left_semi")
    return exact.select("list", "value").unionByName(spelt.select("list", "value")).distinct()


def with_lists(events: DataFrame, tests: Sequence[Test], lists: DataFrame) -> DataFrame:
    """Events with ``_listed``: the names of the ``tests`` (path, list) whose value is on the list. ``lists``: (list, entry)."""
    paths = sorted({path for path, _ in tests})
    values = {path: fld(path).cast("string") for path in paths}
    key = F.when(F.coalesce(*values.values()).isNotNull(), F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), values[p]), F.lit("")) for p in paths])))
    keyed = events.select(key.alias("key"), F.struct(*[values[p].alias(f"v{i}") for i, p in enumerate(paths)]).alias("v")).where("key is not null")
    tuples = cut_lineage(keyed.groupBy("key").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")))
    of = F.array(*[F.struct(F.lit(test_name(p, name)).alias("test"), F.lit(name).alias("list"), F.col(f"v.v{paths.index(p)}").alias("value")) for p, name in tests])
    asked = tuples.select("key", F.explode(of).alias("x")).select("key", "x.*").where("value is not null")
    hits = members(asked.select("list", "value").distinct(), lists)
    passed = asked.join(hits, ["list", "value"]).groupBy("key").agg(F.array_sort(F.collect_set("test")).alias(LISTED))
    found = cut_lineage(passed.join(tuples.select("key", "n"), "key"))
    return joined_back(events, key, found, "key", "n", [LISTED])
