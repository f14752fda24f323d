"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one failure bit
for each rule; policies (a version, the rules that count and how many of them may fail) and ablations
(what would be kept without a rule) are bitwise work on the ledger and never read the texts again.

Defined cases: a null text has no words and fails the length rule; repeated rows are judged row by row;
other columns of the input are not read and may have any name. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import SPACES, stage, whole_text, words_of

SYMBOLS = "[#*$%&|<>]"
#: Rules in the order of their bits: name, and when a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("repeated_lines", "n_lines >= 3 and 10 * n_dup_lines > 4 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("few_letters", "10 * n_letter_words < 6 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_short"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    """A document is kept if none of ``required`` fails and at most ``allowed`` of ``counted`` fail."""

    version: str
    required: int
    counted: int = 0
    allowed: int = 0


POLICIES = (
    Policy("base", BASE),
    Policy("strict", sum(BIT.values())),
    Policy("production", BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["few_letters"], BIT["word_length"], 1),
)
PRODUCTION = POLICIES[-1]


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each three-word window."""
    n = F.size(words)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, measurements, ``fail_bits``; written once, as a table."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("_t"))
    rows = rows.withColumn("_w", words_of(F.col("_t"), SPACES)).withColumn("_g", window_hashes(F.col("_w")))
    # Only texts with a repeated window are sorted: equal windows are then neighbours, with their places.
    some = F.size(F.array_distinct("_g")) < F.size("_g")
    places = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_p", F.when(some, places))
    p, empty = F.col("_p"), F.array().cast("array<int>")
    twice = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))
    rows = rows.withColumn("_s", F.coalesce(F.transform(twice, lambda x: x["i"]), empty))
    inside = F.array_distinct(F.concat("_s", F.transform("_s", lambda i: i + 1), F.transform("_s", lambda i: i + 2)))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_l", lines)
    long = lambda c: c.cast("long")
    measured = rows.select(
        "doc_id", long(F.size("_w")).alias("n_words"), long(F.length(F.array_join("_w", ""))).alias("word_chars"),
        long(F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_l")).alias("n_lines"), long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        long(F.size(inside)).alias("n_repeat_words"),
        long(F.size(F.filter("_w", lambda x: x.rlike(r"\p{L}")))).alias("n_letter_words"))
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return stage(measured.withColumn("fail_bits", bits))


def keeps(policy: Policy) -> Column:
    """Does the policy keep a row of the ledger?"""
    bits = F.col("fail_bits")
    return (bits.bitwiseAND(policy.required) == 0) & (F.bit_count(bits.bitwiseAND(policy.counted)) <= policy.allowed)


def judged(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The ledger with the base verdict and the policy's verdict."""
    failed = F.col("fail_bits").bitwiseAND(BASE) != 0
    return rows.withColumn("base_failed", failed).withColumn("policy", F.lit(policy.version)).withColumn("kept", ~failed & keeps(policy))


def ablations(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects. One pass."""
    bits, mask = F.col("fail_bits"), policy.required
    used = [name for name, _ in RULES if mask & BIT[name]]
    sums = [F.struct(F.lit(name).alias("rule"),
                     F.count_if(bits.bitwiseAND(BIT[name]) != 0).alias("failed"),
                     F.count_if(bits.bitwiseAND(mask) == BIT[name]).alias("only_this")).alias(name) for name in used]
    one = rows.agg(*sums)
    return one.select(F.explode(F.array(*used)).alias("r")).select(F.lit(policy.version).alias("policy"), "r.*")
