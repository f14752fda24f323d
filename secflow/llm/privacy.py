"""Personal data: fixed patterns, and terms that give protected values away.

Base: e-mail and network addresses, card and phone numbers, found on whole texts with their places in code
points. Then information theory: a term (a run of letters and digits) that stands near a protected value in
``SUPPORT`` different documents or more is weighed by how strongly it reveals the value: the share
P(value | term) of the documents with the term in which the value is near, and the disclosure
log2(P(value | term) / P(value)) in bits. Terms above both thresholds are removed wherever they stand, or
generalised if the share is below ``REMOVE_AT``. Documents with equal texts count once, so copies of one
text prove nothing.

Only DataFrame functions run. Patterns are loops over single characters (separators inside a match are
marked first), so that long runs neither recurse nor backtrack.

Defined cases: null is the empty text and has no spans; equal (id, text) rows get equal results; an empty
table gives no rows; other columns are kept by ``sanitise`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import keyed, same, stage, whole_text

KINDS = ("email", "ip", "card", "phone", "term")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")
#: Characters around a value that count as near.
NEAR = 80
#: Least different texts with a term near a value; least share, disclosure in bits; share from which a term is removed.
SUPPORT, SHARE, BITS, REMOVE_AT = 4, 0.6, 3.0, 0.8
#: Shortest term.
LETTERS = 4
#: Terms that are broadcast at most.
FEW = 500_000
#: Stand for a dot between two labels and for a separator between two digits; in texts they are changed first.
DOT, SEP, OTHER = "\ue000", "\ue001", "\ue002"
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{SEP}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
NOT_TERM = r"[^\p{L}\p{N}]+"
FOUND = "array<struct<start:int,end:int,value:string>>"


def locate(text: Column, pattern: Column | str) -> Column:
    """All matches from left to right with their places: what lies between them and they themselves, added up."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(both, zero, step)["out"]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Does a number of 13 to 19 digits pass the check sum?"""
    ones = F.array_remove(F.split(F.reverse(value), ""), "")
    worth = F.transform(ones, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def of_kind(kind: int, spans_: Column) -> Column:
    return F.transform(spans_, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def found(rows: DataFrame) -> DataFrame:
    """``rows`` with ``base``: array of (kind, start, end, value) sorted by kind and start; reads ``text``."""
    none = F.array().cast(FOUND)
    plain = F.when(F.col("text").rlike(f"[{DOT}{SEP}]"), F.regexp_replace("text", f"[{DOT}{SEP}]", OTHER)).otherwise(F.col("text"))
    rows = rows.withColumn("_t", plain)
    digit = F.col("_t").rlike("[0-9]")
    dots = F.regexp_replace("_t", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    seps = F.regexp_replace("_t", r"(?<=[0-9])[\x20-](?=[0-9])", SEP)
    parts = {
        "email": F.when(F.col("_t").contains("@"), locate(dots, EMAIL)).otherwise(none),
        "ip": F.when(digit, F.filter(locate(F.col("_t"), IP), lambda x: x["value"].rlike(OCTETS))).otherwise(none),
        "card": F.when(digit, F.filter(locate(seps, CARD), lambda x: F.length(digits(x["value"])).between(13, 19) & luhn(digits(x["value"])))).otherwise(none),
        "phone": F.when(F.col("_t").contains("+"), F.filter(locate(F.col("_t"), PHONE), lambda x: F.length(digits(x["value"])).between(9, 15))).otherwise(none),
    }
    rows = rows.withColumn("_b", F.concat(*[of_kind(n, parts[k]) for n, k in enumerate(KINDS[:4])]))
    # values as they stand in the text, without the marks
    value = lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])
    return rows.withColumn("base", F.transform("_b", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), value(x).alias("value")))).drop("_t", "_b")


def value_of(x: Column) -> Column:
    """The protected value as it is compared: lower case, numbers without separators."""
    return F.concat(x["kind"].cast("string"), F.lit(":"), F.when(x["kind"] >= 2, digits(x["value"])).otherwise(F.lower(x["value"])))


def terms_of(text: Column) -> Column:
    """Terms of a piece of text: runs of letters and digits with a letter, ``LETTERS`` long or more."""
    return F.filter(F.split(text, NOT_TERM), lambda x: (F.length(x) >= LETTERS) & x.rlike(r"\p{L}"))


def disclosing(rows: DataFrame) -> DataFrame:
    """(term, share, bits) of the terms that reveal a protected value; ``rows`` has fp, text and base.

    Different texts count, also if a passage with the value and the term is the same in all of them."""
    n = rows.select("fp").distinct().count()
    one = rows.where(F.size("base") > 0).select("fp", "text", F.explode("base").alias("x"))
    left = F.expr(f"substring(text, greatest(x.start - {NEAR}, 0) + 1, x.start - greatest(x.start - {NEAR}, 0))")
    right = F.expr(f"substring(text, x.end + 1, {NEAR})")
    # a term cut by the edge of the surroundings isn't one
    cut = lambda at: F.expr(f"substring(text, {at}, 1)").rlike(r"[\p{L}\p{N}]")
    left = F.when(F.expr(f"x.start > {NEAR}") & cut(f"x.start - {NEAR}"), F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
    right = F.when(cut(f"x.end + {NEAR + 1}"), F.regexp_replace(right, r"[\p{L}\p{N}]+$", "")).otherwise(right)
    near = stage(one.select("fp", value_of(F.col("x")).alias("value"), F.concat_ws(" ", left, right).alias("around")))
    pairs = stage(near.select("value", "fp", F.explode(F.array_distinct(terms_of(F.col("around")))).alias("term")))
    strong = pairs.distinct().groupBy("term", "value").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= SUPPORT)
    # a term stands in at least the texts where it is near any value: common terms can't reach the share
    around_any = pairs.join(strong.select("term").distinct(), "term", "left_semi").select("term", "fp").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("near_any"))
    strong = stage(strong.join(around_any, "term").where(F.col("together") >= SHARE * F.col("near_any")).drop("near_any"))
    asked = stage(strong.select("term").distinct())
    held = document_counts(rows, asked)
    per_value = near.select("value", "fp").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("with_value"))
    share = F.least(F.col("together") / F.col("with_term"), F.lit(1.0))
    bits = F.log2(F.col("share") * F.lit(float(max(n, 1))) / F.col("with_value"))
    weighed = strong.join(held, "term").join(per_value, "value").withColumn("share", share).withColumn("bits", bits)
    return stage(weighed.where((F.col("share") >= SHARE) & (F.col("bits") >= BITS)).groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits")))


def narrow(terms: DataFrame) -> DataFrame:
    """A staged table of terms, broadcast if its size is within the bound."""
    return F.broadcast(terms) if terms.count() <= FEW else terms


def document_counts(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, with_term): different texts with each of the asked terms anywhere."""
    if asked.isEmpty():
        return asked.withColumn("with_term", F.lit(0).cast("long"))
    each = rows.select("fp", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    return each.join(narrow(asked), "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))


def flagged(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, fp, terms) of the documents that hold disclosing terms."""
    each = rows.select("id", "fp", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    met = each.join(narrow(terms), "term")
    remove = F.col("share") >= REMOVE_AT
    return stage(met.groupBy("id", "fp").agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(remove, F.col("term"))).alias("gone")))


def spans(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document: id, fp, text, ``spans``: array of (kind, start, end, value), base before terms."""
    rows = found(keyed(docs, whole_text(), id_col))
    terms = disclosing(rows)
    if terms.isEmpty():
        return rows.select("id", "fp", "text", F.col("base").alias("spans"), F.array().cast("array<string>").alias("gone"))
    hit = flagged(rows.select("id", "fp", "text"), terms)
    joined = rows.join(hit, same(rows, hit, ["id", "fp"]), "left").select(rows["id"], rows["fp"], "text", "base", "terms", "gone")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    placed = F.when(F.col("terms").isNotNull(), locate(F.col("text"), pattern)).otherwise(F.array().cast(FOUND))
    outside = lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return joined.select("id", "fp", "text", F.concat("base", of_kind(4, F.filter(placed, outside))).alias("spans"), F.coalesce("gone", F.array().cast("array<string>")).alias("gone"))


def listed(of: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, of: Column, gone: Column) -> Column:
    """The text with labels for its spans; of spans that overlap, the first from the left counts."""
    order = F.sort_array(F.transform(of, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value"))))
    label = lambda x: F.when(x["kind"] < 4, F.element_at(F.array(*[F.lit(v) for v in LABELS]), F.least(x["kind"], F.lit(3)) + 1)).when(
        F.array_contains(gone, x["value"]), "[REMOVED]").otherwise("[TERM]")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), label(x))
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], piece).alias("out")))

    done = F.aggregate(order, zero, step)
    return F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))


def sanitise(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with personal data and disclosing terms masked in ``text``; a null text stays null."""
    marks = spans(docs, id_col).where(F.size("spans") > 0).dropDuplicates(["id", "fp"])
    marks = stage(marks.select("id", "fp", masked(F.col("text"), F.col("spans"), F.col("gone")).alias("_new")))
    rows = docs.withColumn("_fp", F.xxhash64(whole_text()))
    joined = rows.join(marks, rows[id_col].eqNullSafe(marks["id"]) & (rows["_fp"] == marks["fp"]), "left")
    return joined.select(*[F.coalesce(marks["_new"], rows["text"]).alias("text") if c == "text" else rows[c] for c in docs.columns])
