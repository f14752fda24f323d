"""Evaluation: confusion counts, precision, chain and link metrics, volume, latency, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.functions import scalars as S
from secflow.operators import sets
from secflow.operators.quantiles import quantiles
from secflow.operators.sliding import peak, sliding_distinct

LOW_N = 10
FUNNEL = ("NOT_FETCHED", "READER_UNAVAILABLE", "UNLABELLED", "NO_PARSER", "NO_RULE", "HIT_EXACT", "HIT_FAMILY", "MISS")


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def rule_metrics(expected: DataFrame, fired: DataFrame, by: str = "rule_id") -> DataFrame:
    """Precision, recall and F1 per rule from expected and fired (case, rule) pairs; 0 for an empty denominator."""
    pairs = (expected.select("case_id", by).distinct().withColumn("e", F.lit(1))
             .join(fired.select("case_id", by).distinct().withColumn("f", F.lit(1)), ["case_id", by], "full_outer"))
    counts = pairs.groupBy(by).agg(F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("tp"),
                                   F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counts.select(by, "tp", "fp", "fn", zero(ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
                         zero(ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"),
                         zero(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def label_precision(labels: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per rule: verdict counts, precision with its interval and the low-count flag. The last label of an alert counts."""
    last = sets.latest_by(labels, ["alert_id"], "pos")
    rows = last.join(alerts.select("alert_id", "rule_id"), "alert_id")
    counts = rows.groupBy("rule_id").agg(F.count_if(F.col("verdict") == "tp").alias("tp"), F.count_if(F.col("verdict") == "fp").alias("fp"),
                                         F.count_if(F.col("verdict") == "unknown").alias("unknown"))
    n = F.col("tp") + F.col("fp")
    ci = S.wilson(F.col("tp"), n)
    return counts.select("rule_id", "tp", "fp", "unknown", ratio(F.col("tp"), n).alias("precision"), F.round(ci.low, 4).alias("low"),
                         F.round(ci.high, 4).alias("high"), (n < LOW_N).alias("low_n"))


def orphan_labels(labels: DataFrame, alerts: DataFrame) -> DataFrame:
    return labels.join(alerts, "alert_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def alert_volume(alerts: DataFrame) -> DataFrame:
    """(rule_id, day, n): counts per rule and day, each alert id once, each alert without an id too."""
    once = alerts.where("alert_id is not null").dropDuplicates(["alert_id"]).unionByName(alerts.where("alert_id is null"))
    return once.groupBy("rule_id", S.day_of(F.col("time")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def latency_summary(df: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact interpolated percentiles per group, by radix refinement: no task holds the values of a group."""
    found = quantiles(df, [by], value, shares)
    return found.select(by, *[F.round(f"q{i}", 6).alias(f"p{int(p * 100)}") for i, p in enumerate(shares)])


def label_ceiling(cases: DataFrame) -> DataFrame:
    """Best accuracy any function of (rule, source) can reach: the majority label of each group."""
    per = cases.groupBy("rule_id", "source", "label").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("rule_id", "source").agg(F.max("n").alias("best"), F.sum("n").alias("all"))
    return top.agg(F.sum("best").alias("best"), F.sum("all").alias("n")).select("best", "n", ratio(F.col("best"), F.col("n")).alias("ceiling"))


def normalisation_coverage(bronze: DataFrame, parsed_ids: DataFrame) -> DataFrame:
    """Per source: records, parsed records and their share."""
    seen = parsed_ids.select("record_id").distinct().withColumn("ok", F.lit(1))
    return (bronze.join(seen, "record_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("parsed"))
            .select("source", "n", "parsed", ratio(F.col("parsed"), F.col("n")).alias("share")))


def rule_health(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Last firing per rule, null for a rule that never fired."""
    return rules.select("rule_id").join(alerts.groupBy("rule_id").agg(F.max("time").alias("last_fired"), F.count(F.lit(1)).alias("n")), "rule_id", "left")


def funnel(units: DataFrame) -> DataFrame:
    """Labelled units by the first stage that explains them. Inputs: fetched, readable, label, parsed, has_rule, level."""
    bucket = (F.when(~F.col("fetched"), FUNNEL[0]).when(~F.col("readable"), FUNNEL[1]).when(F.col("label").isNull(), FUNNEL[2])
              .when(~F.col("parsed"), FUNNEL[3]).when(~F.col("has_rule"), FUNNEL[4]).when(F.col("level") == "exact", FUNNEL[5])
              .when(F.col("level") == "family", FUNNEL[6]).otherwise(FUNNEL[7]))
    return units.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def technique_level(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """(technique, level): best match of a label among the rules' techniques, joined on the parent technique."""
    parent = lambda c: F.substring_index(F.upper(F.trim(c)), ".", 1)
    side = rules.select(parent(F.col("technique")).alias("_p"), F.col("technique").alias("_t")).distinct()
    rows = labels.select("technique").distinct().withColumn("_p", parent(F.col("technique"))).join(side, "_p", "left")
    level = S.match_level(F.col("technique"), F.col("_t"))
    return rows.groupBy("technique").agg(F.max(F.when(level == "exact", 2).when(level == "family", 1).otherwise(0)).alias("r")).select(
        "technique", F.when(F.col("r") == 2, "exact").when(F.col("r") == 1, "family").otherwise("none").alias("level"))


def chain_metrics(steps: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per storyline: share of attack steps detected and time from its start to its first alert."""
    first = alerts.groupBy("step_id").agg(F.min("time").alias("alerted"))
    rows = steps.join(first, "step_id", "left")
    return rows.groupBy("storyline").agg(F.count(F.lit(1)).alias("steps"), F.count("alerted").alias("detected"),
                                         (F.min("alerted") - F.min("time")).alias("time_to_detect")).select(
        "storyline", "steps", "detected", ratio(F.col("detected"), F.col("steps")).alias("tpr"), "time_to_detect")


def correlation_metrics(alerts: DataFrame, incident_members: DataFrame) -> DataFrame:
    """Alert reduction (1 - incidents / alerts) and the share of incidents mixing storylines."""
    n = alerts.agg(F.countDistinct("alert_id").alias("alerts"))
    mixed = (incident_members.join(alerts, "alert_id").groupBy("incident_id").agg(F.countDistinct("storyline").alias("s"))
             .agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("s") > 1).alias("false_correlated")))
    return n.crossJoin(mixed).select("alerts", "incidents", F.round(1 - F.try_divide(F.col("incidents").cast("double"), F.col("alerts")), 6).alias("reduction"),
                                     ratio(F.col("false_correlated"), F.col("incidents")).alias("false_rate"))


def edges_to_steps(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """``edges`` with ``step``, once for each step that owns one of their ends. ``steps``: (step, entity_id)."""
    ends = edges.withColumn("_end", F.explode(F.array_distinct(F.array("from_id", "to_id"))))
    owned = steps.select("step", F.col("entity_id").alias("_end")).distinct()
    return ends.join(owned, "_end").drop("_end").distinct()


def step_edges(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(from_step, to_step): steps joined by an edge from an entity of the one to an entity of the other."""
    side = lambda end, name: steps.select(F.col("step").alias(name), F.col("entity_id").alias(end)).distinct()
    return edges.select("from_id", "to_id").distinct().join(side("from_id", "from_step"), "from_id").join(side("to_id", "to_step"), "to_id").where("from_step <> to_step").select("from_step", "to_step").distinct()


def step_intervals(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(step, lo, hi, edges): from the first to the last evidence of a step's edges; edges without a usable interval make no claim about time."""
    timed = edges.where("first_ts is not null and last_ts is not null and first_ts <= last_ts")
    return edges_to_steps(timed, steps).groupBy("step").agg(F.min("first_ts").alias("lo"), F.max("last_ts").alias("hi"), F.count(F.lit(1)).alias("edges"))


def step_order(relations: DataFrame, intervals: DataFrame) -> DataFrame:
    """``relations`` (from_step, to_step, ...) with ``order`` for each pair: forward only if all evidence of the one ends before the other's begins."""
    side = lambda name, p: intervals.select(F.col("step").alias(name), F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"))
    rows = relations.join(side("from_step", "a"), "from_step", "left").join(side("to_step", "b"), "to_step", "left")
    order = (F.when(F.col("a_lo").isNull() | F.col("b_lo").isNull(), "untimed").when(F.col("a_hi") < F.col("b_lo"), "forward")
             .when(F.col("b_hi") < F.col("a_lo"), "reverse").otherwise("concurrent"))
    return rows.withColumn("order", order).select(*relations.columns, "order")


def chain_fidelity(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Oracle step pairs joined by an edge in their direction; forbidden pairs found count against."""
    have = edges.select("from_step", "to_step").distinct().withColumn("hit", F.lit(True))
    rows = relations.join(have, ["from_step", "to_step"], "left")
    return rows.groupBy("storyline").agg(F.count_if(F.col("allowed")).alias("wanted"), F.count_if(F.col("allowed") & F.col("hit").isNotNull()).alias("found"),
                                         F.count_if(~F.col("allowed") & F.col("hit").isNotNull()).alias("forbidden_found")).select(
        "storyline", "wanted", "found", "forbidden_found", ratio(F.col("found"), F.col("wanted") + F.col("forbidden_found")).alias("fidelity"))


def timed_order(pairs: DataFrame) -> DataFrame:
    """Order of timed step pairs from their evidence intervals, with the interval of the forward share."""
    order = (F.when(F.coalesce("a_lo", "b_lo").isNull() | F.col("a_lo").isNull() | F.col("b_lo").isNull(), "untimed")
             .when(F.col("a_hi") < F.col("b_lo"), "forward").when(F.col("b_hi") < F.col("a_lo"), "reverse").otherwise("concurrent"))
    rows = pairs.withColumn("order", order)
    out = rows.agg(*[F.count_if(F.col("order") == o).alias(o) for o in ("forward", "concurrent", "reverse", "untimed")])
    n = F.col("forward") + F.col("concurrent") + F.col("reverse")
    ci = S.wilson(F.col("forward"), n)
    return out.select("*", F.round(ci.low, 4).alias("low"), F.round(ci.high, 4).alias("high"), (n < 30).alias("low_n"))


def link_metrics(emitted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of links per basis, on unordered endpoint pairs, and how many point the right way."""
    norm = lambda d, p: d.select("basis", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("a") < F.col("b")).alias(p)).dropDuplicates(["basis", "x", "y"])
    both = norm(emitted, "ed").join(norm(truth, "td"), ["basis", "x", "y"], "full_outer")
    hit = F.col("ed").isNotNull() & F.col("td").isNotNull()
    c = both.groupBy("basis").agg(F.count_if(hit).alias("tp"), F.count("ed").alias("emitted"), F.count("td").alias("truth"), F.count_if(hit & (F.col("ed") == F.col("td"))).alias("directed"))
    return c.select("basis", "tp", "directed", ratio(F.col("tp"), F.col("emitted")).alias("precision"), ratio(F.col("tp"), F.col("truth")).alias("recall"))


def attribution(events: DataFrame, raw: DataFrame) -> DataFrame:
    """Share of actor-bearing records whose event names the same account."""
    rows = raw.where("actor is not null").join(events.select("record_id", F.col("actor").alias("got")), "record_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("got") == F.col("actor")).alias("right")).select("n", "right", ratio(F.col("right"), F.col("n")).alias("accuracy"))


def dns_cardinality(log: DataFrame, window_ms: int, threshold: int, allow: tuple[str, ...] = ()) -> DataFrame:
    """Per parent domain: peak distinct names in a window, totals, clients, and whether it would alert."""
    rows = log.withColumn("parent", S.parent_domain(F.col("name"))).where("parent is not null")
    top = peak(sliding_distinct(rows, ["parent"], "name", window_ms), ["parent"])
    totals = rows.groupBy("parent").agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("name").alias("names"), F.countDistinct("client").alias("clients"))
    listed = F.col("parent").isin(list(allow)) if allow else F.lit(False)
    return totals.join(top, "parent").select("parent", "queries", "names", "clients", "peak", "peak_t", ((F.col("peak") >= threshold) & ~listed).alias("alerts"))


def severity_confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))


def metric_regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, state): new, missing, regressed, improved or same; ``direction``: higher, lower or pinned."""
    b = baseline.select("metric", F.col("value").alias("was"), "direction")
    rows = b.join(current.select("metric", F.col("value").alias("now")), "metric", "full_outer")
    up, down = F.col("now") > F.col("was"), F.col("now") < F.col("was")
    worse = ((F.col("direction") == "higher") & down) | ((F.col("direction") == "lower") & up) | ((F.col("direction") == "pinned") & (up | down))
    return rows.select("metric", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(worse, "regressed").when(up | down, "improved").otherwise("same").alias("state"))


def verdict_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy with interval, abstention and majority baseline of (label, pred); an unknown pred abstains."""
    per = rows.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    n, right = F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("right")
    out = rows.agg(n, right, F.count_if(F.col("pred") == "unknown").alias("abstained")).crossJoin(per.agg(F.max("c").alias("majority")))
    ci = S.wilson(F.col("right"), F.col("n"))
    return out.select("n", "right", "abstained", ratio(F.col("right"), F.col("n")).alias("accuracy"), F.round(ci.low, 4).alias("low"),
                      F.round(ci.high, 4).alias("high"), ratio(F.col("majority"), F.col("n")).alias("majority_share"))


def trend_row(confusions: DataFrame) -> DataFrame:
    """Confusion per rule summed over corpora; a rule with nothing expected is untested."""
    return confusions.groupBy("rule_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("untested", F.col("tp") + F.col("fn") == 0)
