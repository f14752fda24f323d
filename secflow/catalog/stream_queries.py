"""Streams over the events table, arriving in parts, against the same windows worked out by plain self joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.catalog.fixture import EV_SQL, as_security, base_events
from secflow.catalog.registry import query
from secflow.catalog.rule_queries import FILTERS, level_sql, members_sql, stretched
from secflow.plans.rules import BY_NAME
from secflow.session import checkpoint_dir
from secflow.streaming import job
from secflow.streaming.windows_stream import replayed, rule_windows

DAY = 86_400_000
#: Count, distinct and regularity rules, and one without a window.
STREAMED = tuple(stretched(BY_NAME[n]) for n in ("common_bruteforce", "common_bruteforce_by_account", "common_port_scan", "common_password_spray_by_source",
                                                 "common_beaconing", "win_lsass_access_suspicious"))
#: Days from the first event on at which the parts are cut; the last part comes first.
CUT_DAYS = (10, 20)
LATE_DAYS = 12


def _windows_sql(ev: str) -> str:
    """CTEs ending in w: (rule_id, tenant, grp, t, n, cv) of every window, from a table of events."""
    ctes, parts = [], []
    for i, r in enumerate(r for r in STREAMED if r.stateful):
        ctes += [members_sql(r, f"m{i}").replace("FROM ev ", f"FROM {ev} "), level_sql(r, f"m{i}", f"lv{i}")]
        cv = "round(CASE WHEN n >= 3 THEN cv END, 6)" if r.measure == "cv" else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT DISTINCT '{r.id}' AS rule_id, tenant, grp, t, CAST(n AS BIGINT) AS n, {cv} AS cv FROM lv{i}")
    return f"{', '.join(ctes)}, w AS ({' UNION ALL '.join(parts)})"


def _alone_sql(ev: str) -> str:
    r = STREAMED[-1]
    return f"SELECT 'hit' AS kind, '{r.id}' AS rule_id, tenant, CAST(NULL AS VARCHAR) AS grp, t, CAST(1 AS BIGINT) AS rows, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS cv, ingest_id AS event_key FROM {ev} WHERE {FILTERS[r.name]}"


def _fed_sql(ev: str, out: str = "fed") -> str:
    """CTEs ending in ``out``: (rule_id, tenant, grp, t) of what feeds the windows."""
    rules = [r for r in STREAMED if r.stateful]
    ctes = [members_sql(r, f"{out}{i}").replace("FROM ev ", f"FROM {ev} ") for i, r in enumerate(rules)]
    parts = [f"SELECT '{r.id}' AS rule_id, tenant, grp, t FROM {out}{i}" for i, r in enumerate(rules)]
    return f"{', '.join(ctes)}, {out} AS ({' UNION ALL '.join(parts)})"


def _streamed(spark, sf, lateness: str, order, each=None, path: str = "") -> DataFrame | None:
    """The parts of the events table in an order of arrival, closed by an event that no rule matches, far behind all others."""
    base = base_events(spark, sf)
    first, last = base.agg(F.min("t"), F.max("t")).first()
    cuts = [None, *[first // DAY * DAY + d * DAY for d in CUT_DAYS], None]
    whole = [base.where((F.lit(True) if lo is None else F.col("t") >= lo) & (F.lit(True) if hi is None else F.col("t") < hi)) for lo, hi in zip(cuts, cuts[1:])]
    names = base.columns
    closing = spark.createDataFrame([(-1, last + 400 * DAY, 1, "view", 0.0, 18, 18)], base.select(*names).schema)
    out = replayed([*[whole[i] for i in order], closing], lambda s: rule_windows(as_security(s), STREAMED, lateness, "event"),
                   path or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}", each)
    return None if each else out.where(~F.coalesce(F.col("event_key") == "e-1", F.lit(False))).select("kind", "rule_id", "tenant", "grp", "t", "rows", "n", F.round("cv", 6).alias("cv"), "event_key")


def _summed(out: DataFrame) -> DataFrame:
    """Side rows of one group and ms added up: how many rows of a batch met before the shuffle is not part of the result."""
    rows = out.groupBy("kind", "rule_id", "tenant", "grp", "t", "n", "cv", "event_key").agg(F.sum("rows").alias("rows"))
    return rows.select("kind", "rule_id", "tenant", "grp", "t", "rows", "n", "cv", "event_key")


WINDOW_ROWS_SQL = "SELECT 'window' AS kind, w.rule_id, w.tenant, w.grp, w.t, rows, n, cv, CAST(NULL AS VARCHAR) AS event_key FROM w JOIN (SELECT rule_id, tenant, grp, t, count(*) AS rows FROM fed GROUP BY ALL) USING (rule_id, tenant, grp, t)"


@query("stream_windows", f"WITH {EV_SQL}, {_fed_sql('ev')}, {_windows_sql('ev')} {WINDOW_ROWS_SQL} UNION ALL {_alone_sql('ev')}")
def stream_windows(spark, sf):
    """The last third of the month arrives first and everything is in time: every window as in a batch."""
    return _summed(_streamed(spark, sf, "400 days", (2, 0, 1)))


LATE_SQL = f"""edge AS (SELECT min(t) // {DAY} * {DAY} AS d0, max(t) AS top FROM ev),
marks AS (SELECT ev.*, CASE WHEN t < d0 + {CUT_DAYS[0] * DAY} THEN 0 WHEN t < d0 + {CUT_DAYS[1] * DAY} THEN 1 ELSE 2 END AS part, top - {LATE_DAYS * DAY} AS mark FROM ev, edge),
intime AS (SELECT * FROM marks WHERE part = 2 OR t >= mark), behind AS (SELECT * FROM marks WHERE part < 2 AND t < mark)"""


@query("stream_late", f"""WITH {EV_SQL}, {LATE_SQL}, {_fed_sql('intime')}, {_windows_sql('intime')}, {_fed_sql('behind', 'gone')}
{WINDOW_ROWS_SQL} UNION ALL {_alone_sql('ev')}
UNION ALL SELECT 'late' AS kind, rule_id, tenant, grp, t, count(*) AS rows, NULL AS n, NULL AS cv, NULL AS event_key FROM gone GROUP BY rule_id, tenant, grp, t""")
def stream_late(spark, sf):
    """The last third arrives first, which moves the watermark into the second: rows behind it are named, the others are as in a batch of them alone."""
    return _summed(_streamed(spark, sf, f"{LATE_DAYS} days", (2, 0, 1)))


LIMITS_SQL = " OR ".join(f"(rule_id = '{r.id}' AND n >= {r.threshold}{f' AND cv <= {r.max_cv}' if r.max_cv is not None else ''})" for r in STREAMED if r.stateful)
SPAN_SQL = "CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN {max(r.window_s, 1) * 1000}" for r in STREAMED) + " END"


@query("stream_alerts", f"""WITH {EV_SQL}, {_windows_sql('ev')}
SELECT concat(rule_id, ':', tenant, ':', length(grp), ':', grp, ':', t // {SPAN_SQL}) AS alert_id, max(t) AS time, arg_max(n, t) AS n, 'new' AS status FROM w WHERE {LIMITS_SQL} GROUP BY 1
UNION ALL SELECT concat('{STREAMED[-1].id}', ':', tenant, ':', ingest_id) AS alert_id, t AS time, NULL AS n, 'new' AS status FROM ev WHERE {FILTERS[STREAMED[-1].name]}""")
def stream_alerts(spark, sf):
    """The streaming job: the alert table that its batches leave."""
    path = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    _streamed(spark, sf, "400 days", (2, 0, 1), job.each_batch(path, STREAMED, 16), path)
    return job.alert_table(spark, path, 16).read().where(~F.col("alert_id").endswith(":e-1")).select("alert_id", "time", "n", "status")
