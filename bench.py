"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from secflow.catalog import load  # noqa: E402
from secflow.session import build_session  # noqa: E402

QUERIES = ("top_alerts", "sliding_count_bruteforce", "sliding_distinct_scan", "beacon_cv", "rule_common_bruteforce", "rule_common_port_scan",
           "normalize_db_audit", "run_rules_all", "make_alerts_all", "resolve_ip_at", "cidr_lpm", "facets")
#: Queries that read other tables than events: no rate of events.
OTHER = ("cidr_lpm", "facets")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(f"local[{cpus}]", int(cpus), extra={
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    registered, _ = load()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spent, rates = {}, {}
    for name in QUERIES:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        if name not in OTHER:
            rates[name] = round(events / spent[name])
        print(name, spent[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
                      "events_per_sec": rates, "events": events, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
