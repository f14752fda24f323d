"""Queries over the supplied tables and the plain SQL they must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("rule_queries", "detect_queries", "normalize_queries", "correlate_queries", "report_queries", "stream_queries", "network_queries", "state_queries", "package_queries")


def load() -> tuple[dict, dict]:
    """(queries, check SQL) of all catalogue modules."""
    from secflow.catalog.registry import ORACLES, QUERIES

    for name in MODULES:
        import_module(f"secflow.catalog.{name}")
    return dict(QUERIES), dict(ORACLES)
