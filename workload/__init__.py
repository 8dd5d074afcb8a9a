"""Queries over the given tables, each with the SQL it is checked against."""

from __future__ import annotations


def registered() -> dict:
    """Query name to (function of session and data folder, SQL or None)."""
    from workload import q_catalog, q_diff, q_report

    out: dict = {}
    for module in (q_catalog, q_diff, q_report):
        out.update(module.queries())
    return out
