"""Queries over the test tables, with the SQL that they are held against."""

from __future__ import annotations


def registered() -> tuple[dict, dict]:
    """Queries by name, and SQL by name."""
    from . import adapt, bind, core, planning, reports, runs, scans  # noqa: F401

    return dict(bind.QUERIES), dict(bind.SQL)
