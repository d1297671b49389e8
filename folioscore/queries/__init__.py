"""Registered queries, one or more per operator."""

from __future__ import annotations

import importlib

MODULES = ["scoring", "datasets", "diagnosis", "governed", "paging", "streams"]


def load() -> tuple[dict, dict]:
    """Name to callable, and name to oracle SQL."""
    for name in MODULES:
        importlib.import_module(f"folioscore.queries.{name}")
    from folioscore.queries.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
