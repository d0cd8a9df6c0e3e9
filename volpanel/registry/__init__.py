"""Registered queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from importlib import import_module

from volpanel.registry.base import QUERIES, Query

MODULES = ("q_series", "q_state", "q_surface", "q_events", "q_condor", "q_metrics", "q_sources", "q_outputs")


def load() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"volpanel.registry.{name}")
    return QUERIES
