"""Registered queries over the test tables."""

from __future__ import annotations

import importlib

MODULES = ["text_queries", "place_queries", "aggregate_queries", "composite_queries"]


def load() -> None:
    """Imports every query module, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"cinderleaf.queries.{name}")
