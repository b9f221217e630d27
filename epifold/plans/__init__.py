"""Registered queries over the sample tables and the SQL they are checked with."""

from __future__ import annotations

from importlib import import_module

from epifold.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    for module in ("registers", "primitives", "stored"):
        import_module(f"epifold.plans.{module}")
    return QUERIES
