"""Registered queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

import importlib

MODULES = ("drift", "sources", "audit", "lineage", "accounting", "metrics", "evaluation", "synthesis", "streams")


def _registry():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")


def all_queries() -> dict:
    return dict(_registry().QUERIES)


def all_sql() -> dict:
    return dict(_registry().SQL)
