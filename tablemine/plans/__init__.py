"""Registered queries, one module per family, each with its SQL counterpart."""

from __future__ import annotations

import importlib

from tablemine.plans.registry import QUERIES, SQL

MODULES = ("tables", "samples", "preparation", "relations", "patterns", "models", "evaluation", "signals", "projections", "planted")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tablemine.plans.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
