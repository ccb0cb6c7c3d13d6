"""All queries of this subpackage, the pipeline included, and their SQL."""

from __future__ import annotations

from tablemine.llm import queries  # noqa: F401  registers
from tablemine.llm.registry import QUERIES, SQL


def all_queries():
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
