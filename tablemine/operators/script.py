"""User code between tables: callables over DataFrames, and over pandas batches on the executors."""

from __future__ import annotations

import traceback
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass
class ScriptResult:
    """What a script left behind: its table and object, its variables, the traceback if it failed."""

    out_data: DataFrame | None = None
    out_object: Any = None
    state: dict = field(default_factory=dict)
    error: str | None = None


def apply_script(
    fn: Callable[..., Any] | None, in_data: DataFrame | None, in_extra: DataFrame | None = None, in_object: Any = None,
    state: dict | None = None,
) -> ScriptResult:
    """Call ``fn(scope)`` where ``scope`` holds in_data, in_extra, in_object and the kept variables; it sets out_data and
    out_object there. No function: the table passes through. An exception gives no output, only its traceback.

    Everything else ``fn`` sets is kept in ``state`` for the next call. The table stays lazy.
    """
    if fn is None:
        return ScriptResult(in_data, in_object, dict(state or {}))
    ports = {"in_data": in_data, "in_extra": in_extra, "in_object": in_object, "out_data": None, "out_object": None}
    scope = {**(state or {}), **ports}
    try:
        fn(scope)
    except Exception:
        return ScriptResult(state=dict(state or {}), error=traceback.format_exc())
    kept = {k: v for k, v in scope.items() if k not in ports}
    return ScriptResult(scope["out_data"], scope["out_object"], kept)


def script_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Run ``fn`` over pandas batches of the table; memory is bounded by the Arrow batch.

    Per-group work belongs in Spark aggregates: a group in one pandas frame would have to fit one task.
    """
    return df.mapInPandas(lambda batches: (fn(b) for b in batches), schema)
