"""Selecting columns and rows, editing the domain, paging."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemine.domain import (
    ATTRIBUTE, CLASS, CONTINUOUS, DISCRETE, META, STRING, col, domain_of, finite, restamp, stamp,
)


def select_columns(
    df: DataFrame, kept: Sequence[str] = (), target: str | None = None, metas: Sequence[str] = ()
) -> DataFrame:
    """Keep the named attributes (none named: all), choose the class, move columns to the metas.

    Unknown names are ignored. Without a target the existing class stays; without metas the existing metas stay.
    Columns come out as attributes, class, metas.
    """
    domain = domain_of(df)
    if kept:
        attributes = [domain[n] for n in kept if n in domain]
    else:
        attributes = domain.attributes
    classes = [domain[target]] if target and target in domain else domain.class_vars
    chosen_metas = [domain[n] for n in metas if n in domain] if metas else domain.metas
    taken = {c.name for c in classes} if target in domain else set()
    taken |= set(metas)
    roles = [(a, ATTRIBUTE) for a in attributes if a.name not in taken]
    roles += [(c, CLASS) for c in classes]
    roles += [(m, META) for m in chosen_metas]
    seen, specs = set(), []
    for spec, role in roles:
        if spec.name not in seen:
            seen.add(spec.name)
            specs.append(replace(spec, role=role))
    return restamp(df, specs)


# Missing values compare false, except that "!=" holds for them.
_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "==": lambda c, v: F.coalesce(c == F.lit(v), F.lit(False)),
    "!=": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    ">": lambda c, v: F.coalesce(c > F.lit(v), F.lit(False)),
    "<": lambda c, v: F.coalesce(c < F.lit(v), F.lit(False)),
    ">=": lambda c, v: F.coalesce(c >= F.lit(v), F.lit(False)),
    "<=": lambda c, v: F.coalesce(c <= F.lit(v), F.lit(False)),
    "is_missing": lambda c, v: c.isNull(),
    "is_present": lambda c, v: c.isNotNull(),
}


def row_condition(df: DataFrame, filters: Iterable[dict], mode: str = "all") -> Column | None:
    """The filters as one Column, or None when none applies; unknown columns and operators are skipped."""
    conditions = [
        _COMPARE[f["op"]](col(f["column"]), f.get("value"))
        for f in filters
        if f["column"] in df.columns and f["op"] in _COMPARE
    ]
    if not conditions:
        return None
    return reduce(Column.__or__ if mode == "any" else Column.__and__, conditions)


def select_rows(df: DataFrame, filters: Sequence[dict], mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """Rows that meet all (or any) filters, and the rest. Each filter is ``{column, op, value}``."""
    condition = row_condition(df, filters, mode)
    if condition is None:
        return df, df.where(F.lit(False))
    return df.where(condition), df.where(~condition)


def edit_domain(
    df: DataFrame,
    rename: dict[str, str] | None = None,
    retype: dict[str, str] | None = None,
    set_target: str | None = None,
) -> DataFrame:
    """Rename columns, change their types, choose the class. Names in ``retype`` and ``set_target`` may be old or new.

    To continuous: text that is no number becomes NULL. The former class becomes a meta.
    """
    rename, retype = dict(rename or {}), dict(retype or {})
    domain = domain_of(df)
    target = rename.get(set_target, set_target)
    new_types = {rename.get(n, n): t for n, t in retype.items()}
    final_names = {rename.get(c.name, c.name) for c in domain.columns}
    out = []
    for c in domain.columns:
        spec = replace(c, name=rename.get(c.name, c.name))
        value = col(c.name)
        wanted = new_types.get(spec.name)
        if wanted == CONTINUOUS:
            value = finite(value.try_cast("double"))
            spec = replace(spec, var_type=CONTINUOUS, values=(), role=ATTRIBUTE if spec.role == META else spec.role)
        elif wanted in (DISCRETE, STRING):
            value = value.cast("string")
            role = META if wanted == STRING else (ATTRIBUTE if spec.role == META else spec.role)
            spec = replace(spec, var_type=wanted, values=(), role=role)
        if target in final_names:
            if spec.name == target:
                spec = replace(spec, role=CLASS)
            elif spec.role == CLASS:
                spec = replace(spec, role=META)
        out.append(stamp(value, spec))
    return df.select(*out)


def preview(df: DataFrame, rows: int = 50, offset: int = 0, *, order_by: Sequence[str]) -> DataFrame:
    """One page of rows in key order, each with the total row and column counts of the table.

    Spark keeps only the first ``offset + rows`` rows per partition; the total is one count.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    page = df.orderBy(*[col(c) for c in order_by]).offset(offset).limit(rows)
    return page.select("*", total.alias("total_rows"), F.lit(len(df.columns)).alias("total_cols"))
