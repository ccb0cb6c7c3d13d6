"""Imputation, scaling, encoding and binning.

Each fits a few numbers per column in one pass (collected: columns x constants), then rewrites the columns as plain
expressions, so the rewritten table stays in one generated stage with no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemine.domain import (
    CONTINUOUS, DISCRETE, ColumnSpec, col, discrete_values, domain_of, finite, stamp,
)
from tablemine.functions.entropy import mdl_cuts
from tablemine.functions.ordering import column_quantiles
from tablemine.operators.statistics import value_distribution


def _rewrite(df: DataFrame, changed: dict[str, Column], specs: dict[str, ColumnSpec] | None = None) -> DataFrame:
    specs = specs or {}
    return df.select(
        *[stamp(changed.get(c.name, col(c.name)), specs.get(c.name, c)) for c in domain_of(df).columns]
    )


def _moments(df: DataFrame, names: list[str]) -> dict[str, dict[str, float]]:
    if not names:
        return {}
    aggs = []
    for i, n in enumerate(names):
        v = finite(col(n))
        aggs += [F.avg(v).alias(f"mean{i}"), F.stddev_pop(v).alias(f"sd{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
    row = df.agg(*aggs).first()
    return {n: {k: row[f"{k}{i}"] for k in ("mean", "sd", "min", "max")} for i, n in enumerate(names)}


def most_frequent(df: DataFrame, names: list[str]) -> dict[str, str]:
    """Most frequent value per discrete column, ties to the smaller value."""
    if not names:
        return {}
    counts = value_distribution(df, names)
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value"))
    return {r["column"]: r["value"] for r in best.collect()}


Step = Callable[[DataFrame], DataFrame]


def impute(df: DataFrame, *, method: str = "average", value: float | str | None = None) -> DataFrame:
    """Fill missing attributes; see :func:`fit_impute`."""
    return fit_impute(df, method=method, value=value)(df)


def fit_impute(df: DataFrame, *, method: str = "average", value: float | str | None = None) -> Step:
    """Fill missing attributes. average (and any unknown name): mean or most frequent value; default: 0 or most
    frequent; median; constant ``value``; drop removes rows with a missing attribute."""
    domain = domain_of(df)
    numeric, nominal = domain.continuous(), domain.discrete()
    if method == "drop":
        present = [finite(col(n)).isNotNull() for n in numeric]
        present += [col(c.name).isNotNull() for c in domain.attributes if c.var_type != CONTINUOUS]
        return lambda t: t.where(F.lit(True) if not present else _all(present))
    if method == "constant":
        fill = {n: value for n in numeric if isinstance(value, (int, float))}
        fill |= {n: str(value) for n in nominal if value is not None}
    else:
        if method == "default":
            fill = dict.fromkeys(numeric, 0.0)
        elif method == "median":
            fill = {n: q.get(0.5) for n, q in column_quantiles(df, numeric, [0.5]).items()}
        else:
            fill = {n: m["mean"] for n, m in _moments(df, numeric).items()}
        fill |= most_frequent(df, nominal)
    changed: dict[str, Column] = {}
    for n, v in fill.items():
        if v is not None:
            changed[n] = F.coalesce(finite(col(n)), F.lit(float(v))) if n in numeric else F.coalesce(col(n), F.lit(v))
    return lambda t: _rewrite(t, changed)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def normalize(df: DataFrame, *, method: str = "standardize") -> DataFrame:
    """Rescale continuous attributes; see :func:`fit_normalize`."""
    return fit_normalize(df, method=method)(df)


def fit_normalize(df: DataFrame, *, method: str = "standardize") -> Step:
    """Rescale continuous attributes. standardize: (x - mean) / population sd; center; scale: x / sd;
    minmax to [0, 1]; robust: (x - median) / IQR. A column without spread becomes 0 (scale: unchanged)."""
    names = domain_of(df).continuous()
    changed: dict[str, Column] = {}
    if method == "robust":
        for n, q in column_quantiles(df, names, [0.25, 0.5, 0.75]).items():
            if q:
                changed[n] = _ratio(finite(col(n)) - q[0.5], q[0.75] - q[0.25])
        return lambda t: _rewrite(t, changed)
    for n, m in _moments(df, names).items():
        if m["mean"] is None:
            continue
        x = finite(col(n))
        if method == "center":
            changed[n] = x - F.lit(m["mean"])
        elif method == "scale":
            changed[n] = x / F.lit(m["sd"]) if m["sd"] else x
        elif method == "minmax":
            changed[n] = _ratio(x - F.lit(m["min"]), m["max"] - m["min"])
        else:
            changed[n] = _ratio(x - F.lit(m["mean"]), m["sd"])
    return lambda t: _rewrite(t, changed)


def _ratio(top: Column, bottom: float) -> Column:
    return top / F.lit(float(bottom)) if bottom else F.when(top.isNotNull(), F.lit(0.0))


def continuize(df: DataFrame, *, treatment: str = "one_hot") -> DataFrame:
    """Discrete attributes to numbers; see :func:`fit_continuize`."""
    return fit_continuize(df, treatment=treatment)(df)


def fit_continuize(df: DataFrame, *, treatment: str = "one_hot") -> Step:
    """Discrete attributes to numbers. one_hot, first_as_base, as_ordinal, as_normalized_ordinal.

    Indicator columns are named ``column=value``; a missing value stays missing in all of them.
    """
    domain = domain_of(df)
    values = discrete_values(df, domain.discrete())

    def encoded(c: ColumnSpec) -> list[Column]:
        if c.name not in values:
            return [stamp(col(c.name), c)]
        text, vals = col(c.name).cast("string"), values[c.name]
        if treatment in ("as_ordinal", "as_normalized_ordinal"):
            code = F.array_position(F.array(*[F.lit(v) for v in vals]), text)
            code = F.when(code > 0, (code - 1).cast("double"))
            if treatment == "as_normalized_ordinal":
                code = code / F.lit(float(max(len(vals) - 1, 1)))
            return [stamp(code, replace(c, var_type=CONTINUOUS, values=()))]
        kept = vals[1:] if treatment == "first_as_base" else vals
        flags = [F.when(text.isNotNull(), (text == v).cast("double")) for v in kept]
        return [stamp(f, ColumnSpec(f"{c.name}={v}", CONTINUOUS, c.role)) for f, v in zip(flags, kept)]

    return lambda t: t.select(*[e for c in domain_of(t).columns for e in encoded(c)])


def _number(x: float) -> str:
    """Shortest text of a cut point that reads back as the same number."""
    x = float(x)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def interval_labels(cuts: list[float]) -> list[str]:
    """Labels of the bins between sorted cut points: ``< a``, ``[a, b)``, ``>= b``."""
    if not cuts:
        return ["all"]
    inner = [f"[{_number(a)}, {_number(b)})" for a, b in zip(cuts, cuts[1:])]
    return [f"< {_number(cuts[0])}", *inner, f">= {_number(cuts[-1])}"]


def bin_index(value: Column, cuts: list[float]) -> Column:
    """0-based bin of a value: the number of cut points at or below it."""
    out = F.lit(0)
    for c in cuts:
        out = out + (value >= F.lit(float(c))).cast("int")
    return F.when(value.isNotNull(), out)


def equal_width_cuts(df: DataFrame, names: list[str], n_bins: int) -> dict[str, list[float]]:
    out = {}
    for n, m in _moments(df, names).items():
        span = None if m["min"] is None else m["max"] - m["min"]
        out[n] = [m["min"] + span * i / n_bins for i in range(1, n_bins)] if span else []
    return out


def equal_freq_cuts(df: DataFrame, names: list[str], n_bins: int) -> dict[str, list[float]]:
    probs = [i / n_bins for i in range(1, n_bins)]
    if not probs:
        return {n: [] for n in names}
    found = column_quantiles(df, names, probs)
    return {n: sorted(set(q.values())) for n, q in found.items()}


def entropy_cuts(df: DataFrame, names: list[str], target: str) -> dict[str, list[float]]:
    """Cut points by recursive entropy splits with the minimum description length stop (Fayyad and Irani 1993)."""
    return mdl_cuts(df, names, target)


def discretize(df: DataFrame, *, method: str = "equal_freq", n_bins: int = 4) -> DataFrame:
    """Continuous attributes to bins; see :func:`fit_discretize`."""
    return fit_discretize(df, method=method, n_bins=n_bins)(df)


def fit_discretize(df: DataFrame, *, method: str = "equal_freq", n_bins: int = 4) -> Step:
    """Continuous attributes to bins labelled ``< a``, ``[a, b)``, ``>= b``. equal_freq, equal_width, entropy."""
    domain = domain_of(df)
    names = domain.continuous()
    if method == "entropy":
        if domain.class_var is None or domain.class_var.var_type != DISCRETE:
            raise ValueError("entropy binning needs a discrete class")
        cuts = entropy_cuts(df, names, domain.class_var.name)
    elif method == "equal_width":
        cuts = equal_width_cuts(df, names, n_bins)
    else:
        cuts = equal_freq_cuts(df, names, n_bins)
    changed, specs = {}, {}
    for n in names:
        labels = interval_labels(cuts[n])
        index = bin_index(finite(col(n)), cuts[n])
        changed[n] = F.when(index.isNotNull(), F.get(F.array(*[F.lit(x) for x in labels]), index))
        specs[n] = replace(domain[n], var_type=DISCRETE, values=tuple(labels))
    return lambda t: _rewrite(t, changed, specs)


class Preprocessor:
    """Preparation steps fitted in order on the training table and replayed on any other table.

    Each step is (name, settings) with name impute, normalize, continuize or discretize.
    """

    FITTERS = {"impute": fit_impute, "normalize": fit_normalize, "continuize": fit_continuize, "discretize": fit_discretize}

    def __init__(self, *steps: tuple[str, dict]):
        self.steps = steps

    def fit(self, df: DataFrame) -> Step:
        fitted = []
        for name, settings in self.steps:
            step = self.FITTERS[name](df, **settings)
            fitted.append(step)
            df = step(df)

        def replay(t: DataFrame) -> DataFrame:
            for step in fitted:
                t = step(t)
            return t

        return replay
