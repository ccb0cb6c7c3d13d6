"""Correlations between continuous attributes."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemine.domain import ATTRIBUTE, CONTINUOUS, META, STRING, ColumnSpec, col, domain_of, finite, stamp
from tablemine.functions.ordering import average_rank
from tablemine.functions.special import correlation_p
from tablemine.operators.statistics import CHUNK

PAIRS = "a string, b string, n bigint, r double"


def pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, n, r over the rows where both are present: one aggregate pass per ``CHUNK`` expressions."""
    out = None
    step = CHUNK // 2
    for i in range(0, len(pairs), step):
        facts = []
        for a, b in pairs[i : i + step]:
            x, y = finite(col(a)), finite(col(b))
            facts.append(
                F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(x.isNotNull() & y.isNotNull()).alias("n"), F.corr(x, y).alias("r"))
            )
        part = df.agg(F.array(*facts).alias("_f")).select(F.inline("_f"))
        out = part if out is None else out.unionAll(part)
    return out


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, n, r where r is the correlation of average ranks among the rows that have both values.

    Columns without gaps are ranked once each. A pair with a gappy column needs ranks of its own.
    """
    names = list(dict.fromkeys(n for p in pairs for n in p))
    gaps = df.agg(*[F.count_if(finite(col(n)).isNull()).alias(f"g{i}") for i, n in enumerate(names)]).first()
    whole = {n for i, n in enumerate(names) if not gaps[f"g{i}"]}
    easy = [p for p in pairs if whole.issuperset(p)]
    hard = [p for p in pairs if not whole.issuperset(p)]
    parts = ([_shared_ranks(df, easy)] if easy else []) + ([_own_ranks(df, hard)] if hard else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _shared_ranks(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Replace each column by its ranks, one join per column, then correlate all pairs in one aggregate."""
    names = list(dict.fromkeys(n for p in pairs for n in p))
    base = df.select(*[finite(col(n)).alias(f"_c{i}") for i, n in enumerate(names)])
    rows = base
    for i in range(len(names)):
        ranks = average_rank(base.select(f"_c{i}"), f"_c{i}").select(f"_c{i}", F.col("rank").alias(f"_r{i}"))
        rows = rows.join(ranks, f"_c{i}").drop(f"_c{i}")
    return pearson_pairs(rows.select(*[F.col(f"_r{i}").alias(n) for i, n in enumerate(names)]), pairs)


def _own_ranks(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows are first counted per (pair, value, value). Ranks come from running counts per (pair, side), so a pair's
    ranks see only the rows complete in that pair; the mean rank is (n + 1) / 2, which keeps the sums small.
    """
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("pair"), finite(col(a)).alias("x"), finite(col(b)).alias("y"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    both = df.select(F.inline(cells)).where("x is not null and y is not null")
    counts = both.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("k"))
    sides = counts.select(
        F.inline(F.array(*[F.struct("pair", F.lit(s).alias("side"), F.col(s).alias("v"), "k") for s in ("x", "y")]))
    )
    ranks = average_rank(sides, "v", by=["pair", "side"], weight="k", groups=2 * len(pairs))
    rx = ranks.where("side = 'x'").select("pair", F.col("v").alias("x"), F.col("rank").alias("rx"), F.col("n_total").alias("n"))
    ry = ranks.where("side = 'y'").select("pair", F.col("v").alias("y"), F.col("rank").alias("ry"))
    joined = counts.join(rx, ["pair", "x"]).join(ry, ["pair", "y"])
    dx, dy = F.col("rx") - (F.col("n") + 1) / 2, F.col("ry") - (F.col("n") + 1) / 2
    k = F.col("k")
    sums = joined.groupBy("pair", "n").agg(
        F.sum(k * dx * dy).alias("sxy"), F.sum(k * dx * dx).alias("sxx"), F.sum(k * dy * dy).alias("syy")
    )
    r = F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    found = sums.select("pair", "n", r.alias("r"))
    return names.join(found, "pair", "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "r")


@F.pandas_udf(T.DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(correlation_p(r.to_numpy(), n.to_numpy()), index=r.index)


def correlations(
    df: DataFrame, *, method: str = "pearson", threshold: float = 0.0, p_values: bool = True
) -> DataFrame | None:
    """Feature A, Feature B, Correlation, Abs Correlation, p-value of all pairs, strongest first; None below two
    continuous attributes. Two complete rows or fewer give 0 with p = 1. ``threshold`` keeps pairs at or above it."""
    names = domain_of(df).continuous()
    if len(names) < 2:
        return None
    pairs = list(combinations(names, 2))
    found = spearman_pairs(df, pairs) if method.lower() == "spearman" else pearson_pairs(df, pairs)
    r = F.when(F.col("n") > 2, F.col("r")).when(F.col("n") <= 2, F.lit(0.0))
    out = found.select("a", "b", "n", r.alias("r")).where(F.coalesce(F.abs("r"), F.lit(0.0)) >= threshold)
    numbers = [stamp(F.col("r"), ColumnSpec("Correlation", CONTINUOUS)), stamp(F.abs("r"), ColumnSpec("Abs Correlation", CONTINUOUS))]
    if p_values:
        numbers.append(stamp(p_value("r", "n"), ColumnSpec("p-value", CONTINUOUS)))
    return out.select(
        stamp(F.col("a"), ColumnSpec("Feature A", STRING, META)), stamp(F.col("b"), ColumnSpec("Feature B", STRING, META)), *numbers
    ).orderBy(F.desc_nulls_last("Abs Correlation"), "Feature A", "Feature B")


def correlation_matrix(df: DataFrame, *, method: str = "pearson", of: str = "Correlation") -> DataFrame:
    """Square form: feature and one column per feature. ``of`` is Correlation (diagonal 1) or p-value (diagonal 0)."""
    names = domain_of(df).continuous()
    long = correlations(df, method=method, p_values=of == "p-value")
    cells = [F.struct(F.col(f"Feature {s}").alias("feature"), F.col(f"Feature {o}").alias("other"), col(of).alias("v")) for s, o in ("AB", "BA")]
    diagonal = df.sparkSession.createDataFrame(
        [(n, n, 0.0 if of == "p-value" else 1.0) for n in names], "feature string, other string, v double"
    )
    square = long.select(F.inline(F.array(*cells))).unionAll(diagonal)
    wide = square.groupBy("feature").pivot("other", names).agg(F.first("v"))
    return wide.select(
        stamp(F.col("feature"), ColumnSpec("feature", STRING, META)), *[stamp(col(n), ColumnSpec(n, CONTINUOUS, ATTRIBUTE)) for n in names]
    )
