"""Column statistics, value distributions, dataset profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.domain import CONTINUOUS, DISCRETE, col, domain_of, finite
from tablemine.functions.ordering import hash_cut, hash_key

#: Aggregates per select, to stay inside one generated method.
CHUNK = 400


def column_stats(df: DataFrame) -> DataFrame:
    """column, min, max, mean, std (sample), missing: one aggregate pass, one output row per column.

    Only continuous columns have the four numbers; the distribution of discrete ones is :func:`value_distribution`.
    """
    rows = []
    for c in domain_of(df).columns:
        value = finite(col(c.name)) if c.var_type == CONTINUOUS else None
        nothing = F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(c.name).alias("column"),
                (F.min(value) if value is not None else nothing).alias("min"),
                (F.max(value) if value is not None else nothing).alias("max"),
                (F.avg(value) if value is not None else nothing).alias("mean"),
                (F.stddev_samp(value) if value is not None else nothing).alias("std"),
                F.count_if(value.isNull() if value is not None else col(c.name).isNull()).alias("missing"),
            )
        )
    return df.agg(F.array(*rows).alias("_s")).select(F.inline("_s"))


def value_distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, value, count of the discrete columns, missing values left out. One shuffle of combined counts."""
    names = list(columns) if columns else [c.name for c in domain_of(df).columns if c.var_type == DISCRETE]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint")
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("value")) for n in names])
    long = df.select(F.inline(pairs)).where("value is not null")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def dataset_profile(
    df: DataFrame, *, max_sample_rows: int = 5, include_correlations: bool = True, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """One JSON document: row count, schema, column statistics, correlations and a few rows in hash order."""
    from tablemine.operators.correlation import correlations

    domain = domain_of(df)
    stats = column_stats(df).agg(
        F.to_json(F.collect_list(F.struct("column", "min", "max", "mean", "std", "missing"))).alias("s")
    )
    cut = hash_cut(df, key, max_sample_rows, seed=seed) or ""
    rows = df.where(hash_key(key, seed) <= cut).agg(
        F.to_json(F.collect_list(F.struct(*[col(c) for c in df.columns])), {"ignoreNullFields": "false"}).alias("r")
    )
    schema = F.to_json(
        F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(c.role).alias("role"), F.lit(c.var_type).alias("var_type")) for c in domain.columns])
    )
    parts = [
        F.lit('{"row_count":'), df.agg(F.count(F.lit(1)).cast("string").alias("n")).scalar(),
        F.lit(',"schema":'), schema,
        F.lit(',"stats":'), stats.scalar(),
        F.lit(',"sample_rows":'), F.coalesce(rows.scalar(), F.lit("[]")),
    ]
    if include_correlations and len(domain.continuous()) > 1:
        corr = correlations(df, p_values=False).agg(
            F.to_json(F.collect_list(F.struct(F.col("Feature A").alias("a"), F.col("Feature B").alias("b"), F.col("Correlation").alias("r")))).alias("c")
        )
        parts += [F.lit(',"correlations":'), corr.scalar()]
    parts.append(F.lit("}"))
    return df.sparkSession.range(1).select(F.concat(*parts).alias("json"))
