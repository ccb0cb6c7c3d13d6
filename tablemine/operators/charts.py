"""Data behind charts, aggregated or sampled on the cluster over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.domain import col, finite
from tablemine.functions.ordering import cumulative, hash_cut, hash_key, quantiles_of

MISSING = "Missing"


def _group(group: str | None):
    return F.coalesce(col(group).cast("string"), F.lit(MISSING)) if group else F.lit("all")


def histogram(df: DataFrame, x: str, *, bins: int = 10, group: str | None = None) -> DataFrame:
    """group, bin, lo, hi, count of equal-width bins; the top edge belongs to the last bin. Empty bins are absent."""
    v = finite(col(x))
    edge = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if edge.lo is None:
        return df.sparkSession.createDataFrame([], "`group` string, bin int, lo double, hi double, count bigint")
    width = (edge.hi - edge.lo) / bins
    if width:
        index = F.least(F.floor((v - F.lit(edge.lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    else:
        index = F.lit(0)
    counts = df.where(v.isNotNull()).groupBy(_group(group).alias("group"), index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    lo = F.lit(edge.lo) + F.col("bin") * F.lit(width)
    return counts.select("group", "bin", lo.alias("lo"), (lo + F.lit(width)).alias("hi"), "count")


def box(df: DataFrame, y: str, *, group: str | None = None) -> DataFrame:
    """group, n, q1, median, q3, whisker_low, whisker_high, outliers (count): exact quartiles, whiskers at the most
    extreme value within 1.5 IQR. Missing values are dropped, a missing group is ``Missing``."""
    data = df.select(_group(group).alias("group"), finite(col(y)).alias("value")).where("value is not null")
    q = quantiles_of(data, [0.25, 0.5, 0.75], by=["group"])
    wide = q.groupBy("group").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"),
    )
    counted = data.groupBy("group", "value").agg(F.count(F.lit(1)).alias("k")).join(wide, "group")
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("value").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return counted.groupBy("group", "q1", "median", "q3").agg(
        F.sum("k").alias("n"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("k"))), F.lit(0)).alias("outliers"),
    )


def scatter(
    df: DataFrame, x: str, y: str, *, color: str | None = None, n: int = 500, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """x, y, color of an exact hash sample of ``n`` points with both coordinates."""
    points = df.where(finite(col(x)).isNotNull() & finite(col(y)).isNotNull())
    cut = hash_cut(points, key, n, seed=seed) or ""
    return points.where(hash_key(key, seed) <= cut).select(
        *[col(k) for k in key if k not in (x, y, color)],
        finite(col(x)).alias("x"), finite(col(y)).alias("y"), _group(color).alias("color"),
    )


def line(
    df: DataFrame, y: str, *, x: str | None = None, group: str | None = None, n: int = 10000, key: Sequence[str]
) -> DataFrame:
    """group, bucket, x, y: at most ``n`` points per group in x order (row order = first key column without x).

    With more rows than ``n`` in a group each point is the mean of an equal share of consecutive distinct positions.
    Missing y is dropped, a missing group is ``Missing``.
    """
    at = finite(col(x)) if x else finite(col(key[0]))
    data = df.select(_group(group).alias("group"), at.alias("x"), finite(col(y)).alias("y")).where(
        "x is not null and y is not null"
    )
    run = cumulative(data, "x", by=["group"], sums={"n": F.count(F.lit(1)), "s": F.sum("y")})
    width = F.greatest(F.ceil(F.col("n_total") / n), F.lit(1))
    return run.withColumn("bucket", F.floor(F.col("n_before") / width)).groupBy("group", "bucket").agg(
        (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), (F.sum("s") / F.sum("n")).alias("y")
    )
