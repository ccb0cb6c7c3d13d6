"""Samples of exact size, folds and bootstraps, chosen by a hash of the row key.

The outcome depends on the seed and the keys only, never on partitioning. Rows with one key are told apart by
their other columns, so sizes are exact even if keys repeat.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablemine.domain import col
from tablemine.functions.ordering import hash_cuts, hash_edge, hash_key, hash_rank
from tablemine.session import cut as checkpointed

#: Classes up to which their thresholds are sent to all tasks, so that rows stay where they are.
CLASS_ROWS = 100_000


def sample(
    df: DataFrame,
    *,
    kind: str = "proportion",
    pct: float = 70,
    n: int = 1,
    folds: int = 10,
    fold: int = 1,
    replacement: bool = False,
    stratify: str | None = None,
    seed: int = 42,
    key: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """(sample, remaining). ``kind``: proportion (ceil(pct% of n)), fixed, cv (all but one fold) or bootstrap.

    Folds count from 1. ``stratify`` names a column whose values keep their share.
    """
    if kind == "bootstrap":
        return _draws(df, df.count(), seed, key)
    if kind == "fixed" and replacement:
        return _draws(df, n, seed, key)
    if kind == "cv":
        return _folds(df, folds, fold, stratify, seed, key)
    if kind not in ("proportion", "fixed"):
        raise ValueError(f"unknown kind of sample {kind!r}")
    if stratify:
        return _per_class(df, pct, n if kind == "fixed" else None, stratify, seed, key)
    size = n if kind == "fixed" else math.ceil(pct / 100 * df.count())
    cut, excess = hash_edge(df, key, size, seed=seed)
    h = hash_key(key, seed)
    if cut is None:
        return df.where(F.lit(False)), df
    if excess:  # keys repeat: the rows of one key are told apart
        return _parted(df, hash_rank(df, key, seed=seed, name="_pos", ties=True), F.col("_pos") < size)
    return df.where(h <= cut), df.where(h > cut)


def _folds(df, folds, fold, stratify, seed, key):
    ranked = with_fold(df, folds, stratify=stratify, seed=seed, key=key, name="_fold")
    held = F.col("_fold") == fold - 1
    return ranked.where(~held).drop("_fold"), ranked.where(held).drop("_fold")


def with_fold(
    df: DataFrame, folds: int, *, stratify: str | None = None, seed: int = 42, key: Sequence[str], name: str = "fold"
) -> DataFrame:
    """Add the 0-based fold: position in hash order (per class if stratified) modulo the number of folds."""
    by = [stratify] if stratify else []
    ranked = hash_rank(df, key, seed=seed, by=by, name="_pos")
    return ranked.withColumn(name, (F.col("_pos") % folds).cast("int")).drop("_pos")


def _per_class(df, pct, n, stratify, seed, key):
    """Every class gives ceil(pct%) rows; with a fixed n, the share of n rounded by largest remainder, then by class."""
    sizes = df.groupBy(col(stratify).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    if n is None:
        quota = sizes.select("_c", F.ceil(F.lit(pct) / 100 * F.col("_n")).alias("_q"))
    else:
        total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        exact = F.col("_n") * F.lit(min(n, total)) / F.lit(total)
        left = W.partitionBy(F.lit(0)).orderBy((exact - F.floor(exact)).desc(), "_c")
        short = F.lit(min(n, total)) - F.sum(F.floor(exact)).over(W.partitionBy(F.lit(0)))
        quota = sizes.select("_c", (F.floor(exact) + (F.row_number().over(left) <= short).cast("long")).alias("_q"))
    cuts = checkpointed(hash_cuts(df, key, stratify, quota, seed=seed))
    classes = cuts.count()
    attach = lambda rows, facts: rows.join(F.broadcast(facts) if classes <= CLASS_ROWS else facts, col(stratify).eqNullSafe(F.col("_c")), "left")
    if cuts.where("_excess > 0").isEmpty():
        return _parted(df, attach(df, cuts), hash_key(key, seed) <= F.col("_cut"))
    ranked = hash_rank(df, key, seed=seed, by=[stratify], name="_pos", ties=True)
    return _parted(df, attach(ranked, quota), F.col("_pos") < F.col("_q"))


def _parted(df, rows, chosen):
    """(chosen, others) of ``rows``, with the columns of ``df``."""
    names, chosen = [col(c) for c in df.columns], F.coalesce(chosen, F.lit(False))
    return rows.where(chosen).select(*names), rows.where(~chosen).select(*names)


def _draws(df, k, seed, key):
    """``k`` draws: the j-th takes the row whose position in hash order is 48 bits of md5(seed, draw, j) modulo n."""
    total = df.count()
    if total == 0 or k == 0:
        return df.where(F.lit(False)), df
    spark = df.sparkSession
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("draw"), F.col("id").cast("string")))
    times = (
        spark.range(k)
        .select((F.conv(F.substring(draw, 1, 12), 16, 10).cast("long") % total).alias("_pos"))
        .groupBy("_pos")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    ranked = hash_rank(df, key, seed=seed, name="_pos")
    drawn = ranked.join(times, "_pos", "left")
    copies = F.explode(F.sequence(F.lit(1), F.col("_times")))
    picked = drawn.where("_times is not null").withColumn("_copy", copies)
    names = [col(c) for c in df.columns]
    return picked.select(*names), drawn.where("_times is null").select(*names)
