"""Global order without a single task: ranks, running sums, exact order statistics, hash-ordered samples.

Rows that share a value are first combined into one row per distinct value, so a value that holds a third of the
table costs one row. Distinct values are then split into ordered buckets at approximate quantiles; only the bucket
totals (at most ``BUCKETS`` rows per group) meet in one place, and the sort runs bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablemine.domain import col

#: Per-group tables are broadcast up to this many rows; past it, or with an unknown number of groups, Spark chooses.
BROADCAST_ROWS = 1_000_000
#: Rows of a hash bucket that are put in order without another histogram.
BUCKET_ROWS = 100_000
#: Least and most ordered buckets per group; between them the number follows the session's shuffle partitions.
MIN_BUCKETS, MAX_BUCKETS = 64, 8192


def _buckets(spark: SparkSession) -> int:
    """A power of two near the shuffle partitions: the bucket of a value is found by binary search."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << (wanted - 1).bit_length()))


def _bucket_of(value: Column, splits: Column, buckets: int) -> Column:
    """Number of splits strictly below ``value``, by binary search over the sorted split array."""

    def step(pos: Column, i: Column) -> Column:
        nxt = pos + F.call_function("shiftright", F.lit(buckets // 2), i)
        return F.when(F.get(splits, nxt - 1) < value, nxt).otherwise(pos)

    rounds = F.sequence(F.lit(0), F.lit(buckets.bit_length() - 2))
    return F.aggregate(rounds, F.lit(0), step)


def _in_buckets(
    df: DataFrame, value: str, by: Sequence[str], sums: dict[str, Column], small: bool
) -> tuple[DataFrame, DataFrame]:
    """(distinct values with their measures and bucket ``_b``, bucket table).

    The bucket table holds per (group, ``_b``) each measure's sum ``_s_m``, its sum over the lower buckets ``_o_m`` and
    over the group ``m_total``. The input is read and combined once: all uses below share that one shuffle.
    """
    keys = [col(c) for c in by]
    buckets = _buckets(df.sparkSession)
    distinct = df.where(col(value).isNotNull()).groupBy(*keys, col(value)).agg(*[e.alias(m) for m, e in sums.items()])
    number = col(value).cast("double")
    probs = F.expr("array(" + ",".join(f"{i / buckets}D" for i in range(1, buckets)) + ")")
    # The condition always holds; it makes the splits read every measure, so that each use of ``distinct`` has the
    # same columns and Spark reuses one exchange in place of reading the input again.
    all_read = F.hash(*sums) >= F.lit(-(2**31))
    splits = distinct.groupBy(*keys).agg(
        F.percentile_approx(F.when(all_read, number), probs, max(10000, 10 * buckets)).alias("_splits")
    )
    bucketed = _attach(distinct, splits, by, small).withColumn("_b", _bucket_of(number, F.col("_splits"), buckets)).drop("_splits")
    per_bucket = bucketed.groupBy(*keys, "_b").agg(*[F.sum(m).alias(f"_s_{m}") for m in sums])
    group = W.partitionBy(*(keys or [F.lit(0)]))
    lower = group.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = per_bucket.select(
        *keys,
        "_b",
        *[f"_s_{m}" for m in sums],
        *[F.coalesce(F.sum(f"_s_{m}").over(lower), F.lit(0)).alias(f"_o_{m}") for m in sums],
        *[F.sum(f"_s_{m}").over(group).alias(f"{m}_total") for m in sums],
    )
    return bucketed, totals


def cumulative(
    df: DataFrame,
    value: str,
    *,
    by: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
    groups: int | None = None,
) -> DataFrame:
    """One row per (group, distinct value) in ascending order, with the total of each measure before that value.

    Returns the group columns, ``value`` and for each measure m its sum ``m`` at the value, ``m_before`` and the
    group's ``m_total``. NULL values are left out. The default measure is the row count ``n``. ``groups`` bounds the
    number of groups if the caller knows it (columns, classes): see ``BROADCAST_ROWS``.
    """
    by = list(by)
    keys = [col(c) for c in by]
    sums = {"n": F.count(F.lit(1))} if sums is None else sums
    small = _small(df.sparkSession, by, groups)
    bucketed, totals = _in_buckets(df, value, by, sums, small)
    inside = W.partitionBy(*keys, "_b").orderBy(col(value)).rowsBetween(W.unboundedPreceding, -1)
    running = bucketed.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_r_{m}") for m in sums])
    return _attach(running, totals, [*by, "_b"], small).select(
        *keys,
        col(value),
        *sums,
        *[(F.col(f"_r_{m}") + F.col(f"_o_{m}")).alias(f"{m}_before") for m in sums],
        *[f"{m}_total" for m in sums],
    )


def _small(spark: SparkSession, by: Sequence[str], groups: int | None) -> bool:
    """Whether a table of one row per group and bucket is proven to be small."""
    return not by or (groups is not None and groups * _buckets(spark) <= BROADCAST_ROWS)


def _attach(big: DataFrame, facts: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Join per-group facts to rows; group values may be NULL, so keys compare null-safe."""
    if not keys:
        one = facts.select(F.struct(*facts.columns).alias("_s")).scalar()
        return big.select("*", one.alias("_one")).select(*big.columns, "_one.*")
    renamed = facts.select(*[col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[c for c in facts.columns if c not in keys])
    condition = reduce(Column.__and__, [col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    joined = big.join(F.broadcast(renamed) if small else renamed, condition, "left")
    return joined.drop(*[f"_k{i}" for i in range(len(keys))])


def average_rank(
    df: DataFrame, value: str, *, by: Sequence[str] = (), weight: str | None = None, groups: int | None = None
) -> DataFrame:
    """(group, value) -> rank and group size n_total; tied values share the mean of the ranks they cover (1-based).

    With ``weight`` a row stands for that many equal rows.
    """
    c = cumulative(df, value, by=by, sums={"n": F.sum(weight) if weight else F.count(F.lit(1))}, groups=groups)
    return c.select(*[col(b) for b in by], col(value), (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"), "n_total")


def long_form(df: DataFrame, names: Sequence[str], *, keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric columns to (keep..., feature, value) with NULL and NaN values left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), col(n).cast("double").alias("value")) for n in names])
    out = df.select(*[col(k) for k in keep], F.explode(pairs).alias("_p")).select(*[col(k) for k in keep], "_p.feature", "_p.value")
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def quantiles_of(
    long: DataFrame, probs: Sequence[float], *, by: Sequence[str] = ("feature",), value: str = "value", groups: int | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per group: (group..., p, q).

    The bucket totals tell which buckets hold the wanted order statistics; only those buckets, at most two per
    probability, are sorted. No group is gathered in one place, and the other values are never shuffled again.
    """
    by = list(by)
    keys = [col(b) for b in by]
    small = _small(long.sparkSession, by, groups)
    bucketed, totals = _in_buckets(long, value, by, {"n": F.count(F.lit(1))}, small)
    places = [F.lit(float(p)) * (F.col("n_total") - 1) for p in probs]
    ranks = [f(place) for place in places for f in (F.floor, F.ceil)]
    covers = lambda rank, before, n: (before <= rank) & (rank < before + n)
    held = reduce(Column.__or__, [covers(r, F.col("_o_n"), F.col("_s_n")) for r in ranks])
    wanted = totals.where(held).select(*[col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_b").alias("_kb"), "_o_n", "n_total")
    same = reduce(Column.__and__, [col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)], F.col("_b") == F.col("_kb"))
    few = bucketed.join(F.broadcast(wanted) if small else wanted, same)
    running = W.partitionBy(*keys, "_b").orderBy(col(value)).rowsBetween(W.unboundedPreceding, -1)
    c = few.withColumn("_before", F.col("_o_n") + F.coalesce(F.sum("n").over(running), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when(covers(rank, F.col("_before"), F.col("n")), col(value)))

    picks = []
    for p, place in zip(probs, places):
        lo, hi = at(F.floor(place)), at(F.ceil(place))
        picks.append(F.struct(F.lit(float(p)).alias("p"), (lo + (hi - lo) * F.max(place - F.floor(place))).alias("q")))
    return c.groupBy(*keys).agg(F.array(*picks).alias("_q")).select(*keys, F.inline("_q"))


def column_quantiles(df: DataFrame, names: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float]]:
    """Exact quantiles of numeric columns, collected: columns x probabilities numbers."""
    out: dict[str, dict[float, float]] = {n: {} for n in names}
    if names:
        for r in quantiles_of(long_form(df, names), probs, groups=len(names)).collect():
            out[r.feature][r.p] = r.q
    return out


# --- hash order -------------------------------------------------------------------------------------------------


def hash_key(key: Sequence[str], seed: int | str = 42) -> Column:
    """md5 of the seed and the row key as text; the same on every engine and every run.

    Each part is written as its length and text, NULL as ``~``, so different keys never give the same text.
    """
    text = lambda k: col(k).cast("string")
    part = lambda k: F.when(col(k).isNull(), F.lit("~")).otherwise(F.concat(F.length(text(k)).cast("string"), F.lit(":"), text(k)))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[part(k) for k in key]))


def _prefix(h: Column, width: int) -> Column:
    return F.conv(F.substring(h, 1, width), 16, 10).cast("long")


def hash_rank(df: DataFrame, key: Sequence[str], *, seed: int | str = 42, by: Sequence[str] = (), name: str = "_rank", ties: bool = False) -> DataFrame:
    """Add the 0-based position of each row in hash order, within its group if ``by`` is given.

    The hash prefix spreads every group evenly over 65,536 ordered buckets, so a class with a third of the rows is
    split like any other. One shuffle of the rows; the bucket totals are (groups x 65,536) small rows. ``ties`` puts rows
    of one key in order by a hash of all their columns, for keys that repeat.
    """
    by = list(by)
    h = df.withColumn("_h", hash_key(key, seed)).withColumn("_b", _prefix(F.col("_h"), 4))
    counts = h.groupBy(*[col(c) for c in by], "_b").agg(F.count(F.lit(1)).alias("_n"))
    groups = [col(c) for c in by] or [F.lit(0)]
    before = W.partitionBy(*groups).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[col(c) for c in by], "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    joined = _attach(h, offsets, [*by, "_b"], small=not by)
    local = W.partitionBy(*[col(c) for c in by], "_b").orderBy("_h", *([F.xxhash64(*[col(c) for c in df.columns])] if ties else []))
    return joined.withColumn(name, F.row_number().over(local) - 1 + F.col("_off")).drop("_h", "_b", "_off")


def _edge(h: DataFrame, size: int) -> tuple[str, int] | None:
    """(cut, excess) for hashes ``h(_h)``: as many are <= cut as asked, plus ``excess`` that share the last hash.

    Histograms over four more digits at a time find the bucket the cut falls in, until it holds few rows; only that bucket
    is grouped by hash and put in order. None if there are no more than ``size`` rows.
    """
    prefix, need = "", size
    running = W.partitionBy(F.lit(0))
    while True:
        inside = h.where(F.col("_h").startswith(prefix)) if prefix else h
        width = len(prefix) + 4
        counts = inside.groupBy(F.substring("_h", 1, width).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        edge = counts.withColumn("_cum", F.sum("_n").over(running.orderBy("_b"))).where(F.col("_cum") >= need).orderBy("_b").limit(1).collect()
        if not edge:
            return None
        prefix, need = edge[0]["_b"], need - (edge[0]["_cum"] - edge[0]["_n"])
        if edge[0]["_n"] <= BUCKET_ROWS or width >= 32:
            break
    counts = h.where(F.col("_h").startswith(prefix)).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    last = counts.withColumn("_cum", F.sum("_n").over(running.orderBy("_h"))).where(F.col("_cum") >= need).orderBy("_h").limit(1).collect()[0]
    return last["_h"], last["_cum"] - need


def hash_cut(df: DataFrame, key: Sequence[str], size: int, *, seed: int | str = 42) -> str | None:
    """Largest hash among the ``size`` smallest: rows with ``hash_key <= cut`` are a sample of that size if keys identify rows.

    Aggregates over the keys and no shuffle of rows. All rows if there are no more; None for none.
    """
    return hash_edge(df, key, size, seed=seed)[0]


def hash_edge(df: DataFrame, key: Sequence[str], size: int, *, seed: int | str = 42) -> tuple[str | None, int]:
    """(cut, excess): as :func:`hash_cut`, and how many rows too many share the last key. 0 if keys identify rows."""
    if size <= 0:
        return None, 0
    return _edge(df.select(hash_key(key, seed).alias("_h")), size) or ("g", 0)  # above every hex digit: all rows


def hash_cuts(df: DataFrame, key: Sequence[str], by: str, quota: DataFrame, *, seed: int | str = 42) -> DataFrame:
    """(_c, _cut, _excess) per group of ``by``: rows with ``hash_key <= _cut`` are the ``_q`` first of the group, as
    ``quota(_c, _q)`` asks, and ``_excess`` more that share the last key.

    As :func:`hash_cut`, for all groups at once: only the bucket a cut falls in, 1 / 65,536 of a group, is ordered.
    """
    h = df.select(col(by).alias("_g"), hash_key(key, seed).alias("_h")).withColumn("_b", _prefix(F.col("_h"), 4))
    counts = h.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    run = counts.withColumn("_cum", F.sum("_n").over(W.partitionBy("_g").orderBy("_b")))
    asked = run.join(quota, F.col("_g").eqNullSafe(F.col("_c")))
    edge = asked.where((F.col("_cum") >= F.col("_q")) & (F.col("_cum") - F.col("_n") < F.col("_q"))).select(
        "_c", F.col("_b").alias("_eb"), (F.col("_q") - (F.col("_cum") - F.col("_n"))).alias("_need")
    )
    inside = h.join(edge, F.col("_g").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_eb")))
    each = inside.groupBy("_c", "_h", "_need").agg(F.count(F.lit(1)).alias("_n"))
    each = each.withColumn("_cum", F.sum("_n").over(W.partitionBy("_c").orderBy("_h")))
    first = F.min(F.when(F.col("_cum") >= F.col("_need"), F.struct(F.col("_h").alias("h"), (F.col("_cum") - F.col("_need")).alias("e"))))
    return each.groupBy("_c").agg(first.alias("_f")).select("_c", F.col("_f.h").alias("_cut"), F.col("_f.e").alias("_excess"))
