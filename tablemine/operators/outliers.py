"""Outlier scores and the split into inliers and outliers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemine.domain import CONTINUOUS, DISCRETE, META, ColumnSpec, col, domain_of, stamp
from tablemine.functions.ordering import hash_cut, hash_key, quantiles_of
from tablemine.operators.neighbors import feature_vector, nearest, weighted_points
from tablemine.session import cut

#: Neighbours of the local outlier factor.
LOF_NEIGHBOURS = 20
#: Isolation forest: number of trees and rows per tree, unless the caller says otherwise.
TREES, TREE_ROWS = 100, 256
#: Share of rows that each concentration step of the robust covariance keeps.
SUPPORT = 0.5
#: Its starts: groups of the sample, rows in each, random subsets tried in each, and how many of them go on to the whole table.
GROUPS, GROUP_ROWS, STARTS, BEST = 5, 400, 100, 2
#: Steps over the whole table that all starts take, and how many of them then go on until they settle.
SHARED_STEPS, FINALISTS = 2, 2


def outlier_scores(
    df: DataFrame, *, method: str = "lof", contamination: float = 0.1, seed: int = 42, key: Sequence[str], trees: int = TREES, tree_rows: int = TREE_ROWS,
    max_steps: int = 100,
) -> DataFrame:
    """The table with metas ``score`` (higher is stranger) and ``Outlier`` (yes / no).

    lof (and any unknown name), isolation_forest, covariance. Outliers score above the exact
    ``1 - contamination`` quantile. Missing values count as the column mean. ``trees`` and ``tree_rows`` size the
    isolation forest; the covariance is refitted until it settles, and ``max_steps`` refits without that are an error.
    """
    names = domain_of(df).continuous()
    if not names:
        raise ValueError("outlier detection needs continuous attributes")
    vector = feature_vector(df, names)
    if method == "isolation_forest":
        scored = _isolation(df, vector, seed, key, trees, tree_rows)
    elif method == "covariance":
        scored = _covariance(df, vector, len(names), max_steps, seed, key)
    else:
        scored = _lof(df, vector)
    scored = cut(scored)
    edge = quantiles_of(scored.select("score"), [1 - contamination], by=[], value="score").first()
    flag = F.when(F.col("score") > F.lit(edge.q), "yes").otherwise("no")
    return scored.select(
        *[col(c) for c in df.columns],
        stamp(F.col("score"), ColumnSpec("score", CONTINUOUS, META)),
        stamp(flag, ColumnSpec("Outlier", DISCRETE, META, ("no", "yes"))),
    )


def outliers(
    df: DataFrame, *, method: str = "lof", contamination: float = 0.1, seed: int = 42, key: Sequence[str], **how
) -> tuple[DataFrame, DataFrame]:
    """(inliers, outliers): two filters on :func:`outlier_scores`."""
    scored = outlier_scores(df, method=method, contamination=contamination, seed=seed, key=key, **how)
    return scored.where("Outlier = 'no'").drop("score", "Outlier"), scored.where("Outlier = 'yes'").drop("score", "Outlier")


def _lof(df: DataFrame, vector: Column) -> DataFrame:
    """Local outlier factor (Breunig et al. 2000) on distinct vectors; rows with the same vector share a score."""
    keyed = df.withColumn("_v", vector)
    points = cut(weighted_points(keyed, F.col("_v")))
    total = points.agg(F.sum("w")).first()[0] or 0
    k = min(LOF_NEIGHBOURS, total - 1)
    if k < 1:
        return df.withColumn("score", F.lit(1.0))
    near = cut(nearest(points.select("v", "label"), points, k, exclude_self=True))
    reach = near.groupBy("v").agg(F.max("d").alias("kdist"))
    of_neighbour = reach.select(F.col("v").alias("nv"), F.col("kdist").alias("nk"))
    density = near.join(of_neighbour, "nv").groupBy("v").agg(
        (F.lit(float(k)) / (F.sum(F.col("take") * F.greatest("nk", "d")) + F.lit(k * 1e-10))).alias("lrd")
    )
    around = density.select(F.col("v").alias("nv"), F.col("lrd").alias("nl"))
    mean = near.join(around, "nv").groupBy("v").agg((F.sum(F.col("take") * F.col("nl")) / k).alias("m"))
    score = mean.join(density, "v").select(F.col("v").alias("_v"), (F.col("m") / F.col("lrd")).alias("score"))
    return keyed.join(score, "_v").drop("_v")


def _path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    big = np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), 1.0)
    return np.where(n <= 1, 0.0, big)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Isolation tree as rows (dimension or -1, threshold or path length, left, right)."""
    nodes: list[tuple] = []

    def add(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(())
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_dims = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_dims):
            nodes[me] = (-1, depth + float(_path(len(rows))), -1, -1)
            return me
        d = int(rng.choice(open_dims))
        at = rng.uniform(low[d], high[d])
        below = x[rows, d] <= at
        left, right = add(rows[below], depth + 1), add(rows[~below], depth + 1)
        nodes[me] = (d, float(at), left, right)
        return me

    add(np.arange(len(x)), 0)
    return nodes


def isolation_forest(df: DataFrame, vector: Column, *, seed: int, key: Sequence[str], trees: int = TREES, tree_rows: int = TREE_ROWS) -> list[dict]:
    """Grow the forest (Liu et al. 2008): every tree from its own hash sample of about ``tree_rows`` rows.

    A row belongs to the sample of tree t with probability tree_rows / n by its hash, tested once per row and tree
    inside Arrow batches; only chosen rows (trees x about tree_rows) are shuffled, one group per tree.
    """
    n = df.count()
    share = min(1.0, tree_rows / max(n, 1))

    @F.pandas_udf("array<int>")
    def trees_of(h: pd.Series) -> pd.Series:
        start = np.array([int(x[:16], 16) for x in h], dtype=np.uint64)
        out = np.empty((len(start), trees), dtype=bool)
        for t in range(trees):
            # Multiply-shift mixing of the row hash and the tree number.
            z = start + np.uint64(((t + 1) * 0x9E3779B97F4A7C15) % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, t] = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53 < share
        return pd.Series([np.flatnonzero(r) for r in out])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values("h")["v"].to_numpy())
        nodes = _grow(x, np.random.default_rng(seed * 1000 + t), max(1, math.ceil(math.log2(max(len(x), 2)))))
        d, a, l, r = zip(*nodes)
        return pd.DataFrame({"tree": [t], "rows": [len(x)], "dim": [d], "at": [a], "left": [l], "right": [r]})

    rows = df.select(hash_key(key, seed).alias("h"), vector.alias("v"))
    chosen = rows.select("h", "v", F.explode(trees_of("h")).alias("tree"))
    forest = chosen.groupBy("tree").applyInPandas(
        grow, "tree int, rows int, dim array<int>, at array<double>, left array<int>, right array<int>"
    )
    return [
        {k: np.array(r[k]) for k in ("dim", "at", "left", "right")} | {"rows": r["rows"]}
        for r in sorted(forest.collect(), key=lambda r: r["tree"])
    ]


def forest_scorer(forest: list[dict]):
    """Arrow UDF from a vector to its anomaly score in (0, 1); the forest is at most trees x 2 x tree_rows nodes."""
    scale = float(_path(np.mean([t["rows"] for t in forest]))) or 1.0

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x = np.stack(v.to_numpy())
        depth = np.zeros(len(x))
        for t in forest:
            node = np.zeros(len(x), dtype=int)
            while True:
                i = np.flatnonzero(t["dim"][node] >= 0)
                if not len(i):
                    break
                at = node[i]
                node[i] = np.where(x[i, t["dim"][at]] <= t["at"][at], t["left"][at], t["right"][at])
            depth += t["at"][node]
        return pd.Series(2.0 ** (-depth / len(forest) / scale))

    return score


def _isolation(df: DataFrame, vector: Column, seed: int, key: Sequence[str], trees: int, tree_rows: int) -> DataFrame:
    forest = isolation_forest(df, vector, seed=seed, key=key, trees=trees, tree_rows=tree_rows)
    if not forest:
        return df.withColumn("score", F.lit(0.5))
    return df.withColumn("score", forest_scorer(forest)(vector))


def mahalanobis(mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared Mahalanobis distance of the array column ``v`` as a plain expression."""
    inv = np.linalg.pinv(cov)
    width = len(mean)
    dev = [F.get("v", F.lit(i)) - F.lit(float(mean[i])) for i in range(width)]
    total = F.lit(0.0)
    for i in range(width):
        total = total + dev[i] * dev[i] * F.lit(float(inv[i, i]))
        for j in range(i + 1, width):
            total = total + dev[i] * dev[j] * F.lit(float(2 * inv[i, j]))
    return total


def _nearness(z: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    dev = z - mean
    return np.maximum((dev @ np.linalg.pinv(cov, hermitian=True) * dev).sum(axis=1), 0.0)


def _log_volume(cov: np.ndarray) -> float:
    return float(np.linalg.slogdet(cov + np.eye(len(cov)) * 1e-12)[1])


def _bins(squared: np.ndarray) -> np.ndarray:
    """Bins of distances: 1/256 of a standard deviation up to one, and 1/256 of the distance's logarithm above."""
    far = np.sqrt(squared)
    return np.floor(np.where(far < 1, far * 256, 256 + 256 * np.log(np.maximum(far, 1)))).astype(np.int32)


def best_starts(z: np.ndarray, rng: np.random.Generator, starts: int, best: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(log volume, centre, covariance) of the ``best`` of ``starts`` random subsets of width + 1 rows, each refitted twice to
    the half of ``z`` nearest to it."""
    n, width = z.shape
    out = []
    for _ in range(starts):
        part = z[rng.choice(n, min(n, width + 1), replace=False)]
        for _ in range(2):
            near = _nearness(z, part.mean(axis=0), np.cov(part.T, bias=True).reshape(width, width))
            part = z[np.argsort(near, kind="stable")[: max(1, math.ceil(n * SUPPORT))]]
        cov = np.cov(part.T, bias=True).reshape(width, width)
        out.append((_log_volume(cov), part.mean(axis=0), cov))
    return sorted(out, key=lambda x: x[0])[:best]


def _group_starts(rows: DataFrame, width: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best starts of every hash group of a sample of at most GROUPS x GROUP_ROWS rows ``(h, z)``, one task a group."""
    edge = hash_cut(rows, ["h"], GROUPS * GROUP_ROWS, seed=seed)
    mixed = hash_key(["h"], seed)
    chosen = rows.where(mixed <= F.lit(edge)).select("z", mixed.alias("h")).orderBy("h").limit(GROUPS * GROUP_ROWS)

    def each(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(t=[tuple(v) for v in group["z"]]).sort_values(["h", "t"])
        found = best_starts(np.stack(group["z"].to_numpy()), np.random.default_rng([seed, int(group["g"].iloc[0])]), STARTS, BEST)
        return pd.DataFrame({"g": int(group["g"].iloc[0]), "i": range(len(found)), "mean": [m for _, m, _ in found], "cov": [c.ravel() for _, _, c in found]})

    groups = chosen.withColumn("g", F.pmod(F.crc32(F.col("h").cast("binary")), F.lit(GROUPS)).cast("int"))
    got = groups.groupBy("g").applyInPandas(each, "g int, i int, mean array<double>, cov array<double>").orderBy("g", "i").collect()
    return [(np.array(r["mean"]), np.array(r["cov"]).reshape(width, width)) for r in got]


def _matrix(part: pa.RecordBatch, width: int) -> np.ndarray:
    return part.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _held_edges(rows: DataFrame, fits: list[tuple[np.ndarray, np.ndarray]], width: int) -> list[int]:
    """For every fit, the bin of distances that fills the half of the rows nearest to it; one pass for all fits."""

    def tally(parts):
        found = [{} for _ in fits]
        for part in parts:
            z = _matrix(part, width)
            for at, fit in zip(found, fits):
                counts = np.bincount(_bins(_nearness(z, *fit)), minlength=1)
                for b in np.flatnonzero(counts).tolist():
                    at[b] = at.get(b, 0) + int(counts[b])
        rows = [(k, b, n) for k, at in enumerate(found) for b, n in at.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["k", "b", "n"])

    counts: list[list] = [[] for _ in fits]
    for r in rows.select("z").mapInArrow(tally, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).orderBy("k", "b").collect():
        counts[r.k].append((r.b, r.n))
    out = []
    for at in counts:
        held = np.cumsum([n for _, n in at])
        out.append(at[int(np.searchsorted(held, SUPPORT * held[-1]))][0])
    return out


def _refitted(rows: DataFrame, fits: list[tuple[np.ndarray, np.ndarray]], edges: list[int], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centre and covariance of the rows within each fit's edge; one pass for all fits, tasks send sums."""

    def sums(parts):
        total = np.zeros((len(fits), 1 + width + width * width))
        for part in parts:
            z = _matrix(part, width)
            for k, (fit, edge) in enumerate(zip(fits, edges)):
                near = z[_bins(_nearness(z, *fit)) <= edge] - fit[0]
                total[k] += np.concatenate([[len(near)], near.sum(axis=0), (near.T @ near).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(fits)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["k", "s"])

    each = rows.select("z").mapInArrow(sums, "k int, s array<double>").select("k", F.posexplode("s").alias("i", "x"))
    total = np.zeros((len(fits), 1 + width + width * width))
    for r in each.groupBy("k", "i").agg(F.sum("x").alias("x")).collect():
        total[r.k, r.i] = r.x
    out = []
    for (mean, _), t in zip(fits, total):
        shift = t[1 : 1 + width] / t[0]
        out.append((mean + shift, t[1 + width :].reshape(width, width) / t[0] - np.outer(shift, shift)))
    return out


def _covariance(df: DataFrame, vector: Column, width: int, max_steps: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Robust distance by concentration steps from many starts (Rousseeuw and Van Driessen 1999).

    Hash groups of a bounded sample each try STARTS random subsets of width + 1 rows, refit them twice to the nearest half
    and send their BEST; the median and spread of each column are one start more. All starts then take steps over the whole
    table together: keep the half of the rows nearest to the centre, refit. After SHARED_STEPS the FINALISTS of lowest determinant go
    on until it stops falling. The lowest determinant wins, so an outlying cluster of up to almost half of the rows doesn't mislead the result as it would mislead
    the median. A step is two passes whatever the number of starts; a start that meets another one's fit is dropped. The
    sample only proposes starts: every step and the winner's determinant are those of all rows.
    """
    mixed = F.md5(F.concat(hash_key(key, seed), F.xxhash64("v").cast("string")))  # rows of a key shared by many are told apart
    keyed = df.withColumn("v", vector).select(mixed.alias("h"), "v")
    long = keyed.select(F.posexplode("v").alias("feature", "value"))
    quart: dict[int, dict[float, float]] = {i: {} for i in range(width)}
    for r in quantiles_of(long, [0.25, 0.5, 0.75], groups=width).collect():
        quart[r.feature][r.p] = r.q
    middle = np.array([quart[i].get(0.5, 0.0) for i in range(width)])
    spread = np.array([(quart[i].get(0.75, 0.0) - quart[i].get(0.25, 0.0)) / 1.349 for i in range(width)])
    spread = np.where(spread > 0, spread, 1.0)
    scaled = F.array(*[(F.get("v", F.lit(i)) - F.lit(float(middle[i]))) / F.lit(float(spread[i])) for i in range(width)])
    rows = keyed.select("h", scaled.alias("z")).persist()
    try:
        if rows.isEmpty():
            return df.withColumn("score", F.lit(0.0))
        fits = [(np.zeros(width), np.eye(width)), *_group_starts(rows, width, seed)]
        live, best = [(math.inf, f) for f in fits], (math.inf, fits[0])
        for step in range(max_steps):
            fits = [f for _, f in live]
            following, seen = [], []
            for (last, _), fit in zip(live, _refitted(rows, fits, _held_edges(rows, fits, width), width)):
                size = _log_volume(fit[1])
                if size < best[0]:
                    best = (size, fit)
                met = any(abs(size - other) < 1e-9 and np.allclose(fit[0], centre, atol=1e-9) for other, centre in seen)
                if size < last - 1e-6 and not met:
                    following.append((size, fit))
                    seen.append((size, fit[0]))
            live = sorted(following, key=lambda x: x[0])[:FINALISTS] if step + 1 >= SHARED_STEPS else following
            if not live:
                break
        else:
            raise RuntimeError(f"the covariance did not settle within {max_steps} steps")
    finally:
        rows.unpersist()
    mean, cov = middle + spread * best[1][0], best[1][1] * np.outer(spread, spread)
    return df.withColumn("v", vector).withColumn("score", mahalanobis(mean, cov)).drop("v")
