"""Scoring attributes against the class and keeping the best."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablemine.domain import CONTINUOUS, DISCRETE, META, STRING, ColumnSpec, col, discrete_values, domain_of, finite, stamp
from tablemine.functions.ordering import cumulative, hash_cut, hash_key
from tablemine.operators.correlation import pearson_pairs
from tablemine.operators.neighbors import Lists, fold_nearest
from tablemine.operators.prep import bin_index, equal_freq_cuts
from tablemine.operators.rows import select_columns
from tablemine.operators.statistics import CHUNK
from tablemine.session import cut, scratch_path

#: Continuous attributes are cut into this many equal-frequency bins before counting.
BINS = 4

# Names of the score columns.
CLASSIFICATION = ("InfoGain", "GainRatio", "Gini", "ANOVA", "Chi2")
REGRESSION = ("UnivariateLinearRegression", "RReliefF")


def contingency(df: DataFrame, target: str, names: Sequence[str], cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """feature, bin, cls, n of the rows with both known: one scan, shuffling only combined counts."""
    domain = domain_of(df)
    if cuts is None:
        cuts = equal_freq_cuts(df, [n for n in names if domain[n].var_type != DISCRETE], BINS)
    cells = []
    for n in names:
        binned = bin_index(finite(col(n)), cuts[n]).cast("string") if n in cuts else col(n).cast("string")
        cells.append(F.struct(F.lit(n).alias("feature"), binned.alias("bin"), col(target).cast("string").alias("cls")))
    long = df.select(F.inline(F.array(*cells))).where("bin is not null and cls is not null")
    return long.groupBy("feature", "bin", "cls").agg(F.count(F.lit(1)).alias("n"))


def _plogp(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def class_scores(counts: DataFrame) -> DataFrame:
    """feature, InfoGain, GainRatio, Gini, Chi2 from a contingency table (a few rows per feature)."""
    f = W.partitionBy("feature")
    t = counts.select(
        "feature", "bin", "cls", "n",
        F.sum("n").over(f).alias("total"),
        F.sum("n").over(W.partitionBy("feature", "bin")).alias("in_bin"),
        F.sum("n").over(W.partitionBy("feature", "cls")).alias("in_cls"),
    )
    n, total, in_bin, in_cls = (F.col(c) for c in ("n", "total", "in_bin", "in_cls"))
    share, expected = n / in_bin, in_bin * in_cls / total
    # Sums over cells; marginal terms are spread over the cells they cover. Cells that never occur add e to chi-square.
    out = t.groupBy("feature").agg(
        F.sum(n / in_cls * _plogp(in_cls / total)).alias("h_cls"),
        F.sum(n / in_bin * _plogp(in_bin / total)).alias("h_bin"),
        F.sum(in_bin / total * _plogp(share)).alias("h_cond"),
        F.sum(n / in_cls * F.pow(in_cls / total, 2)).alias("g_cls"),
        F.sum(in_bin / total * share * share).alias("g_cond"),
        F.sum((n - expected) * (n - expected) / expected).alias("chi_seen"),
        F.sum(expected).alias("e_seen"),
        F.max(total).alias("total"),
    )
    gain = F.col("h_cls") - F.col("h_cond")
    return out.select(
        "feature",
        gain.alias("InfoGain"),
        F.when(F.col("h_bin") > 0, gain / F.col("h_bin")).otherwise(0.0).alias("GainRatio"),
        (F.col("g_cond") - F.col("g_cls")).alias("Gini"),
        (F.col("chi_seen") + (F.col("total") - F.col("e_seen"))).alias("Chi2"),
    )


def _numeric(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """Continuous attributes as they are, discrete ones as the position in their ordered values."""
    domain = domain_of(df)
    values = discrete_values(df, [n for n in names if domain[n].var_type == DISCRETE])
    out = {}
    for n in names:
        if n in values:
            code = F.array_position(F.array(*[F.lit(v) for v in values[n]]), col(n).cast("string"))
            out[n] = F.when(code > 0, (code - 1).cast("double"))
        else:
            out[n] = finite(col(n))
    return out


def anova(df: DataFrame, target: str, names: Sequence[str]) -> DataFrame:
    """feature, ANOVA: F statistic of the attribute across the classes, from counts, means and variances per class."""
    numbers = _numeric(df, names)
    known = df.where(col(target).isNotNull())
    parts = None
    for i in range(0, len(names), CHUNK // 3):
        facts = [
            F.struct(F.lit(m).alias("feature"), F.count(numbers[m]).alias("n"), F.avg(numbers[m]).alias("m"), F.var_pop(numbers[m]).alias("v"))
            for m in names[i : i + CHUNK // 3]
        ]
        part = known.groupBy(col(target).alias("_c")).agg(F.array(*facts).alias("_f")).select(F.inline("_f")).where("n > 0")
        parts = part if parts is None else parts.unionAll(part)
    f = W.partitionBy("feature")
    t = parts.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(f) / F.sum("n").over(f))
    s = t.groupBy("feature").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
    )
    score = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return s.select("feature", F.when((F.col("k") > 1) & (F.col("within") > 0), score).otherwise(0.0).alias("ANOVA"))


def univariate_linear(df: DataFrame, target: str, names: Sequence[str]) -> DataFrame:
    """feature, UnivariateLinearRegression: F of the one-variable regression, r^2 / (1 - r^2) * (n - 2)."""
    numbers = _numeric(df, names)
    wide = df.select(*[e.alias(n) for n, e in numbers.items()], finite(col(target)).alias("_target"))
    r = pearson_pairs(wide, [(n, "_target") for n in names])
    r2 = F.col("r") * F.col("r")
    score = F.when(r2 < 1, r2 / (1 - r2) * (F.col("n") - 2))
    return r.select(F.col("a").alias("feature"), F.coalesce(score, F.lit(0.0)).alias("UnivariateLinearRegression"))


def variance(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, Variance: population variance; 0 with fewer than two values."""
    facts = [F.struct(F.lit(n).alias("feature"), F.when(F.count(e) > 1, F.var_pop(e)).otherwise(0.0).alias("Variance")) for n, e in _numeric(df, names).items()]
    return df.agg(F.array(*facts).alias("_f")).select(F.inline("_f"))


def rrelieff(
    df: DataFrame, target: str, names: Sequence[str], *, samples: int | None = None, neighbours: int = 50, seed: int = 42, key: Sequence[str] = ()
) -> DataFrame:
    """feature, RReliefF (Robnik-Sikonja and Kononenko 1997) from all rows and their exact neighbours.

    Rows with equal attributes are one point of the search; where a query takes some of them, the gap of the target is its mean
    over all of them, the query's own row left out. Attributes are scaled to [0, 1]; missing values count as the mean.
    Neighbour weights fall with rank: exp(-(rank / 20)^2). With ``samples`` only so many rows, the first by the hash of
    ``key``, are queries; all rows remain neighbours.
    """
    numbers = _numeric(df, names)
    y = finite(col(target))
    span = df.agg(*[g(e).alias(f"{p}{i}") for i, e in enumerate([*numbers.values(), y]) for p, g in (("lo", F.min), ("hi", F.max), ("mean", F.avg))]).first()

    def scaled(e: Column, i: int) -> Column:
        width = (span[f"hi{i}"] - span[f"lo{i}"]) if span[f"lo{i}"] is not None else 0
        if not width:
            return F.lit(0.0)
        return (F.coalesce(e, F.lit(span[f"mean{i}"])) - F.lit(span[f"lo{i}"])) / F.lit(float(width))

    known = df.where(col(target).isNotNull())
    vector = F.array(*[scaled(e, i) for i, e in enumerate(numbers.values())])
    asked = F.lit(1) if samples is None else (hash_key(key, seed) <= F.lit(hash_cut(known, key, samples, seed=seed) or "")).cast("int")
    rows = known.select(vector.alias("v"), scaled(y, len(names)).alias("y"), asked.alias("a")).groupBy("v", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"))
    # A point of more values than ``few`` has no neighbour but itself, and ends the list of any other.
    few = max(64, neighbours + 1)
    kinds = rows.withColumn("kinds", F.count(F.lit(1)).over(W.partitionBy("v")))
    cells = F.array_sort(F.collect_list(F.when(F.col("kinds") <= few, F.struct("y", "n", "a"))))
    path = scratch_path(df.sparkSession, "rrelieff-points")
    small = F.max("kinds") <= few
    kinds.groupBy("v").agg(F.sum("n").alias("w"), (small & (F.sum("a") > 0)).alias("asks"), cells.alias("cells")).write.parquet(path)
    points = df.sparkSession.read.parquet(path)
    if points.isEmpty():
        return df.sparkSession.createDataFrame([(n, 0.0) for n in names], "feature string, RReliefF double")
    found = cut(fold_nearest(points, neighbours, _summed_gaps(len(names), neighbours), _SUMS, metric="manhattan"))
    large = points.where(F.size("cells") == 0).select("v")
    if not large.isEmpty():
        alone = rows.join(large, "v").where("a > 0").select("v", F.col("v").alias("nv"), "y", F.col("a").alias("n"), F.lit(1.0).alias("w"))
        gaps = _mean_gaps(found.where("sums IS NULL").drop("sums").unionByName(alone), rows)
        rate, dy = F.col("n") * F.col("w"), F.col("dy")
        diff = [F.abs(F.get("v", F.lit(i)) - F.get("nv", F.lit(i))) for i in range(len(names))]
        parts = F.array(rate * dy, rate, *[rate * d for d in diff], *[rate * dy * d for d in diff])
        found = found.select("sums").unionByName(gaps.select(parts.alias("sums")))
    labels = ["c", "m", *[f"a{i}" for i in range(len(names))], *[f"ca{i}" for i in range(len(names))]]
    sums = found.agg(*[F.sum(F.get("sums", F.lit(i))).alias(n) for i, n in enumerate(labels)])
    facts = [
        F.struct(
            F.lit(n).alias("feature"),
            F.coalesce(
                F.when(F.col("c") > 0, F.col(f"ca{i}") / F.col("c")), F.lit(0.0)
            ).alias("both"),
            F.coalesce(
                F.when(F.col("m") > F.col("c"), (F.col(f"a{i}") - F.col(f"ca{i}")) / (F.col("m") - F.col("c"))), F.lit(0.0)
            ).alias("only"),
        )
        for i, n in enumerate(names)
    ]
    return sums.select(F.inline(F.array(*facts))).select("feature", (F.col("both") - F.col("only")).alias("RReliefF"))


_SUMS = "v array<double>, nv array<double>, y double, n long, w double, sums array<double>"


def _summed_gaps(width: int, neighbours: int) -> Callable[[pa.Table, Lists], Iterator[pa.RecordBatch]]:
    """A fold of :func:`fold_nearest` over points with ``cells``, their values y with the rows n and the asking rows a.

    One row per leaf: the sums of dy, 1, the attributes' gaps and those times dy. Besides, a row without sums for each asking
    value next to a point whose values are too many to be there.
    """
    # A neighbour that stands for ``take`` rows covers that many ranks.
    upto = np.r_[0.0, np.cumsum(np.exp(-((np.arange(1, neighbours + 1) / 20.0) ** 2)))]
    names = [f.split()[0] for f in _SUMS.split(", ")]

    def fold(rows: pa.Table, lists: Lists) -> Iterator[pa.RecordBatch]:
        x = np.asarray(rows.column("v").combine_chunks().flatten()).reshape(-1, width)
        cells = rows.column("cells").combine_chunks()
        size, flat = np.asarray(cells.value_lengths()), cells.flatten()
        y, n, a = (np.asarray(flat.field(c)) for c in ("y", "n", "a"))
        first, weight = np.cumsum(size) - size, np.asarray(rows.column("w"))
        total = np.zeros(2 + 2 * width)
        for q, near, take in lists:
            start = _starts(q)
            last = np.cumsum(take)
            last = last - (last - take)[start]
            raw = upto[last] - upto[last - take]
            w = raw / np.bincount(start, raw, len(raw))[start]
            pair, own = _spread(size[q], first[q])  # each asking value with each neighbour
            keep = a[own] > 0
            pair, own = pair[keep], own[keep]
            large = size[near[pair]] == 0
            if large.any():
                at, of = pair[large], own[large]
                columns = [pa.array(list(x[q[at]])), pa.array(list(x[near[at]])), pa.array(y[of]), pa.array(a[of]), pa.array(w[at]), pa.nulls(len(at), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names)
                pair, own = pair[~large], own[~large]
            each, other = _spread(size[near[pair]], first[near[pair]])
            gap = np.bincount(each, n[other] * np.abs(y[own[each]] - y[other]), len(pair))
            dy = gap / (weight[near[pair]] - (near[pair] == q[pair]))
            rate = a[own] * w[pair]
            diff = np.abs(x[q[pair]] - x[near[pair]])
            total += np.r_[rate @ dy, rate.sum(), rate @ diff, (rate * dy) @ diff]
        empty = [pa.nulls(1, t) for t in (pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array([total.tolist()])], names)

    return fold


def _starts(group: np.ndarray) -> np.ndarray:
    """For each entry the place where its run of equal entries begins."""
    new = np.r_[True, group[1:] != group[:-1]][: len(group)]
    return np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))


def _spread(size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, place): the places ``first[i]``, ``first[i]`` + 1, ... of each i, ``size[i]`` of them."""
    i = np.repeat(np.arange(len(size)), size)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + first[i]


def _mean_gaps(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """v, nv, n, w, dy of ``asked(v, nv, y, n, w)``: dy is the mean of abs(y - other) over the other rows of the point ``nv``.

    Running sums over each point's values, and the asked ones among them, give all means at once.
    """
    values = rows.join(asked.select(F.col("nv").alias("v")).distinct(), "v", "left_semi").select(
        F.col("v").alias("nv"), "y", "n", (F.col("n") * F.col("y")).alias("s")
    )
    places = asked.select("nv", "y").distinct().select("nv", "y", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))
    c = cumulative(values.unionByName(places), "y", by=["nv"], sums={"n": F.sum("n"), "s": F.sum("s")})
    below = F.col("y") * F.col("n_before") - F.col("s_before")
    above = F.col("s_total") - F.col("s_before") - F.col("s") - F.col("y") * (F.col("n_total") - F.col("n_before") - F.col("n"))
    gaps = c.select("nv", "y", F.greatest(below + above, F.lit(0.0)).alias("gap"), F.col("n_total").alias("others"))
    own = F.when(F.col("v") == F.col("nv"), 1).otherwise(0)
    return asked.join(gaps, ["nv", "y"]).select("v", "nv", "n", "w", (F.col("gap") / (F.col("others") - own)).alias("dy"))


def rank_scores(df: DataFrame, *, scoring_method: str = "auto", key: Sequence[str] | None = None) -> DataFrame | None:
    """Feature and every score that fits the class, best first by the primary score, ties in column order.

    Discrete class: InfoGain, GainRatio, Gini, ANOVA, Chi2. Continuous class: UnivariateLinearRegression and, if row
    keys are given, RReliefF. No class: Variance. Primary: the first score whose name contains ``scoring_method``,
    else the first. Missing scores are 0.
    """
    domain = domain_of(df)
    names = [c.name for c in domain.attributes if c.var_type in (CONTINUOUS, DISCRETE)]
    if not names:
        return None
    target = domain.class_var
    if target is None:
        tables, metrics = [variance(df, names)], ["Variance"]
    elif target.var_type == DISCRETE:
        tables = [class_scores(contingency(df, target.name, names)), anova(df, target.name, names)]
        metrics = list(CLASSIFICATION)
    else:
        tables, metrics = [univariate_linear(df, target.name, names)], [REGRESSION[0]]
        if key is not None:
            tables.append(rrelieff(df, target.name, names, key=key))
            metrics.append(REGRESSION[1])
    base = df.sparkSession.createDataFrame(list(enumerate(names)), "position int, feature string")
    for t in tables:
        base = base.join(t, "feature", "left")
    primary = next((m for m in metrics if scoring_method.lower() in m.lower()), metrics[0])
    scores = [F.coalesce(F.nanvl(F.col(m), F.lit(0.0)), F.lit(0.0)).alias(m) for m in metrics]
    ordered = base.select("position", "feature", *scores).orderBy(F.desc(primary), "position")
    return ordered.select(
        stamp(F.col("feature"), ColumnSpec("Feature", STRING, META)), *[stamp(F.col(m), ColumnSpec(m, CONTINUOUS)) for m in metrics]
    )


def rank(
    df: DataFrame,
    *,
    scoring_method: str = "auto",
    select_mode: str = "top_k",
    n_selected: int = 5,
    threshold: float = 0.0,
    key: Sequence[str] | None = None,
) -> tuple[DataFrame | None, DataFrame | None]:
    """(reduced table, scores). Keeps the best ``n_selected`` attributes, those at or above ``threshold`` (at least
    the best one), or all, in their original order. The scores, one row per attribute, are collected."""
    scores = rank_scores(df, scoring_method=scoring_method, key=key)
    if scores is None:
        return None, None
    metrics = scores.columns[1:]
    primary = next((m for m in metrics if scoring_method.lower() in m.lower()), metrics[0])
    rows = [(r["Feature"], r[primary]) for r in scores.collect()]
    if select_mode == "top_k":
        chosen = {n for n, _ in rows[: max(1, min(n_selected, len(rows)))]}
    elif select_mode == "threshold":
        chosen = {n for n, s in rows if s >= threshold} or {rows[0][0]}
    else:
        chosen = {n for n, _ in rows}
    kept = [c.name for c in domain_of(df).attributes if c.name in chosen]
    return select_columns(df, kept), scores
