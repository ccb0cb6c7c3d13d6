"""Entropy-based cut points: every boundary between two distinct values is a candidate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.domain import col
from tablemine.functions.ordering import cumulative, long_form
from tablemine.session import cut


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Entropy in bits along the last axis of a count array."""
    total = counts.sum(axis=-1, keepdims=True)
    p = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
    logs = np.log2(p, out=np.zeros_like(p), where=p > 0)
    return -(p * logs).sum(axis=-1)


def _after(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Mean entropy of the two sides, one row of class counts per candidate."""
    nl, nr = left.sum(axis=1), right.sum(axis=1)
    return (nl * _entropy(left) + nr * _entropy(right)) / (nl + nr)


def _pays(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether the cut between two class counts is worth its description."""
    both = left + right
    n, h, hl, hr = both.sum(), _entropy(both), _entropy(left), _entropy(right)
    k, kl, kr = [(x > 0).sum() for x in (both, left, right)]
    gain = h - _after(left[None], right[None])[0]
    penalty = np.log2(3.0**k - 2) - (k * h - kl * hl - kr * hr)
    return bool(gain > (np.log2(n - 1) + penalty) / n)


def split_points(values: np.ndarray, counts: np.ndarray) -> list[float]:
    """Accepted cuts of one column in memory. ``counts[i, c]``: rows of class c in the i-th ascending value range, which
    starts at ``values[i]``; a cut before range i is reported as ``values[i]``."""
    if len(values) < 2:
        return []
    left = np.cumsum(counts, axis=0)[:-1]
    right = counts.sum(axis=0) - left
    best = int(np.argmin(_after(left, right)))
    if not _pays(left[best], right[best]):
        return []
    at = best + 1
    return [*split_points(values[:at], counts[:at]), float(values[at]), *split_points(values[at:], counts[at:])]


def mdl_cuts(df: DataFrame, names: list[str], target: str) -> dict[str, list[float]]:
    """Cuts per column. Spark reduces the table to one row per (column, distinct value) with the class counts below it, once;
    each level then scans these rows for the best boundary of every open segment. The driver holds one row of class counts
    per segment, tasks one candidate per segment."""
    known = df.where(col(target).isNotNull())
    classes = sorted(r[0] for r in known.select(col(target)).distinct().collect())
    cuts: dict[str, list[float]] = {n: [] for n in names}
    if not names or len(classes) < 2:
        return cuts
    long = long_form(known, names, keep=[target]).withColumnRenamed(target, "cls")
    sums = {f"c{i}": F.count(F.when(F.col("cls") == F.lit(c), 1)) for i, c in enumerate(classes)}
    below = cut(cumulative(long, "value", by=["feature"], sums=sums, groups=len(names)))
    befores, totals = [f"c{i}_before" for i in range(len(classes))], [f"c{i}_total" for i in range(len(classes))]
    whole = below.groupBy("feature").agg(F.min("value").alias("low"), *[F.first(t).alias(t) for t in totals]).collect()
    # Open segments of a column, ascending: first value, first value past it, class counts below it and inside.
    zero = np.zeros(len(classes))
    open_ = {r.feature: [(r.low, np.inf, zero, np.array([r[t] for t in totals], dtype=float))] for r in whole}
    while open_:
        found = _best_boundaries(below, befores, open_).collect()
        grown: dict[str, list[tuple]] = {}
        for r in sorted(found, key=lambda r: (r.feature, r.segment)):
            low, high, base, inside = open_[r.feature][r.segment]
            left = np.array(r.best["below"])
            if _pays(left, inside - left):
                at = r.best["value"]
                cuts[r.feature].append(at)
                grown.setdefault(r.feature, []).extend([(low, at, base, left), (at, high, base + left, inside - left)])
        open_ = grown
    return {n: sorted(c) for n, c in cuts.items()}


def _best_boundaries(below: DataFrame, befores: list[str], open_: dict[str, list[tuple]]) -> DataFrame:
    """feature, segment, best(after, value, below) for each open segment of two or more values, ties to the smaller value."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple, tuple] = {}
        for pdf in batches:
            for feature, rows in pdf.groupby("feature"):
                if feature not in open_:
                    continue
                segments = open_[feature]
                lows, highs = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
                value = rows["value"].to_numpy()
                place = np.searchsorted(lows, value, side="right") - 1
                # The first value of a segment has no boundary inside it; the last segment has no end.
                inner = (place >= 0) & (value > lows[place]) & ((value < highs[place]) | (highs[place] == np.inf))
                if not inner.any():
                    continue
                value, place = value[inner], place[inner]
                left = rows[befores].to_numpy(dtype=float)[inner] - np.stack([s[2] for s in segments])[place]
                after = _after(left, np.stack([s[3] for s in segments])[place] - left)
                order = np.lexsort((value, after, place))
                first = order[np.unique(place[order], return_index=True)[1]]
                for i in first:
                    mine = (float(after[i]), float(value[i]), left[i].tolist())
                    key = (feature, int(place[i]))
                    best[key] = min(best.get(key, mine), mine)
        if best:
            yield pd.DataFrame([(f, s, *b) for (f, s), b in best.items()], columns=["feature", "segment", "after", "value", "below"])

    schema = "feature string, segment int, after double, value double, below array<double>"
    return below.select("feature", "value", *befores).mapInPandas(scan, schema).groupBy("feature", "segment").agg(
        F.min(F.struct("after", "value", "below")).alias("best")
    )
