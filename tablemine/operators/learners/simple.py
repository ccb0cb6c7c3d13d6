"""Constant, naive Bayes and nearest-neighbour learners."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablemine.domain import col, discrete_values, domain_of, finite
from tablemine.operators.learners.base import (
    PREDICTION, PROBABILITIES, Design, Learner, Model, class_code,
)
from tablemine.operators.neighbors import nearest, weighted_points
from tablemine.operators.prep import bin_index, equal_freq_cuts
from tablemine.operators.ranking import BINS, contingency
from tablemine.session import cut


class ConstantModel(Model):
    def __init__(self, name, target, classes, value, shares=None):
        super().__init__(name, target, classes)
        self.value, self.shares = value, shares

    def score(self, df: DataFrame) -> DataFrame:
        out = df.withColumn(PREDICTION, F.lit(self.value))
        if self.classes is not None:
            out = out.withColumn(PROBABILITIES, F.array(*[F.lit(float(s)) for s in self.shares]))
        return out


class Constant(Learner):
    """Majority class (ties to the smaller) with class shares as probabilities, or the mean."""

    default_name = "Constant"

    def build(self, df, target, classes):
        if classes is None:
            return ConstantModel(self.name, target, None, df.agg(F.avg(finite(col(target.name)))).first()[0])
        counts = {r["c"]: r["n"] for r in df.groupBy(col(target.name).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(counts.values())
        best = min(counts, key=lambda c: (-counts[c], c))
        return ConstantModel(self.name, target, classes, best, [counts.get(c, 0) / total for c in classes])


def with_softmax(df: DataFrame, scores: Sequence[Column]) -> DataFrame:
    """Add ``probabilities`` from log scores. Each stage is a column of its own, so no expression is repeated."""
    out = df.withColumn("_s", F.array(*scores)).withColumn("_top", F.array_max("_s"))
    out = out.withColumn("_e", F.transform("_s", lambda s: F.exp(s - F.col("_top"))))
    out = out.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return out.withColumn(PROBABILITIES, F.transform("_e", lambda x: x / F.col("_sum"))).drop("_s", "_top", "_e", "_sum")


class NaiveBayesModel(Model):
    """``bins[feature]``: cut points or the ordered values; ``counts[feature][class]``: rows per bin."""

    def __init__(self, name, target, classes, priors, bins, counts):
        super().__init__(name, target, classes)
        self.priors, self.bins, self.counts = priors, bins, counts

    @property
    def index(self) -> dict[str, Column]:
        """The 0-based bin of a row per feature, NULL if missing or unseen."""
        out = {}
        for n, (kind, edges) in self.bins.items():
            if kind == "cuts":
                out[n] = bin_index(finite(col(n)), edges)
            else:
                place = F.array_position(F.array(*[F.lit(v) for v in edges]), col(n).cast("string"))
                out[n] = F.when(place > 0, (place - 1).cast("int"))
        return out

    def with_bins(self, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """The table with one column per feature holding its bin, and those columns."""
        names = {f: f"_bin{i}" for i, f in enumerate(self.bins)}
        return df.withColumns({names[f]: e for f, e in self.index.items()}), {f: F.col(n) for f, n in names.items()}

    def score(self, df: DataFrame) -> DataFrame:
        out, position = self.with_bins(df)
        scores = []
        for c in self.classes:
            total = F.lit(self.priors[c])
            for f, place in position.items():
                cells = self.counts[f][c]
                logs = F.array(*[F.lit(math.log((x + 1) / (sum(cells) + len(cells)))) for x in cells])
                total = total + F.coalesce(F.get(logs, place), F.lit(0.0))
            scores.append(total)
        out = with_softmax(out, scores).drop(*[f"_bin{i}" for i in range(len(self.bins))])
        return out.withColumn(PREDICTION, self.label_of_best(F.col(PROBABILITIES)))


class NaiveBayes(Learner):
    """Independent attributes: class shares times bin shares, one added to every count.

    Continuous attributes are cut into four equal-frequency bins. Fitting is one combined count per (attribute, bin,
    class); scoring is a plain expression. Missing and unseen values add nothing.
    """

    default_name = "Naive Bayes"
    task = "class"

    def build(self, df, target, classes):
        domain = domain_of(df)
        names = [c.name for c in domain.attributes]
        cuts = equal_freq_cuts(df, domain.continuous(), BINS)
        levels = discrete_values(df, domain.discrete())
        found: dict[str, dict[tuple[str, str], int]] = {n: {} for n in names}
        for r in contingency(df, target.name, names, cuts).collect():
            found[r.feature][(r.bin, r.cls)] = r.n
        shares = {r.c: r.n for r in df.groupBy(col(target.name).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(shares.values())
        bins, counts = {}, {}
        for n in names:
            if n in cuts:
                bins[n], labels = ("cuts", cuts[n]), [str(i) for i in range(len(cuts[n]) + 1)]
            else:
                bins[n], labels = ("levels", levels[n]), levels[n]
            counts[n] = {c: [found[n].get((b, c), 0) for b in labels] for c in classes}
        priors = {c: math.log((shares.get(c, 0) + 1) / (total + len(classes))) for c in classes}
        return NaiveBayesModel(self.name, target, classes, priors, bins, counts)


class NearestModel(Model):
    def __init__(self, name, target, classes, design, points, settings):
        super().__init__(name, target, classes)
        self.design, self.points, self.settings = design, points, settings

    def score(self, df: DataFrame) -> DataFrame:
        keyed = df.withColumn("_v", self.design.values)
        queries = keyed.select(F.col("_v").alias("v"), F.lit(-1).alias("label")).distinct()
        votes = vote(self.neighbours(queries), self.classes, self.settings["weights"])
        out = keyed.join(votes.withColumnRenamed("v", "_v").drop("label"), "_v", "left").drop("_v")
        return out.withColumn(PREDICTION, self.label_of_best(F.col(PROBABILITIES)))

    def neighbours(self, queries: DataFrame, exclude_self: bool = False) -> DataFrame:
        s = self.settings
        return nearest(queries, self.points, s["n_neighbors"], metric=s["metric"], p=s["p"], exclude_self=exclude_self)


def vote(near: DataFrame, classes: Sequence[str], weights: str) -> DataFrame:
    """(v, label) with the class shares of the neighbours.

    uniform: every neighbour counts once. distance: by 1 / distance; neighbours at distance 0 outvote all others.
    """
    w = F.col("take").cast("double")
    if weights == "distance":
        exact = F.max((F.col("d") == 0).cast("int")).over(W.partitionBy("v", "label")) == 1
        w = F.when(exact, F.when(F.col("d") == 0, w).otherwise(0.0)).otherwise(w / F.col("d"))
    weighted = near.withColumn("_w", w)
    total = F.sum("_w")
    shares = F.array(*[F.sum(F.when(F.col("nlabel") == i, F.col("_w")).otherwise(0.0)) / total for i in range(len(classes))])
    return weighted.groupBy("v", "label").agg(shares.alias(PROBABILITIES))


class Knn(Learner):
    """k nearest neighbours, exact. euclidean, manhattan, chebyshev or minkowski; uniform or distance weights.

    Ties in distance go by vector, then class; ties in the vote to the smaller class.
    """

    default_name = "kNN"
    task = "class"

    def __init__(self, *, n_neighbors: int = 5, metric: str = "euclidean", weights: str = "uniform", p: float = 3.0, **rest):
        super().__init__(**rest)
        self.settings = {"n_neighbors": n_neighbors, "metric": metric, "weights": weights, "p": p}

    def build(self, df, target, classes):
        design = Design.fit(df)
        points = cut(weighted_points(df, design.values, class_code(target.name, classes)))
        return NearestModel(self.name, target, classes, design, points, self.settings)
