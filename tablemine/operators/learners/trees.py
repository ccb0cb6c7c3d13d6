"""Decision trees, random forests, AdaBoost, tree structure."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.domain import col, finite
from tablemine.operators.learners.base import PREDICTION, PROBABILITIES, Design, Learner, Model, class_code
from tablemine.operators.learners.growth import Binned, Paths, Rule, Tree, binned, grow, read_rows, to_bins


class TreesModel(Model):
    """Trees over binned attributes. For classes the values of the leaves reached add up to the shares of the classes; for
    numbers they add up to the prediction, or with ``weights`` their weighted median is it."""

    def __init__(self, name, target, classes, design: Design, cuts: Sequence[np.ndarray], trees: Sequence[Tree], values: Sequence[np.ndarray],
                 weights: Sequence[float] | None = None):
        super().__init__(name, target, classes)
        self.design, self.cuts, self.trees, self.values, self.weights = design, list(cuts), list(trees), list(values), weights

    def score(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast((self.cuts, [(t.feature, t.bin, t.left) for t in self.trees], self.values, self.weights))
        k = len(self.classes) if self.classes is not None else 1

        def reached(x: pd.Series) -> np.ndarray:
            cuts, trees, values, weights = sent.value
            bins, place = distinct_rows(binned(np.stack(x.to_numpy()), cuts))
            found = [v[Tree(*t, None).leaf_of(bins)] for t, v in zip(trees, values)]
            return (sum(found) if weights is None else weighted_median(np.stack(found, 1), np.array(weights)))[place]

        if self.classes is None:

            @F.pandas_udf("double")
            def number(x: pd.Series) -> pd.Series:
                return pd.Series(reached(x) if len(x) else [], dtype="float64")

            return df.withColumn(PREDICTION, number(self.design.values))

        @F.pandas_udf(", ".join(f"p{i} double" for i in range(k)))
        def shares(x: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(reached(x) if len(x) else np.empty((0, k)), columns=[f"p{i}" for i in range(k)])

        out = df.withColumn("_shares", shares(self.design.values))
        out = out.withColumn(PROBABILITIES, F.array(*[F.col(f"_shares.p{i}") for i in range(k)])).drop("_shares")
        return out.withColumn(PREDICTION, self.label_of_best(F.col(PROBABILITIES)))


def distinct_rows(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray | slice]:
    """The distinct rows of ``bins``, and where each row is among them; all of them if a row takes over eight bytes."""
    if not 0 < bins.shape[1] <= 8:
        return bins, slice(None)
    key = np.zeros((len(bins), 8), np.uint8)
    key[:, : bins.shape[1]] = bins
    _, first, place = np.unique(key.view(np.uint64).ravel(), return_index=True, return_inverse=True)
    return bins[first], place


def weighted_median(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The value of each row at which half of the weight is reached, in ascending order."""
    order = values.argsort(1, kind="stable")
    upto = weights[order].cumsum(1)
    at = (upto >= weights.sum() / 2).argmax(1)
    return np.take_along_axis(values, order[np.arange(len(values)), at][:, None], 1)[:, 0]


def class_shares(tree: Tree) -> np.ndarray:
    """(nodes, classes): the shares of the classes in each node; those of the whole table in a node without rows."""
    w = tree.stats[:, :-1]
    total = w.sum(1, keepdims=True)
    root = w[0] / total[0] if total[0] > 0 else np.full(w.shape[1], 1 / max(w.shape[1], 1))
    return np.where(total > 0, w / np.where(total > 0, total, 1), root)


def means(tree: Tree) -> np.ndarray:
    return np.divide(tree.stats[:, 0], tree.stats[:, 1], out=np.zeros(len(tree.stats)), where=tree.stats[:, 1] > 0)


def _prepared(df: DataFrame, target, classes, design: Design) -> tuple[Binned, float]:
    """The binned table, and what was taken off the numbers: their mean, so that sums of squares stay exact."""
    label = class_code(target.name, classes) if classes is not None else finite(col(target.name))
    data = df.select(design.values.alias("features"), label.alias("label"))
    offset = 0.0 if classes is not None else float(data.agg(F.avg("label")).first()[0] or 0.0)
    return to_bins(data.withColumn("label", F.col("label") - F.lit(offset)) if offset else data, len(design.parts)), offset


def _averaged(name, target, classes, design, data: Binned, trees: list[Tree], offset: float) -> TreesModel:
    n = len(trees)
    values = [class_shares(t) / n if classes is not None else (means(t) + offset) / n for t in trees]
    return TreesModel(name, target, classes, design, data.cuts, trees, values)


class DecisionTree(Learner):
    """One tree for classes or numbers. A node of ``min_samples_split`` rows or more is split if both sides keep
    ``min_samples_leaf``; splits make Gini impurity or variance smallest."""

    default_name = "Tree"

    def __init__(self, *, max_depth: int | None = 5, min_samples_split: int = 5, min_samples_leaf: int = 2, seed: int = 42, **rest):
        super().__init__(**rest)
        self.max_depth, self.min_samples_split, self.min_samples_leaf, self.seed = max_depth, min_samples_split, min_samples_leaf, seed

    def build(self, df, target, classes):
        design = Design.fit(df)
        data, offset = _prepared(df, target, classes, design)
        width = len(design.parts)
        rule = Rule(len(classes or ()), width, width, self.max_depth, self.min_samples_split, self.min_samples_leaf)
        return _averaged(self.name, target, classes, design, data, grow(data, rule, seed=self.seed), offset)


class RandomForest(Learner):
    """Trees on resampled rows for classes or numbers; every node looks at a share of the attributes drawn for it, and at the
    others if none of those splits it. Depth has no limit unless ``max_depth`` sets one."""

    default_name = "Random Forest"

    def __init__(
        self, *, n_estimators: int = 10, max_depth: int | None = None, max_features: float = 0.5, min_samples_split: int = 5,
        seed: int = 42, **rest,
    ):
        super().__init__(**rest)
        self.n_estimators, self.max_depth, self.max_features, self.seed = n_estimators, max_depth, max_features, seed
        self.min_samples_split = min_samples_split

    def build(self, df, target, classes):
        design = Design.fit(df)
        data, offset = _prepared(df, target, classes, design)
        width = len(design.parts)
        rule = Rule(len(classes or ()), width, max(1, round(width * self.max_features)), self.max_depth, self.min_samples_split)
        trees = grow(data, rule, trees=self.n_estimators, seed=self.seed, resample=True)
        return _averaged(self.name, target, classes, design, data, trees, offset)


class AdaBoost(Learner):
    """Boosted trees: SAMME over stumps for classes (Hastie et al. 2009), AdaBoost.R2 with linear loss over trees of depth 3
    for numbers (Drucker 1997).

    The table is never rewritten: a row's weight is computed from the trees so far wherever the row is read, by lookups for
    trees of so few nodes. A round for classes is one histogram pass, which gives the stump and, by the weights in its leaves,
    its error; rows of equal bins and class are one row with their number.
    """

    default_name = "AdaBoost"

    def __init__(self, *, n_estimators: int = 50, learning_rate: float = 1.0, seed: int = 42, **rest):
        super().__init__(**rest)
        self.n_estimators, self.learning_rate, self.seed = n_estimators, learning_rate, seed

    def build(self, df, target, classes):
        design = Design.fit(df)
        data, offset = _prepared(df, target, classes, design)
        if classes is not None:
            data = data.combined()
            trees, weights = self._classes(data, classes, len(design.parts))
            total = sum(weights)
            values = [np.eye(len(classes))[t.stats[:, :-1].argmax(1)] * (w / total) for t, w in zip(trees, weights)]
            return TreesModel(self.name, target, classes, design, data.cuts, trees, values)
        trees, weights = self._numbers(data, len(design.parts))
        return TreesModel(self.name, target, None, design, data.cuts, trees, [means(t) + offset for t in trees], weights)

    def _classes(self, data: Binned, classes: list[str], width: int) -> tuple[list[Tree], list[float]]:
        rule = Rule(len(classes), width, width, max_depth=1)
        trees: list[Tree] = []
        alphas: list[float] = []
        for _ in range(self.n_estimators):
            # A stump misses a class on one side of a cut: all past ones are a table per attribute, and a pass costs the same in any round.
            missed, whole = {}, sum(alphas)
            for t, alpha in zip(trees, alphas):
                vote, f = t.stats[:, :-1].argmax(1), int(t.feature[0])
                side = vote[np.where(np.arange(256) > t.bin[0], t.left[0] + 1, t.left[0]) if f >= 0 else np.zeros(256, int)]
                table = missed.setdefault(max(f, 0), np.zeros((256, len(classes))))
                table += alpha * (side[:, None] != np.arange(len(classes)))

            def weigh(bins: np.ndarray, label: np.ndarray, missed=missed, whole=whole) -> np.ndarray:
                total, kind = np.full(len(label), -whole), label.astype(np.int64)  # one factor for all rows keeps it in range
                for f, table in missed.items():
                    total += table.ravel()[bins[:, f] * np.int64(table.shape[1]) + kind]
                return np.exp(total)

            (tree,) = grow(data, rule, seed=self.seed, weigh=weigh, deal=0)
            w = tree.stats[tree.left < 0, :-1]
            error = 1 - w.max(1).sum() / w.sum()
            if error >= 1 - 1 / len(classes):
                if not trees:
                    return [tree], [1.0]
                break
            trees.append(tree)
            alphas.append(self.learning_rate * (math.log((1 - error) / max(error, 1e-12)) + math.log(len(classes) - 1)))
            if error <= 1e-12:
                break
        return trees, alphas

    def _numbers(self, data: Binned, width: int) -> tuple[list[Tree], list[float]]:
        rule = Rule(0, width, width, max_depth=3)
        trees: list[Tree] = []
        weights: list[float] = []
        past: list[tuple] = []
        for _ in range(self.n_estimators):
            now = list(past)

            def weigh(bins: np.ndarray, label: np.ndarray, past=now) -> np.ndarray:
                total = np.zeros(len(label))
                for paths, value, factor, worst in past:
                    miss = np.abs(paths.values(bins, value) - label)
                    miss /= -worst
                    miss += 1
                    miss *= factor
                    total += miss
                return np.exp(total)

            (tree,) = grow(data, rule, seed=self.seed, weigh=weigh)
            worst, loss = self._loss(data, tree, weigh)
            if not worst:
                return [*trees, tree], [*weights, 1.0]
            error = loss / worst
            if error >= 0.5:
                break
            beta = max(error / (1 - error), 1e-12)
            trees.append(tree)
            weights.append(self.learning_rate * math.log(1 / beta))
            past.append((Paths(tree), means(tree), math.log(beta) * self.learning_rate, worst))
        return (trees, weights) if trees else ([tree], [1.0])

    @staticmethod
    def _loss(data: Binned, tree: Tree, weigh) -> tuple[float, float]:
        """(largest miss, weighted mean miss) of a tree: one pass, a row of sums per task."""
        paths, width, value = Paths(tree), len(data.cuts), means(tree)

        def each(batches):
            worst = loss = mass = 0.0
            for b in batches:
                _, label, weight, bins = read_rows(b, width, weigh)
                miss = np.abs(paths.values(bins, value) - label)
                worst, loss, mass = max(worst, float(miss.max(initial=0))), loss + float(weight @ miss), mass + float(weight.sum())
            yield pa.RecordBatch.from_arrays([pa.array([worst]), pa.array([loss]), pa.array([mass])], ["worst", "loss", "mass"])

        r = data.table.mapInArrow(each, "worst double, loss double, mass double").agg(F.max("worst"), F.sum("loss"), F.sum("mass")).first()
        return r[0] or 0.0, (r[1] or 0.0) / (r[2] or 1.0)


def tree_structure(model: TreesModel, *, max_depth: int = 100) -> DataFrame:
    """tree, id, parent, depth, name, condition, samples, counts, majority, impurity of the nodes of a tree or of a forest's trees.

    ids and parents count within one tree, a single tree is tree 0. ``condition`` is ``feature <= threshold`` and the left child
    meets it; leaves and nodes at ``max_depth`` have none. ``samples`` are the rows that the tree took, repeats counted.
    """
    names, rows = model.design.feature_names, []
    for number, t in enumerate(model.trees):
        parent = np.full(len(t.left), -1, np.int64)
        inner = np.flatnonzero(t.left >= 0)
        parent[t.left[inner]], parent[t.left[inner] + 1] = inner, inner
        depth, level, at = np.zeros(len(t.left), np.int64), 0, np.array([0])
        while len(at):
            depth[at] = level
            children = t.left[at][t.left[at] >= 0]
            at, level = np.r_[children, children + 1], level + 1
        for n in np.flatnonzero(depth <= max_depth).tolist():
            s = t.stats[n]
            if model.classes is not None:
                total = s[:-1].sum()
                counts, impurity = [float(x) for x in s[:-1]], 1 - float((s[:-1] ** 2).sum() / total**2) if total else 0.0
                majority = model.classes[int(s[:-1].argmax())]
            else:
                mean = float(model.values[number][n] * (1 if model.weights else len(model.trees)))
                counts, majority = [mean], f"Value: {mean:.3f}"
                impurity = max(0.0, float(s[2] / s[1] - (s[0] / s[1]) ** 2)) if s[1] else 0.0
            condition = None
            if t.left[n] >= 0 and depth[n] < max_depth:
                condition = f"{names[t.feature[n]]} <= {model.cuts[t.feature[n]][t.bin[n]]:.3f}"
            rows.append((number, n, int(parent[n]) if n else None, int(depth[n]), f"Node {n}", condition, int(s[-1]), counts, majority, impurity))
    return model.spark.createDataFrame(
        rows,
        "tree int, id int, parent int, depth int, name string, condition string, samples bigint, counts array<double>, majority string, impurity double",
    )
