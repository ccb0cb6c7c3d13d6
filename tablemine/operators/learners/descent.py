"""Stochastic gradient learners: linear models and neural networks trained inside shards of the table.

Equal rows are combined first; a hash of the row then deals it to a shard of about ``SHARD`` rows, so the shards, and with
them the model, depend on the rows alone and not on how they are partitioned. One Spark job per round: from the same
parameters every shard takes minibatch steps over its rows, and its parameters count as often as it has rows; tasks sum them
up (Zinkevich et al. 2010). The shards are written once as plain bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.operators.learners.base import (
    PREDICTION, PROBABILITIES, Design, Learner, Model, SparkModel, training_columns,
)
from tablemine.operators.learners.linear import fit_cached
from tablemine.operators.learners.quasi_newton import SummedGradient, minimise, summed
from tablemine.session import scratch_path, spread

#: Rows per gradient step, and passes over a shard in one round.
MINIBATCH, PASSES = 128, 5
#: Different rows in a shard on average.
SHARD = 4096

Params = list[np.ndarray]


def sharded(data: DataFrame) -> DataFrame:
    """cells: one array of (hash, x, y, w) per shard, in order; w counts the equal rows.

    The hash is that of the raw features as floats, which the last digits of a mean or deviation can't change.
    """
    rows = data.groupBy("raw", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = rows.withColumn("h", F.xxhash64(F.col("raw").cast("array<float>"), "y"))
    shards = F.lit(max(1, -(-rows.count() // SHARD)))
    cells = F.sort_array(F.collect_list(F.struct("h", "x", "y", "w")))
    return rows.groupBy(F.pmod("h", shards).alias("shard")).agg(cells.alias("cells")).select("cells")


def average_rounds(
    data: DataFrame, start: Params, train: Callable[[Params, np.ndarray, np.ndarray, np.ndarray, int], tuple[Params, float]], *, rounds: int, tol: float
) -> Params:
    """Repeat rounds over ``data(raw, x array, y double)`` until the mean loss improves by less than ``tol`` three times.

    ``train(params, x, y, w, round)`` returns the parameters after one shard and the loss summed over its rows.
    """
    width = len(data.select("x").first()[0])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cells = b.column(0)[i].values
                x, y, w = (np.asarray(c, float) for c in (cells.field("x").flatten(), cells.field("y"), cells.field("w")))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y, w)], ["x", "y", "w"])

    schema = "x binary, y binary, w binary"
    path = scratch_path(data.sparkSession, "shards")
    spread(sharded(data).mapInArrow(pack, schema)).write.parquet(path)
    return _rounds(data.sparkSession.read.schema(schema).parquet(path), width, start, train, rounds, tol)


def _rounds(shards: DataFrame, width: int, start: Params, train, rounds: int, tol: float) -> Params:
    shapes = [p.shape for p in start]
    params, best, stale = [p.copy() for p in start], np.inf, 0
    size, tasks = sum(p.size for p in start) + 2, shards.rdd.getNumPartitions()
    for r in range(rounds):

        def local(batches: Iterator[pa.RecordBatch], now=params, r=r) -> np.ndarray:
            flat = np.zeros(size)
            for batch in batches:
                for i in range(batch.num_rows):
                    x, y, w = (np.frombuffer(batch.column(c)[i].as_buffer()) for c in range(3))
                    mine, loss = train([p.copy() for p in now], x.reshape(-1, width), y, w, r)
                    flat += np.concatenate([*(p.ravel() * w.sum() for p in mine), [loss, w.sum()]])
            return flat

        flat = summed(shards, tasks, size, local)
        if not flat[-1]:
            return params
        flat = flat / flat[-1]
        params, at = [], 0
        for shape in shapes:
            end = at + int(np.prod(shape))
            params.append(flat[at:end].reshape(shape))
            at = end
        stale = stale + 1 if flat[-2] > best - tol else 0
        best = min(best, flat[-2])
        if stale >= 3:
            break
    return params


def standardised(data: DataFrame, width: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Arrays of features ``raw`` and standardised ``x`` with label y; mean and sd per feature from one aggregate."""
    arrays = data.select(vector_to_array("features").alias("raw"), F.col("label").alias("y"))
    r = arrays.agg(*[f(F.get("raw", F.lit(i))) for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
    mean, sd = np.array(r[0::2], dtype=float), np.array(r[1::2], dtype=float)
    sd = np.where(sd > 0, sd, 1.0)
    scaled = F.array(*[(F.get("raw", F.lit(i)) - F.lit(float(mean[i]))) / F.lit(float(sd[i])) for i in range(width)])
    return arrays.select("raw", scaled.alias("x"), "y"), mean, sd


def _batches(n: int, r: int) -> list[np.ndarray]:
    order = np.random.default_rng(r).permutation(n)
    return [order[i : i + MINIBATCH] for i in range(0, n, MINIBATCH)]


class LinearScores(Model):
    """Linear scores per class (or one number) as plain expressions over the design."""

    def __init__(self, name, target, classes, design, weights: np.ndarray, bias: np.ndarray):
        super().__init__(name, target, classes)
        self.design, self.weights, self.bias = design, weights, bias

    def score(self, df: DataFrame) -> DataFrame:
        def dot(j):
            total = F.lit(float(self.bias[j]))
            for i in range(len(self.design.feature_names)):
                total = total + F.get("_x", F.lit(i)) * F.lit(float(self.weights[i, j]))
            return total

        out = df.withColumn("_x", self.design.values)
        if self.classes is None:
            return out.withColumn(PREDICTION, dot(0)).drop("_x")
        sigmoid = F.transform(F.array(*[dot(j) for j in range(len(self.classes))]), lambda s: 1 / (1 + F.exp(-s)))
        total = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn("_p", sigmoid).withColumn(
            PROBABILITIES, F.when(total > 0, F.transform("_p", lambda x: x / total)).otherwise(F.transform("_p", lambda x: F.lit(1 / len(self.classes))))
        )
        return out.withColumn(PREDICTION, self.label_of_best(F.col(PROBABILITIES))).drop("_x", "_p")


def _margin_gradient(loss: str, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its derivative by the score z for targets y (-1/+1, or numbers for squared_error)."""
    if loss == "squared_error":
        return 0.5 * (z - y) ** 2, z - y
    m = z * y
    if loss == "log_loss":
        return np.logaddexp(0, -m), -y / (1 + np.exp(np.clip(m, -500, 500)))
    if loss == "modified_huber":
        value = np.where(m >= 1, 0.0, np.where(m >= -1, (1 - m) ** 2, -4 * m))
        return value, np.where(m >= 1, 0.0, np.where(m >= -1, -2 * (1 - m) * y, -4 * y))
    return np.maximum(0, 1 - m), np.where(m < 1, -y, 0.0)


class Sgd(Learner):
    """Linear model by averaged stochastic gradient descent over shards, one score per class (one against the rest) or a number.

    Losses hinge, log_loss, modified_huber, squared_error; penalties l2, l1, elasticnet (half and half) of strength
    ``alpha``. Features are standardised inside. ``max_iter`` counts passes; a round makes a few of them.
    """

    default_name = "SGD"

    def __init__(self, *, loss: str = "hinge", penalty: str = "l2", alpha: float = 1e-4, max_iter: int = 1000, tol: float = 1e-4, **rest):
        super().__init__(**rest)
        self.loss, self.penalty, self.alpha, self.max_iter, self.tol = loss, penalty, alpha, max_iter, tol

    def build(self, df, target, classes):
        design = Design.fit(df)
        width, outputs = len(design.feature_names), len(classes) if classes is not None else 1
        data, mean, sd = standardised(training_columns(df, target, classes, design), width)
        loss = "squared_error" if classes is None else self.loss
        shift, spread = 0.0, 1.0
        if classes is None:
            r = data.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
            shift, spread = r.m, r.s or 1.0
        l1 = self.alpha * {"l1": 1.0, "elasticnet": 0.5}.get(self.penalty, 0.0)
        l2 = self.alpha - l1
        signs = classes is not None

        def train(params: Params, x: np.ndarray, y: np.ndarray, count: np.ndarray, r: int) -> tuple[Params, float]:
            w, b = params
            goal = np.where(y[:, None] == np.arange(outputs), 1.0, -1.0) if signs else ((y - shift) / spread)[:, None]
            step = 0.1 / (1 + 0.2 * r)
            for turn in range(PASSES):
                for rows in _batches(len(x), r * PASSES + turn):
                    _, g = _margin_gradient(loss, x[rows] @ w + b, goal[rows])
                    g = g * (count[rows] / count[rows].sum())[:, None]
                    w = w - step * (x[rows].T @ g + l2 * w)
                    w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
                    b = b - step * g.sum(axis=0)
            value, _ = _margin_gradient(loss, x @ w + b, goal)
            return [w, b], float((value * count[:, None]).sum())

        w, b = average_rounds(
            data, [np.zeros((width, outputs)), np.zeros(outputs)], train, rounds=max(1, self.max_iter // PASSES), tol=self.tol
        )
        w = w * spread / sd[:, None]
        b = b * spread + shift - mean @ w
        return LinearScores(self.name, target, classes, design, w, b)


_ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "logistic": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda a: a * (1 - a)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "identity": (lambda z: z, np.ones_like),
}


def _forward(params: Params, x: np.ndarray, activation: str) -> list[np.ndarray]:
    """Activations of every layer; the last one is the raw output."""
    act, layers = _ACTIVATIONS[activation][0], [x]
    for i in range(0, len(params), 2):
        z = layers[-1] @ params[i] + params[i + 1]
        layers.append(z if i == len(params) - 2 else act(z))
    return layers


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class NetworkModel(Model):
    def __init__(self, name, target, classes, design, params, mean, sd, activation, shift, spread):
        super().__init__(name, target, classes)
        self.design, self.params, self.mean, self.sd = design, params, mean, sd
        self.activation, self.shift, self.spread = activation, shift, spread

    def score(self, df: DataFrame) -> DataFrame:
        params, mean, sd, activation = self.params, self.mean, self.sd, self.activation
        many, shift, spread = self.classes is not None, self.shift, self.spread

        @F.pandas_udf("array<double>")
        def output(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            z = _forward(params, (np.stack(v.to_numpy()) - mean) / sd, activation)[-1]
            return pd.Series(list(_softmax(z) if many else z * spread + shift))

        out = df.withColumn("_o", output(self.design.values))
        if not many:
            return out.withColumn(PREDICTION, F.get("_o", F.lit(0))).drop("_o")
        return out.withColumn(PROBABILITIES, F.col("_o")).withColumn(PREDICTION, self.label_of_best(F.col("_o"))).drop("_o")


class NeuralNetwork(Learner):
    """Feed-forward network. ``hidden_layer_sizes`` is text (``"100"``, ``"100,50"``) or numbers.

    lbfgs follows the gradient of the whole table (:mod:`.quasi_newton`); for classes with logistic activation it is that of
    Spark's perceptron. adam and sgd take steps inside the shards; adam's moments are averaged with the parameters and go on
    in the next round. Features are standardised.
    """

    default_name = "Neural Network"

    def __init__(
        self, *, hidden_layer_sizes="100", activation: str = "relu", solver: str = "adam", alpha: float = 1e-4, max_iter: int = 200,
        seed: int = 42, tol: float = 1e-4, **rest,
    ):
        super().__init__(**rest)
        if isinstance(hidden_layer_sizes, str):
            hidden_layer_sizes = [int(p) for p in hidden_layer_sizes.split(",") if p.strip()]
        self.hidden = [hidden_layer_sizes] if isinstance(hidden_layer_sizes, int) else [int(h) for h in hidden_layer_sizes]
        if solver not in ("adam", "sgd", "lbfgs"):
            raise ValueError(f"unknown solver {solver!r}; known: adam, sgd, lbfgs")
        if activation not in _ACTIVATIONS:
            raise ValueError(f"unknown activation {activation!r}; known: {', '.join(_ACTIVATIONS)}")
        self.activation, self.solver, self.alpha, self.max_iter, self.seed, self.tol = activation, solver, alpha, max_iter, seed, tol

    def build(self, df, target, classes):
        design = Design.fit(df)
        width, outputs = len(design.feature_names), len(classes) if classes is not None else 1
        raw = training_columns(df, target, classes, design)
        data, mean, sd = standardised(raw, width)
        if classes is not None and self.activation == "logistic" and self.solver == "lbfgs":
            scaled = data.select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
            net = MultilayerPerceptronClassifier(layers=[width, *self.hidden, outputs], maxIter=self.max_iter, seed=self.seed, solver="l-bfgs")
            inner = fit_cached(net, scaled)
            return ScaledSparkModel(self.name, target, classes, design, inner, mean, sd)
        shift, spread = 0.0, 1.0
        if classes is None:
            r = data.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
            shift, spread = r.m, r.s or 1.0
        sizes = [width, *self.hidden, outputs]
        rng = np.random.default_rng(self.seed)
        start: Params = []
        for a, b in zip(sizes, sizes[1:]):
            bound = np.sqrt(6 / (a + b))
            start += [rng.uniform(-bound, bound, (a, b)), np.zeros(b)]
        activation, alpha, adam, many = self.activation, self.alpha, self.solver != "sgd", classes is not None
        if self.solver == "lbfgs":
            params, self.losses = self._whole(data, start, width, shift, spread, many)
            return NetworkModel(self.name, target, classes, design, params, mean, sd, activation, shift, spread)
        k = len(start)

        def train(state: Params, x: np.ndarray, y: np.ndarray, count: np.ndarray, r: int) -> tuple[Params, float]:
            params, first, second, t = state[:k], state[k : 2 * k], state[2 * k : 3 * k], float(state[-1][0])
            goal = np.eye(outputs)[y.astype(int)] if many else ((y - shift) / spread)[:, None]
            rate = (0.01 if adam else 0.1) / (1 + 0.1 * r)
            for turn in range(PASSES):
                for rows in _batches(len(x), r * PASSES + turn):
                    _, grads = _gradient(params, x[rows], goal[rows], count[rows] / count[rows].sum(), activation, many)
                    grads = [g + alpha / count.sum() * p if i % 2 == 0 else g for i, (g, p) in enumerate(zip(grads, params))]
                    t += 1
                    if adam:
                        first = [0.9 * m + 0.1 * g for m, g in zip(first, grads)]
                        second = [0.999 * s + 0.001 * g * g for s, g in zip(second, grads)]
                        grads = [(m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8) for m, s in zip(first, second)]
                    params = [p - rate * g for p, g in zip(params, grads)]
            return [*params, *first, *second, np.array([t])], _gradient(params, x, goal, count, activation, many)[0]

        state = [*start, *(np.zeros_like(p) for p in start), *(np.zeros_like(p) for p in start), np.zeros(1)]
        params = average_rounds(data, state, train, rounds=max(1, self.max_iter // PASSES), tol=self.tol)[:k]
        return NetworkModel(self.name, target, classes, design, params, mean, sd, activation, shift, spread)

    def _whole(self, data: DataFrame, start: Params, width: int, shift: float, spread: float, many: bool) -> tuple[Params, list[float]]:
        """(parameters, losses on the way) by L-BFGS on the mean loss plus alpha / 2n of the squared weights."""
        shapes, activation, outputs = [p.shape for p in start], self.activation, start[-1].shape[0]

        def each(flat: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
            goal = np.eye(outputs)[y.astype(int)] if many else ((y - shift) / spread)[:, None]
            cost, grads = _gradient(_shaped(flat, shapes), x, goal, w, activation, many)
            return cost, np.concatenate([g.ravel() for g in grads])

        total = SummedGradient(sharded(data), width, each)
        weights = np.concatenate([np.full(p.size, 1.0 if p.ndim == 2 else 0.0) for p in start])

        def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
            cost, gradient = total(flat)
            held = weights * flat
            return (cost + 0.5 * self.alpha * float(held @ held)) / total.rows, (gradient + self.alpha * held) / total.rows

        flat, losses = minimise(loss, np.concatenate([p.ravel() for p in start]), max_iter=self.max_iter, tol=self.tol)
        return _shaped(flat, shapes), losses


def _shaped(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> Params:
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [flat[e - int(np.prod(s)) : e].reshape(s) for e, s in zip(ends, shapes)]


def _gradient(params: Params, x: np.ndarray, goal: np.ndarray, weight: np.ndarray, activation: str, many: bool) -> tuple[float, Params]:
    """(loss, gradient) summed over weighted rows: cross entropy of classes, half the squared error of numbers."""
    derivative = _ACTIVATIONS[activation][1]
    layers = _forward(params, x, activation)
    out = _softmax(layers[-1]) if many else layers[-1]
    if many:
        z = layers[-1] - layers[-1].max(axis=1, keepdims=True)
        cost = (weight * (np.log(np.exp(z).sum(1)) - (z * goal).sum(1))).sum()
    else:
        cost = 0.5 * (weight[:, None] * (out - goal) ** 2).sum()
    error = (out - goal) * weight[:, None]
    grads: Params = [np.empty(0)] * len(params)
    for i in range(len(params) - 2, -1, -2):
        grads[i], grads[i + 1] = layers[i // 2].T @ error, error.sum(axis=0)
        if i:
            error = (error @ params[i].T) * derivative(layers[i // 2])
    return float(cost), grads


class ScaledSparkModel(SparkModel):
    """A Spark model trained on standardised features."""

    def __init__(self, name, target, classes, design, inner, mean, sd):
        super().__init__(name, target, classes, design, inner)
        self.mean, self.sd = mean, sd

    def features(self, df):
        x = self.design.values
        width = len(self.design.feature_names)
        scaled = F.array(*[(F.get(x, F.lit(i)) - F.lit(float(self.mean[i]))) / F.lit(float(self.sd[i])) for i in range(width)])
        return df.withColumn("_features", array_to_vector(scaled))
