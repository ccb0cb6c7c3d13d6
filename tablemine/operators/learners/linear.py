"""Logistic and linear regression, support vector machines, coefficients."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression as SparkLogistic, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression as SparkLinear
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemine.domain import CONTINUOUS, META, STRING, ColumnSpec, col, stamp
from tablemine.operators.learners.base import (
    PREDICTION, PROBABILITIES, Design, Learner, Model, SparkModel, class_code, training_columns,
)
from tablemine.operators.learners.quasi_newton import orthant_steps, summed
from tablemine.session import scratch_path


class LogisticRegression(Learner):
    """Penalised maximum likelihood, C * sum of losses + penalty; l2, l1 or none; optionally balanced classes."""

    default_name = "Logistic Regression"
    task = "class"

    def __init__(self, *, penalty: str = "l2", C: float = 1.0, class_weight: bool = False, max_iter: int = 10000, **rest):
        super().__init__(**rest)
        self.penalty, self.C, self.class_weight, self.max_iter = penalty, C, class_weight, max_iter

    def build(self, df, target, classes):
        design = Design.fit(df)
        data = training_columns(df, target, classes, design)
        counts = {r.label: r["count"] for r in data.groupBy("label").count().collect()}
        n = sum(counts.values())
        # Spark divides the loss by the total weight, so the penalty is divided by C times that weight.
        estimator = SparkLogistic(
            maxIter=self.max_iter, tol=1e-8, standardization=False, family="binomial" if len(classes) == 2 else "multinomial",
            regParam=0.0 if self.penalty == "none" else 1 / (self.C * n), elasticNetParam=1.0 if self.penalty == "l1" else 0.0,
        )
        if self.class_weight:
            weights = F.array(*[F.lit(n / (len(classes) * counts.get(float(i), n))) for i in range(len(classes))])
            data = data.withColumn("weight", F.get(weights, F.col("label").cast("int")))
            estimator = estimator.setWeightCol("weight")
        return SparkModel(self.name, target, classes, design, fit_cached(estimator, data))


def fit_cached(estimator, data: DataFrame):
    """Fit an iterative estimator on a cached copy of its two columns, released afterwards (it spills to disk)."""
    data = data.persist()
    try:
        return estimator.fit(data)
    finally:
        data.unpersist()


class LinearRegression(Learner):
    """Least squares: none, ridge, lasso or elastic_net.

    ridge: |y - Xw|^2 + alpha |w|^2. elastic_net: |y - Xw|^2 / 2n + alpha r |w|_1 + alpha (1 - r) |w|^2 / 2.
    One aggregate builds the normal equations. Spark scales the target by its standard deviation inside, so the
    quadratic part of the penalty is multiplied by it here.
    """

    default_name = "Linear Regression"
    task = "number"

    def __init__(self, *, regularization: str = "none", alpha: float = 1.0, l1_ratio: float = 0.5, fit_intercept: bool = True, **rest):
        super().__init__(**rest)
        self.regularization, self.alpha, self.l1_ratio, self.fit_intercept = regularization, alpha, l1_ratio, fit_intercept

    def build(self, df, target, classes):
        design = Design.fit(df)
        data = training_columns(df, target, None, design)
        s = data.agg(F.stddev_pop("label").alias("sd"), F.count(F.lit(1)).alias("n")).first()
        kind, a, r = self.regularization, self.alpha, self.l1_ratio
        l1, l2 = 0.0, 0.0
        if kind == "ridge":
            l2 = a * s.sd / s.n
        elif kind == "lasso":
            l1 = a
        elif kind == "elastic_net":
            l1, l2 = a * r, a * (1 - r) * s.sd
        total = l1 + l2
        estimator = SparkLinear(
            solver="normal", standardization=False, fitIntercept=self.fit_intercept, regParam=total,
            elasticNetParam=l1 / total if total else 0.0, maxIter=10000, tol=1e-12,
        )
        return SparkModel(self.name, target, None, design, estimator.fit(data))


def coefficients(model: Model) -> DataFrame:
    """name, then one column per class (two classes: only the second; regression: ``coef``): first the intercept,
    then one row per feature. The size is that of the model. Least squares, logistic regression, linear SVM, SGD."""
    spark = model.spark
    names = ["Intercept", *model.design.feature_names]
    columns = ["coef"] if model.classes is None else [model.classes[1]] if len(model.classes) == 2 else model.classes
    if hasattr(model, "weights"):  # one score per class, or one number
        table = [[b, *row] for b, row in zip(model.bias, model.weights.T)][-len(columns):]
    elif isinstance(model, SvmModel):
        if not model.linear:
            raise ValueError("a support vector machine has coefficients only with a linear kernel")
        table = [[p.intercept, *p.coefficients.toArray()] for p in model.parts]
    elif len(columns) == 1:
        table = [[model.inner.intercept, *model.inner.coefficients.toArray()]]
    else:
        table = [[b, *row] for b, row in zip(model.inner.interceptVector.toArray(), model.inner.coefficientMatrix.toArray())]
    rows = [(n, *[float(t[i]) for t in table]) for i, n in enumerate(names)]
    schema = T.StructType([T.StructField("name", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in columns])
    out = spark.createDataFrame(rows, schema)
    return out.select(
        stamp(F.col("name"), ColumnSpec("name", STRING, META)), *[stamp(col(c), ColumnSpec(c, CONTINUOUS)) for c in columns]
    )


class Svm(Learner):
    """Support vector classifier: linear, rbf (random Fourier features, Rahimi and Recht 2007) or poly.

    One linear solver for every kernel; more than two classes are split one against the rest.
    ``gamma`` 0 means 1 / number of features.
    """

    default_name = "SVM"
    task = "class"

    def __init__(
        self, *, C: float = 1.0, kernel: str = "rbf", gamma: float = 0.0, degree: int = 3, max_iter: int = 100,
        components: int = 256, seed: int = 42, **rest,
    ):
        super().__init__(**rest)
        if kernel not in ("linear", "rbf", "poly"):
            raise ValueError(f"unknown kernel {kernel!r}; known: linear, rbf, poly")
        self.C, self.kernel, self.gamma, self.degree, self.max_iter = C, kernel, gamma, degree, max_iter
        self.components, self.seed = components, seed

    def build(self, df, target, classes):
        design = Design.fit(df)
        if self.kernel != "linear":
            return self._lifted(df, target, classes, design)
        data = training_columns(df, target, classes, design)
        n = df.count()
        svc = LinearSVC(maxIter=self.max_iter, regParam=1 / (self.C * n), standardization=False, tol=1e-6)
        inner = fit_cached(svc if len(classes) == 2 else OneVsRest(classifier=svc, parallelism=4), data)
        return SvmModel(self.name, target, classes, design, inner)

    def _lifted(self, df, target, classes, design: Design) -> LiftedSvm:
        """Spark's solver step for step, but lifted features are made where rows are read: as a table they would take
        ``components`` or width^degree / degree! numbers a row. All classes share a pass."""
        width = len(design.feature_names)
        lift, size, scale = self._polynomial(width) if self.kernel == "poly" else self._fourier(width)
        rows = RowChunks(df.select(design.values.alias("x"), class_code(target.name, classes).alias("y")), width)
        mean, sd = rows.moments(lift, size)
        inverse = np.divide(1.0, sd, out=np.zeros(size), where=sd > 0)
        centre, penalty = mean * inverse, 1 / (self.C * rows.rows * scale**2)
        marked = [1] if len(classes) == 2 else range(len(classes))  # the classes that are told from the others
        searches = {c: orthant_steps(size + 1, max_iter=self.max_iter, tol=1e-6) for c in marked}
        places, ends = {c: next(s) for c, s in searches.items()}, {}
        while places:
            at = np.stack([*places.values()])
            planes, bias = at[:, :-1] * inverse, at[:, -1] - at[:, :-1] @ centre
            loss, slopes, shifts = rows.hinge(lift, size, planes, bias, [*places])
            asked = [*places]
            for i, c in enumerate(asked):
                held = planes[i] * inverse
                value = loss[i] / rows.rows + 0.5 * penalty * float(at[i, :-1] @ held)
                slope = (slopes[i] * inverse - centre * shifts[i]) / rows.rows + penalty * held
                try:
                    places[c] = searches[c].send((value, np.r_[slope, shifts[i] / rows.rows]))
                except StopIteration as end:
                    ends[c] = end.value
                    del places[c]
        found = np.stack([ends[c] for c in marked])
        return LiftedSvm(self.name, target, classes, design, lift, found[:, :-1] * inverse, found[:, -1] - found[:, :-1] @ centre)

    def _polynomial(self, width: int) -> tuple[Lift, int, float]:
        """All products of one to ``degree`` features."""
        made = [(-1, j) for j in range(width)]  # a shorter product and the feature that it is multiplied by
        level = range(width)
        for _ in range(self.degree - 1):
            before = len(made)
            made += [(i, j) for i in level for j in range(made[i][1], width)]
            level = range(before, len(made))

        def lift(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
            out[:width] = x
            for at, (i, j) in enumerate(made[width:], width):
                np.multiply(out[i], out[j], out=out[at])
            return out

        return lift, len(made), 1.0

    def _fourier(self, width: int) -> tuple[Lift, int, float]:
        """Cosines; a feature is one of them times the number returned last."""
        gamma = self.gamma or 1 / max(width, 1)
        rng = np.random.default_rng(self.seed)
        w = rng.normal(scale=np.sqrt(2 * gamma), size=(width, self.components)).T / 2
        phase = rng.uniform(0, 2 * np.pi, self.components)[:, None] / 2

        def lift(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
            # cos 2a = (1 - tan(a)^2) / (1 + tan(a)^2): numpy's tangent is vectorised, its cosine is not.
            np.matmul(w, x, out=spare)
            spare += phase
            np.tan(spare, out=spare)
            np.square(spare, out=spare)
            np.subtract(1.0, spare, out=out)
            spare += 1.0
            out /= spare
            return out

        return lift, self.components, float(np.sqrt(2 / self.components))


#: (features, rows) to (lifted features, rows), in the first of two arrays that it may use.
Lift = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def lifted_blocks(lift: Lift, size: int, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, lifted features of them) of ``x``, few enough at a time to stay in cache; the next ones overwrite them."""
    step = max(32, LIFTED // max(size, 1))
    out, spare = np.empty((2, size, step))
    for at in range(0, x.shape[1], step):
        part = x[:, at : at + step]
        if part.shape[1] < step:
            out, spare = np.empty((2, size, part.shape[1]))
        yield slice(at, at + step), lift(part, out, spare)


#: Lifted numbers that are worked on at a time.
LIFTED = 1 << 16


class RowChunks:
    """Rows (x array, y) written once as chunks of ``CHUNK`` rows, feature by feature; equal ones combined if that halves them."""

    CHUNK = 4096

    def __init__(self, data: DataFrame, width: int):
        spark, self.width, size = data.sparkSession, width, self.CHUNK
        facts = data.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("x", "y"), 0.02).alias("kinds")).first()
        alike = 2 * facts.kinds <= facts.n
        data = data.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")) if alike else data.withColumn("w", F.lit(1.0))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, filled = [], 0
            for b in itertools.chain(batches, [None]):
                if b is not None:
                    held.append((np.asarray(b.column(0).flatten()).reshape(-1, width), np.asarray(b.column(1)), np.asarray(b.column(2))))
                    filled += b.num_rows
                while filled >= size or (b is None and filled):
                    x, y, w = (np.concatenate(c) for c in zip(*held))
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x[:size].T, y[:size], w[:size])], ["x", "y", "w"])
                    held, filled = [(x[size:], y[size:], w[size:])], max(0, filled - size)

        schema = "x binary, y binary, w binary"  # numbers one by one would cost more than the work on them
        chunks, path = data.select("x", "y", "w").mapInArrow(pack, schema), scratch_path(spark, "row-chunks")
        if alike or data.rdd.getNumPartitions() < 2 * spark.sparkContext.defaultParallelism:
            chunks = chunks.repartition(2 * spark.sparkContext.defaultParallelism)
        chunks.write.parquet(path)
        self.table = spark.read.schema(schema).parquet(path)
        self.tasks, self.rows = self.table.rdd.getNumPartitions(), facts.n

    def _sum(self, lift: Lift, size: int, outputs: int, each) -> np.ndarray:
        """``each(total, lifted, y, w)`` adds a block of rows to ``total``; the sum over all rows."""
        width = self.width

        def own(parts: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(outputs)
            for b in parts:
                for i in range(b.num_rows):
                    x, y, w = (np.frombuffer(b.column(c)[i].as_buffer()) for c in range(3))
                    for rows, z in lifted_blocks(lift, size, x.reshape(width, -1)):
                        each(total, z, y[rows], w[rows])
            return total

        return summed(self.table, self.tasks, outputs, own)

    def moments(self, lift: Lift, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and sample deviation of each lifted feature; 0 for one of equal values."""
        first = np.frombuffer(bytes(self.table.first().x)).reshape(self.width, -1)[:, :1]
        near = next(lifted_blocks(lift, size, first))[1][:, 0].copy()

        def add(total, z, y, w, near=near):
            total += (z - near[:, None]) @ w

        mean = near + self._sum(lift, size, size, add) / self.rows

        def square(total, z, y, w):
            z -= mean[:, None]
            z *= z
            total += z @ w

        return mean, np.sqrt(self._sum(lift, size, size, square) / max(1, self.rows - 1))

    def hinge(self, lift: Lift, size: int, planes: np.ndarray, bias: np.ndarray, marked: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hinge losses of planes that tell the ``marked`` classes from the others, and their slopes by plane and bias."""
        sent, k = self.table.sparkSession.sparkContext.broadcast((planes, bias[:, None], np.array(marked)[:, None])), len(marked)

        def add(total, z, y, w):
            planes, bias, marked = sent.value
            sign = np.where(y == marked, 1.0, -1.0)
            slack = 1 - sign * (planes @ z + bias)
            push = np.where(slack > 0, -sign * w, 0.0)
            total[:k] += np.maximum(slack, 0.0) @ w
            total[k : 2 * k] += push.sum(1)
            total[2 * k :] += (push @ z.T).ravel()

        total = self._sum(lift, size, k * (size + 2), add)
        sent.unpersist()
        return total[:k], total[2 * k :].reshape(k, size), total[k : 2 * k]


class SvmModel(Model):
    """Class with the largest margin; the share of the vote is 1 for it and 0 for the others."""

    def __init__(self, name, target, classes, design, inner=None):
        super().__init__(name, target, classes)
        self.design, self.linear = design, inner is not None
        self.parts = inner.models if hasattr(inner, "models") else [inner]

    def margins(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_m``, the margin of each part."""
        out, margins = df.withColumn("_features", self.design.vector), []
        for i, part in enumerate(self.parts):
            part = part.copy().setFeaturesCol("_features").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_p{i}")
            out = part.transform(out)
            margins.append(F.get(vector_to_array(F.col(f"_r{i}")), F.lit(1)))
        helpers = [f"{c}{i}" for c in ("_r", "_p") for i in range(len(self.parts))]
        return out.withColumn("_m", F.array(*margins)).drop("_features", *helpers)

    def score(self, df: DataFrame) -> DataFrame:
        out = self.margins(df)
        if len(self.classes) == 2:
            out = out.withColumn("_m", F.array(-F.get("_m", F.lit(0)), F.get("_m", F.lit(0))))
        out = out.withColumn("_best", F.array_position("_m", F.array_max("_m")) - 1)
        flags = F.array(*[(F.col("_best") == i).cast("double") for i in range(len(self.classes))])
        return out.withColumn(PROBABILITIES, flags).withColumn(PREDICTION, self.label(F.col("_best"))).drop("_m", "_best")


class LiftedSvm(SvmModel):
    """Planes over lifted features, which are made row by row where they are scored."""

    def __init__(self, name, target, classes, design, lift: Lift, planes: np.ndarray, bias: np.ndarray):
        super().__init__(name, target, classes, design)
        self.lift, self.planes, self.offsets = lift, planes, bias

    def margins(self, df: DataFrame) -> DataFrame:
        lift, planes, offsets = self.lift, self.planes, self.offsets[:, None]

        @F.pandas_udf("array<double>")
        def margin(x: pd.Series) -> pd.Series:
            blocks = lifted_blocks(lift, planes.shape[1], np.stack(x.to_numpy()).T) if len(x) else ()
            return pd.Series([m for _, z in blocks for m in (planes @ z + offsets).T], dtype=object)

        return df.withColumn("_m", margin(self.design.values))
