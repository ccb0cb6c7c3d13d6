"""What all learners share: the validity rule, the design matrix, class codes, the model interface."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemine.domain import CONTINUOUS, DISCRETE, ColumnSpec, col, discrete_values, domain_of, finite
from tablemine.operators.prep import Preprocessor

#: Names of the columns a model adds.
PREDICTION, PROBABILITIES = "prediction", "probabilities"


def learner_contract(df: DataFrame) -> DataFrame:
    """One row: rows, attributes, classes (distinct class values up to 2), valid, reason. One aggregate pass."""
    domain = domain_of(df)
    target = domain.class_var
    spread = F.min(col(target.name)) != F.max(col(target.name)) if target else F.lit(False)
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(spread, F.lit(False)).alias("varied"))
    usable = [c for c in domain.attributes if c.var_type in (CONTINUOUS, DISCRETE)]
    reason = (
        F.when(F.col("rows") == 0, "no rows")
        .when(F.lit(target is None), "no class")
        .when(F.lit(not usable), "no attributes")
        .when(~F.col("varied"), "fewer than two class values")
    )
    return facts.select("rows", F.lit(len(usable)).alias("attributes"), reason.isNull().alias("valid"), reason.alias("reason"))


@dataclass
class Design:
    """Attributes as one numeric vector: continuous with the column mean for gaps, discrete as 0/1 per value.

    ``parts`` lists the entries of the vector as (column, value or None, mean or None).
    """

    parts: list[tuple[str, str | None, float | None]]

    @classmethod
    def fit(cls, df: DataFrame) -> Design:
        domain = domain_of(df)
        numeric = domain.continuous()
        row = df.agg(F.count(F.lit(1)), *[F.avg(finite(col(n))) for n in numeric]).first()
        means = dict(zip(numeric, row[1:]))
        levels = discrete_values(df, domain.discrete())
        parts: list[tuple[str, str | None, float | None]] = []
        for c in domain.attributes:
            if c.name in means:
                parts.append((c.name, None, means[c.name] or 0.0))
            for v in levels.get(c.name, ()):
                parts.append((c.name, v, None))
        return cls(parts)

    @property
    def feature_names(self) -> list[str]:
        return [n if v is None else f"{n}={v}" for n, v, _ in self.parts]

    @property
    def values(self) -> Column:
        def entry(name: str, value: str | None, mean: float | None) -> Column:
            if value is None:
                return F.coalesce(finite(col(name)), F.lit(float(mean)))
            return F.coalesce((col(name).cast("string") == value).cast("double"), F.lit(0.0))

        return F.array(*[entry(*p) for p in self.parts]) if self.parts else F.array().cast("array<double>")

    @property
    def vector(self) -> Column:
        return array_to_vector(self.values)


class Model:
    """A fitted learner. ``transform`` adds ``prediction`` and, for classes, ``probabilities`` in class order."""

    def __init__(self, name: str, target: ColumnSpec, classes: Sequence[str] | None, prepare: Callable[[DataFrame], DataFrame] | None = None):
        self.name, self.target, self.prepare = name, target, prepare
        self.classes = list(classes) if classes is not None else None

    def transform(self, df: DataFrame) -> DataFrame:
        """Score rows. With a preprocessor the attributes come out as the preprocessor left them."""
        return self.score(self.prepare(df) if self.prepare else df)

    def score(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def label(self, index: Column) -> Column:
        """Class name of a 0-based index."""
        return F.get(F.array(*[F.lit(c) for c in self.classes]), index.cast("int"))

    def label_of_best(self, probabilities: Column) -> Column:
        """Class with the highest probability, ties to the first."""
        return self.label(F.array_position(probabilities, F.array_max(probabilities)) - 1)


class Learner:
    """Settings plus ``fit``. ``fit`` gives None when the table breaks the learner contract."""

    default_name = "learner"
    #: "class", "number" or "both"
    task = "both"

    def __init__(self, *, name: str | None = None, preprocessor: Preprocessor | None = None):
        self.name, self.preprocessor = name or self.default_name, preprocessor

    def fit(self, df: DataFrame) -> Model | None:
        if not learner_contract(df).first().valid:
            return None
        return self.train(df)

    def train(self, df: DataFrame) -> Model:
        prepare = self.preprocessor.fit(df) if self.preprocessor else None
        ready = prepare(df) if prepare else df
        target = domain_of(ready).class_var
        kind = "class" if target.var_type == DISCRETE else "number"
        if self.task not in ("both", kind):
            raise ValueError(f"{self.name} cannot predict a {target.var_type} column")
        known = ready.where(col(target.name).isNotNull())
        classes = discrete_values(known, [target.name])[target.name] if kind == "class" else None
        model = self.build(known, target, classes)
        model.prepare, model.spark = prepare, df.sparkSession
        return model

    def build(self, df: DataFrame, target: ColumnSpec, classes: list[str] | None) -> Model:
        raise NotImplementedError


def class_code(target: str, classes: Sequence[str]) -> Column:
    """0-based code of the class column."""
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), col(target).cast("string")) - 1).cast("double")


def training_columns(df: DataFrame, target: ColumnSpec, classes: list[str] | None, design: Design) -> DataFrame:
    """features and label only: what a Spark estimator reads."""
    label = class_code(target.name, classes) if classes is not None else finite(col(target.name))
    return df.select(design.vector.alias("features"), label.alias("label"))


class SparkModel(Model):
    """A fitted Spark estimator behind a design matrix."""

    def __init__(self, name, target, classes, design: Design, inner, output: Column | None = None):
        super().__init__(name, target, classes)
        self.design, self.inner, self.output = design, inner, output

    def features(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_features", self.design.vector)

    def score(self, df: DataFrame) -> DataFrame:
        inner = self.inner.copy()
        inner.setFeaturesCol("_features").setPredictionCol("_prediction")
        if self.classes is None:
            return inner.transform(self.features(df)).withColumn(PREDICTION, F.col("_prediction")).drop("_features", "_prediction")
        has_probability = inner.hasParam("probabilityCol")
        if has_probability:
            inner.setProbabilityCol("_probability")
        if inner.hasParam("rawPredictionCol"):
            inner.setRawPredictionCol("_raw")
        scored = inner.transform(self.features(df))
        if has_probability:
            # A label that no row carries past the last known one has no place in the vector.
            probability = F.slice(vector_to_array("_probability"), 1, len(self.classes))
        else:
            probability = F.array(*[(F.col("_prediction") == i).cast("double") for i in range(len(self.classes))])
        out = scored.withColumn(PREDICTION, self.label(F.col("_prediction"))).withColumn(PROBABILITIES, probability)
        return out.drop("_features", "_prediction", "_probability", "_raw")


def unique_name(taken: Sequence[str], wanted: str) -> str:
    """``wanted``, or ``wanted (1)``, ``wanted (2)``... if taken."""
    if wanted not in taken:
        return wanted
    i = 1
    while f"{wanted} ({i})" in taken:
        i += 1
    return f"{wanted} ({i})"


def train_metrics(model: Model, df: DataFrame) -> DataFrame:
    """metric, value on a table, 4 decimals: train_CA, or train_RMSE and train_R2 (0 without variance)."""
    scored = model.transform(df)
    y, p = col(model.target.name), F.col(PREDICTION)
    if model.classes is not None:
        ca = scored.agg(F.avg((y.cast("string") == p).cast("double")).alias("ca"))
        return ca.select(F.lit("train_CA").alias("metric"), F.round(F.coalesce("ca", F.lit(0.0)), 4).alias("value"))
    y = finite(y)
    a = scored.agg(F.sum((y - p) * (y - p)).alias("res"), F.var_pop(y).alias("v"), F.count(y).alias("n"))
    r2 = F.when(F.col("v") > 0, 1 - F.col("res") / (F.col("v") * F.col("n"))).otherwise(0.0)
    rows = F.array(
        F.struct(F.lit("train_RMSE").alias("metric"), F.round(F.sqrt(F.col("res") / F.col("n")), 4).alias("value")),
        F.struct(F.lit("train_R2").alias("metric"), F.round(r2, 4).alias("value")),
    )
    return a.select(F.inline(rows))
