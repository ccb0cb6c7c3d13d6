"""A table of training runs, and saved models."""

from __future__ import annotations

import json
import time
import uuid
from importlib import import_module

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemine.domain import ColumnSpec
from tablemine.operators.learners.base import Design, Learner, Model, SparkModel, train_metrics
from tablemine.operators.learners.descent import LinearScores
from tablemine.operators.learners.growth import Tree
from tablemine.operators.learners.simple import ConstantModel, NaiveBayesModel
from tablemine.operators.learners.trees import TreesModel

RUN = (
    "run_id string, name string, model_type string, start_ms bigint, end_ms bigint, status string, "
    "params map<string,string>, metrics array<struct<name: string, value: double, step: int>>, "
    "data_rows bigint, data_cols int, tag string, model_path string"
)


def log_run(
    spark: SparkSession, path: str, *, model_type: str, model_name: str, params: dict, metrics: dict[str, float], data_rows: int,
    data_cols: int, tag: str = "", model: Model | None = None, start_ms: int | None = None, status: str = "FINISHED",
) -> str:
    """Append one run (one small row, partitioned by tag) and save its model beside the table. Returns the run id."""
    run_id, end = uuid.uuid4().hex, int(time.time() * 1000)
    model_path = f"{path}-models/{run_id}" if model is not None else None
    if model is not None:
        save_model(spark, model, model_path)
    row = (
        run_id, model_name, model_type, start_ms or end, end, status, {k: str(v) for k, v in params.items() if v is not None},
        [(k, float(v), 0) for k, v in metrics.items()], data_rows, data_cols, tag, model_path,
    )
    spark.createDataFrame([row], RUN).write.mode("append").partitionBy("tag").parquet(path)
    return run_id


def fit_and_log(spark: SparkSession, path: str, learner: Learner, df: DataFrame, *, params: dict, tag: str = "") -> tuple[Model | None, str | None]:
    """Fit, measure on the training table and record the run."""
    start = int(time.time() * 1000)
    model = learner.fit(df)
    if model is None:
        return None, None
    metrics = {r.metric: r.value for r in train_metrics(model, df).collect()}
    run_id = log_run(
        spark, path, model_type=type(learner).__name__, model_name=learner.name, params=params, metrics=metrics, data_rows=df.count(),
        data_cols=len([f for f in df.columns if f != model.target.name]), tag=tag, model=model, start_ms=start,
    )
    return model, run_id


def list_runs(spark: SparkSession, path: str, *, tag: str | None = None) -> DataFrame:
    """Runs, newest first, each metric with its last value; a tag prunes to its partition."""
    runs = spark.read.schema(RUN).parquet(path)
    if tag is not None:
        runs = runs.where(F.col("tag") == tag)
    last = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform("metrics", lambda m: m["name"])),
            lambda n: F.struct(n, F.element_at(F.filter("metrics", lambda m: m["name"] == n), -1)["value"]),
        )
    )
    return runs.withColumn("metrics", last).orderBy(F.desc("start_ms"), F.desc("end_ms"), "run_id")


def get_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return list_runs(spark, path).where(F.col("run_id") == run_id)


def load_model(spark: SparkSession, path: str, run_id: str) -> Model:
    row = get_run(spark, path, run_id).select("model_path").first()
    if row is None or row.model_path is None:
        raise KeyError(f"run {run_id} has no model")
    return restore_model(spark, row.model_path)


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Parameters as one JSON row; a Spark estimator's model in Spark's own format beside it."""
    state = {
        "kind": type(model).__name__, "name": model.name, "classes": model.classes,
        "target": [model.target.name, model.target.var_type, model.target.role, list(model.target.values)],
    }
    if model.prepare is not None:
        raise ValueError("a model with a preprocessor cannot be saved; prepare the table first")
    if type(model) is SparkModel:
        model.inner.write().overwrite().save(f"{path}/inner")
        state |= {"parts": model.design.parts, "class": f"{type(model.inner).__module__}.{type(model.inner).__name__}"}
    elif isinstance(model, TreesModel):
        # a row per tree, so that a deep forest is no single text
        trees = [(i, *([int(x) for x in a] for a in (t.feature, t.bin, t.left)), t.stats.tolist(), v.tolist()) for i, (t, v) in enumerate(zip(model.trees, model.values))]
        value = "array<double>" if model.classes is not None else "double"
        schema = f"tree int, feature array<int>, bin array<int>, left array<int>, stats array<array<double>>, value array<{value}>"
        spark.createDataFrame(trees, schema).write.mode("overwrite").parquet(f"{path}/trees")
        state |= {"parts": model.design.parts, "cuts": [c.tolist() for c in model.cuts], "weights": model.weights}
    elif isinstance(model, ConstantModel):
        state |= {"value": model.value, "shares": model.shares}
    elif isinstance(model, NaiveBayesModel):
        state |= {"priors": model.priors, "bins": model.bins, "counts": model.counts}
    elif isinstance(model, LinearScores):
        state |= {"parts": model.design.parts, "weights": model.weights.tolist(), "bias": model.bias.tolist()}
    else:
        raise ValueError(f"{type(model).__name__} cannot be saved")
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


def restore_model(spark: SparkSession, path: str) -> Model:
    s = json.loads(spark.read.parquet(f"{path}/state").first().state)
    name, var_type, role, values = s["target"]
    head = (s["name"], ColumnSpec(name, var_type, role, tuple(values)), s["classes"])
    design = Design([tuple(p) for p in s["parts"]]) if "parts" in s else None
    if s["kind"] == "SparkModel":
        module, cls = s["class"].rsplit(".", 1)
        if not module.startswith("pyspark.ml."):
            raise ValueError(f"unexpected model class {s['class']}")
        model = SparkModel(*head, design, getattr(import_module(module), cls).load(f"{path}/inner"))
    elif s["kind"] == "TreesModel":
        rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        trees = [Tree(np.array(r.feature, np.int32), np.array(r.bin, np.int32), np.array(r.left, np.int32), np.array(r.stats)) for r in rows]
        model = TreesModel(*head, design, [np.array(c) for c in s["cuts"]], trees, [np.array(r.value) for r in rows], s["weights"])
    elif s["kind"] == "ConstantModel":
        model = ConstantModel(*head, s["value"], s["shares"])
    elif s["kind"] == "NaiveBayesModel":
        model = NaiveBayesModel(*head, s["priors"], {k: tuple(v) for k, v in s["bins"].items()}, s["counts"])
    else:
        model = LinearScores(*head, design, np.array(s["weights"]), np.array(s["bias"]))
    model.spark = spark
    return model
