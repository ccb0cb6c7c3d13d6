"""Support vector machines over lifted features against Spark's solver on the lifted table."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.operators.learners import Svm
from tablemine.operators.learners.linear import lifted_blocks


@pytest.fixture(scope="module")
def rings(spark):
    rows = [(i, (i * 37 % 101) / 50 - 1, (i * 53 % 89) / 44 - 1) for i in range(600)] * 3
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("kind", F.when(F.col("a") ** 2 + F.col("b") ** 2 + F.col("a") / 3 < 0.6, "in").otherwise("out"))
    return set_roles(df.repartition(4), discrete=["kind"], target="kind", metas=["id"])


@pytest.mark.parametrize("settings", [{"kernel": "rbf", "components": 40}, {"kernel": "poly", "degree": 3}], ids=lambda s: s["kernel"])
def test_steps_are_those_of_sparks_solver(rings, settings):
    model = Svm(max_iter=25, **settings).fit(rings)
    lift, planes = model.lift, model.planes
    scale = float(np.sqrt(2 / 40)) if settings["kernel"] == "rbf" else 1.0

    rows = rings.select("a", "b", (F.col("kind") == "out").cast("double")).collect()
    made = [[float(v) * scale for v in next(lifted_blocks(lift, planes.shape[1], np.array([[r.a], [r.b]])))[1][:, 0]] for r in rows]
    data = rings.sparkSession.createDataFrame([(z, r[2]) for z, r in zip(made, rows)], "z array<double>, label double").select(array_to_vector("z").alias("features"), "label")
    want = LinearSVC(maxIter=25, regParam=1 / 1800, standardization=False, tol=1e-6).fit(data)
    assert planes[0] == pytest.approx(want.coefficients.toArray() * scale, rel=1e-6, abs=1e-8) and model.offsets[0] == pytest.approx(want.intercept, rel=1e-6)


@pytest.mark.parametrize("kernel", ["rbf", "poly"])
def test_no_table_of_lifted_features(rings, kernel, monkeypatch):
    """Nothing is kept: neither what the learner caches nor what a Spark estimator would."""
    from tablemine.operators.learners import linear

    def refused(*args):
        raise AssertionError("lifted features were cached")

    monkeypatch.setattr(linear, "fit_cached", refused)
    model = Svm(kernel=kernel, max_iter=5).fit(rings)
    assert model.transform(rings).where("prediction = kind").count() > 1200
