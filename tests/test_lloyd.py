"""k-means for many starts: passes against plain sums, draws, costs not above those of Spark's own k-means."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.operators import lloyd
from tablemine.operators.clusters import kmeans


def blobs(seed=1, n=3000):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 3)) * 8
    x = centres[rng.integers(0, 7, n)] + rng.normal(size=(n, 3))
    return x, rng.integers(1, 4, n).astype(float)


def frame(spark, x, w, parts=4):
    return spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, w)], "v array<double>, w double").repartition(parts)


def cost(x, w, centres):
    return float(w @ ((x[:, None] - centres[None]) ** 2).sum(2).min(1))


@pytest.mark.parametrize("leaf", [512, 16])
def test_a_pass_for_all_starts(spark, leaf, monkeypatch):
    monkeypatch.setattr(lloyd, "LEAF", leaf)
    x, w = blobs()
    leaves = lloyd.Leaves(frame(spark, x, w), 3)
    rng = np.random.default_rng(2)
    starts = {s: x[rng.integers(0, len(x), k)] for s, k in ((0, 7), (3, 2), (5, 1), (6, 40))}
    for s, (sums, mass, total) in leaves.step(starts).items():
        near = ((x[:, None] - starts[s][None]) ** 2).sum(2).argmin(1)
        want = np.array([[*(w[near == i] @ x[near == i]), w[near == i].sum()] for i in range(len(starts[s]))])
        assert np.c_[sums, mass] == pytest.approx(want) and total == pytest.approx(cost(x, w, starts[s]))
    assert leaves.variance() == pytest.approx(np.mean([np.cov(x[:, j], aweights=w, ddof=0) for j in range(3)]))


def test_draws_follow_weight_and_distance(spark):
    x = np.array([[float(i)] for i in range(4)])
    leaves = lloyd.Leaves(frame(spark, x, np.array([1.0, 2, 3, 4])), 1)
    counts = np.zeros(4)
    for c in leaves.draw([np.empty((0, 1))] * 3000, 0, 5, spread=False):
        counts[int(c[0, 0])] += 1
    assert counts / 3000 == pytest.approx([0.1, 0.2, 0.3, 0.4], abs=0.03)
    counts[:] = 0
    for c in leaves.draw([np.array([[0.0]])] * 3000, 1, 5, spread=True):
        counts[int(c[0, 0])] += 1
    assert counts / 3000 == pytest.approx(np.array([0, 2, 12, 36]) / 50, abs=0.03)
    assert all(len(np.unique(c)) == 3 for c in leaves.draw([np.empty((0, 1))] * 5, 0, 5, spread=False, count=3))


def test_cost_is_not_above_the_library(spark):
    x, w = blobs(4, 2000)
    points = frame(spark, x, np.ones(len(x)))
    data = points.select(array_to_vector("v").alias("features")).cache()
    best = min(KMeans(k=5, seed=s, maxIter=300).fit(data).summary.trainingCost for s in range(4))
    got = lloyd.fit(points, 3, k=5, max_iterations=300, n_init=10, init_method="k-means++", seed=42)
    assert cost(x, np.ones(len(x)), got) <= best * 1.0001 and (got == np.array(sorted(got.tolist()))).all()
    again = lloyd.fit(points.repartition(1), 3, k=5, max_iterations=300, n_init=10, init_method="k-means++", seed=42)
    assert again == pytest.approx(got)


def test_fewer_points_than_clusters_and_none(spark):
    df = set_roles(spark.createDataFrame([(1, 0.0, 5.0), (2, 0.0, 5.0), (3, 9.0, None)], "id int, x double, y double"), metas=["id"])
    for method in ("k-means++", "random"):
        annotated, centroids = kmeans(df, k=3, n_init=2, init_method=method)
        assert {r.id: r.Cluster for r in annotated.collect()} == {1: "C1", 2: "C1", 3: "C2"} and centroids.count() == 2
    assert kmeans(df.where(F.lit(False)), k=2, n_init=1)[0].count() == 0
