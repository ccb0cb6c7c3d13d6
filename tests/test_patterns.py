"""Neighbours, outliers, clusters against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.operators import neighbors
from tablemine.operators.clusters import dbscan, kmeans, spanning_forest
from tablemine.operators.components import connected_components
from tablemine.operators.neighbors import distances, grow_tree, nearest, weighted_points
from tablemine.operators.outliers import outlier_scores, outliers


@pytest.fixture(scope="module")
def cloud():
    """Three blobs, a grid of ties, and one point that makes up a third of the rows."""
    rng = np.random.default_rng(4)
    blobs = [rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (6, 0), (0, 7))]
    ties = np.array([[i % 5, 12 + i // 5] for i in range(25)], dtype=float)
    hot = np.tile([[3.0, 3.0]], (100, 1))
    far = np.array([[30.0, 30.0], [-25.0, 10.0]])
    x = np.vstack([*blobs, ties, hot, far])
    return pd.DataFrame(x, columns=["x", "y"]).assign(id=range(len(x)))


@pytest.fixture
def small_blocks(monkeypatch):
    """Many leaves, several blocks per leaf and many chunks even for a few hundred points."""
    monkeypatch.setattr(neighbors, "BLOCK", 20)
    monkeypatch.setattr(neighbors, "CHUNK", 16)


def brute(points: pd.DataFrame, q, k, metric, own=None):
    """(distance, vector) of the k nearest rows, ties by vector."""
    x = points[["x", "y"]].to_numpy()
    d = distances(np.array([q]), x, metric, 3.0)[0]
    rows = sorted((d[i], tuple(x[i])) for i in range(len(x)) if i != own)
    return rows[:k]


@pytest.mark.parametrize("metric,exclude", [("euclidean", True), ("manhattan", False), ("chebyshev", True), ("minkowski", False)])
def test_nearest_is_exact(spark, cloud, small_blocks, metric, exclude):
    df = spark.createDataFrame(cloud)
    points = weighted_points(df, F.array("x", "y"))
    found = nearest(points.select("v", "label"), points, 7, metric=metric, p=3.0, exclude_self=exclude).toPandas()
    got = {}
    for r in found.sort_values("rank").itertuples():
        got.setdefault(tuple(r.v), []).extend([(r.d, tuple(r.nv))] * r.take)
    for i, (x, y) in enumerate(cloud[["x", "y"]].to_numpy()):
        want = brute(cloud, (x, y), 7, metric, own=i if exclude else None)
        mine = got[(x, y)]
        assert [d for d, _ in mine] == pytest.approx([d for d, _ in want])
        assert [v for _, v in mine] == [v for _, v in want]


def test_few_points_visit_every_leaf(spark, small_blocks):
    df = spark.createDataFrame([(float(i), 0.0) for i in range(45)], "x double, y double")
    points = weighted_points(df, F.array("x", "y"))
    found = nearest(points.select("v", "label"), points, 44, exclude_self=True).groupBy("v").agg(F.sum("take").alias("n"))
    assert {r.n for r in found.collect()} == {44}


def test_tree_covers_space():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(500, 3)), np.zeros((200, 3))])
    tree = grow_tree(x, 16)
    leaf = tree.leaf_of(x)
    assert (x >= tree.low[leaf]).all() and (x <= tree.high[leaf]).all()
    assert len(np.unique(leaf)) >= 8
    near = tree.near(x[:20], np.full(20, 0.5), "euclidean", 2)
    for i in range(20):
        close = np.linalg.norm(x - x[i], axis=1) <= 0.5
        assert set(leaf[close]) <= set(near[i])


def test_lof_flags_the_far_points(spark, cloud, small_blocks):
    df = set_roles(spark.createDataFrame(cloud), metas=["id"])
    scores = outlier_scores(df, method="lof", contamination=0.02, key=["id"]).toPandas()
    assert len(scores) == len(cloud) and set(cloud["id"].tail(2)) <= set(scores.loc[scores["Outlier"] == "yes", "id"])


@pytest.mark.parametrize("method", ["isolation_forest", "covariance"])
def test_other_detectors(spark, method):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(400, 3)), rng.normal(9, 0.1, (8, 3))])
    df = set_roles(spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(len(x)))), metas=["id"])
    inside, outside = outliers(df, method=method, contamination=0.02, key=["id"])
    out = {r.id for r in outside.collect()}
    assert inside.count() + len(out) == 408 and set(range(400, 408)) <= out | set(range(400)) and len(out & set(range(400, 408))) >= 7
    again = {r.id for r in outliers(df.repartition(5), method=method, contamination=0.02, key=["id"])[1].collect()}
    assert again == out


@pytest.mark.parametrize("share", [0.4, 0.45])
def test_covariance_sees_a_cluster_that_misleads_the_median(spark, share):
    rng = np.random.default_rng(5)
    n, far = 1000, int(1000 * share)
    x = np.vstack([rng.normal(size=(n - far, 3)) @ np.array([[1, 0.9, 0], [0, 0.3, 0], [0, 0, 2.0]]), rng.normal((6, -6, 9), 0.5, (far, 3))])
    df = set_roles(spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(n))), metas=["id"])
    got = outlier_scores(df, method="covariance", key=["id"]).toPandas().sort_values("id")["score"].to_numpy()
    assert got[n - far :].min() > 50 and np.median(got[: n - far]) < 10
    again = outlier_scores(df.repartition(7), method="covariance", key=["id"]).toPandas().sort_values("id")["score"].to_numpy()
    assert np.allclose(got, again)


def test_covariance_is_a_fixed_point_of_its_half(spark):
    """The scores are distances from the fit to the rows with the smaller half of the scores, up to one bin of distances."""
    rng = np.random.default_rng(6)
    x = rng.standard_t(3, size=(600, 2))
    df = set_roles(spark.createDataFrame(pd.DataFrame(x, columns=list("ab")).assign(id=range(600))), metas=["id"])
    got = outlier_scores(df, method="covariance", key=["id"]).toPandas().sort_values("id")["score"].to_numpy()
    half = x[np.argsort(got)[:300]]
    dev = x - half.mean(axis=0)
    again = np.einsum("ij,jk,ik->i", dev, np.linalg.inv(np.cov(half.T, bias=True)), dev)
    assert np.corrcoef(got, again)[0, 1] > 0.999


def test_covariance_with_few_rows(spark):
    df = set_roles(spark.createDataFrame([(1, 2.0, None), (2, 2.0, 1.0), (3, None, 1.0)], "id long, a double, b double"), metas=["id"])
    for n in (0, 1, 3):
        assert outlier_scores(df.where(F.col("id") <= n), method="covariance", key=["id"]).where("score >= 0").count() == n


def brute_dbscan(x, eps, minimum, metric):
    d = distances(x, x, metric)
    near = d <= eps
    core = near.sum(axis=1) >= minimum
    label, number = np.full(len(x), "Noise", dtype=object), 0
    owner = np.zeros(len(x), dtype=int)
    for i in range(len(x)):
        if core[i] and not owner[i]:
            number += 1
            stack = [i]
            owner[i] = number
            while stack:
                j = stack.pop()
                for n in np.flatnonzero(near[j] & core & (owner == 0)):
                    owner[n] = number
                    stack.append(n)
    for i in range(len(x)):
        options = owner[near[i] & core]
        if len(options):
            label[i] = f"C{owner[i] or options.min()}"
    return list(label)


@pytest.mark.parametrize("metric,eps", [("euclidean", 0.5), ("manhattan", 1.0)])
def test_dbscan_is_exact(spark, cloud, small_blocks, metric, eps):
    df = set_roles(spark.createDataFrame(cloud), metas=["id"])
    got = dbscan(df, eps=eps, min_samples=5, metric=metric, key=["id"]).toPandas().sort_values("id")
    assert list(got["Cluster"]) == brute_dbscan(cloud[["x", "y"]].to_numpy(), eps, 5, metric)


def test_dbscan_cosine(spark):
    rng = np.random.default_rng(0)
    angle = np.concatenate([rng.normal(0, 0.02, 30), rng.normal(1.5, 0.02, 30)])
    x = np.column_stack([np.cos(angle), np.sin(angle)]) * rng.uniform(1, 50, 60)[:, None]
    df = set_roles(spark.createDataFrame(pd.DataFrame(x, columns=["x", "y"]).assign(id=range(60))), metas=["id"])
    got = dbscan(df, eps=0.01, min_samples=4, metric="cosine", key=["id"]).toPandas().sort_values("id")["Cluster"]
    assert set(got[:30]) == {"C1"} and set(got[30:]) == {"C2"}


def test_spanning_forest_connects_what_the_matrix_connects():
    rng = np.random.default_rng(0)
    near = rng.random((30, 40)) < 0.04
    a, b = spanning_forest(near)
    assert all(near[i, j] for i, j in zip(a, b)) and len(a) <= 69

    def parts(edges):
        owner = list(range(70))
        for i, j in edges:
            x, y = owner[i], owner[30 + j]
            owner = [x if o == y else o for o in owner]
        return len(set(owner))

    assert parts(zip(a, b)) == parts(zip(*np.nonzero(near)))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    star = [("hub", f"s{i}") for i in range(60)]
    nodes = {n for e in chain + star for n in e} | {"alone"}
    parts = connected_components(
        spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(chain + star + chain[:3], "a string, b string"))
    got = {r.id: r.component for r in parts.collect()}
    assert {got[n] for n in nodes if n.startswith("n")} == {"n000"} and {got[n] for n in nodes if n[0] in "hs"} == {"hub"}
    assert got["alone"] == "alone" and len(got) == len(nodes)


def test_kmeans_properties(spark, cloud):
    df = set_roles(spark.createDataFrame(cloud.iloc[:180]), metas=["id"]).withColumn("x", F.when(F.col("id") != 3, F.col("x")))
    annotated, centroids = kmeans(df, k=3, n_init=2)
    a, c = annotated.toPandas(), centroids.toPandas().set_index("Cluster")
    assert sorted(c.index) == ["C1", "C2", "C3"] and a["x"].isna().sum() == 1
    filled = a.fillna({"x": a["x"].mean()})
    for name, part in filled.groupby("Cluster"):
        assert part[["x", "y"]].mean().to_numpy() == pytest.approx(c.loc[name].to_numpy(dtype=float))
    gaps = np.linalg.norm(filled[["x", "y"]].to_numpy()[:, None] - c.to_numpy(dtype=float)[None], axis=2)
    assert [f"C{i + 1}" for i in gaps.argmin(axis=1)] == list(filled["Cluster"])
