"""Neighbour searches through nested trees: the same answers, and leaves that stay small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.operators import neighbors
from tablemine.operators.clusters import dbscan
from tablemine.operators.neighbors import Nested, block_parts, nearest, pack_chunks, paired, pack_blocks, tree_for, visits, with_leaf


@pytest.fixture
def small(monkeypatch):
    def cap(leaves):
        monkeypatch.setattr(neighbors, "MAX_LEAVES", leaves)
        monkeypatch.setattr(neighbors, "BLOCK", 25)
        monkeypatch.setattr(neighbors, "CHUNK", 40)
        monkeypatch.setattr(neighbors, "INNER_ROWS", 100)

    return cap


def cloud(spark, n=900, seed=4):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n // 2, 2)), rng.normal(size=(n // 2, 2)) * 0.05 + 3]).round(2)
    rows = [(i, *map(float, a)) for i, a in enumerate(x)] + [(n + i, 3.0, 3.0) for i in range(200)]
    return spark.createDataFrame(rows, "id int, x double, y double").repartition(3)


def points_of(df):
    return df.groupBy(F.array("x", "y").alias("v")).agg(F.count(F.lit(1)).alias("w")).withColumn("label", F.lit(0))


@pytest.mark.parametrize("metric, own", [("euclidean", True), ("manhattan", False)])
def test_same_neighbours(spark, small, metric, own):
    points = points_of(cloud(spark))
    want = sorted(map(tuple, nearest(points.select("v", "label"), points, 7, metric=metric, exclude_self=own).collect()), key=str)
    small(4)
    assert isinstance(tree_for(points), Nested)
    got = sorted(map(tuple, nearest(points.select("v", "label"), points, 7, metric=metric, exclude_self=own).collect()), key=str)
    assert got == want


def test_same_clusters(spark, small):
    df = set_roles(cloud(spark), metas=["id"])
    clusters = lambda: sorted((r.id, r.Cluster) for r in dbscan(df, eps=0.2, min_samples=5, key=["id"]).collect())
    want = clusters()
    small(3)
    assert clusters() == want


def test_leaves_stay_small_and_few_are_visited(spark, small):
    points = points_of(cloud(spark, 3000)).cache()
    small(4)
    tree = tree_for(points)
    sizes = [r["count"] for r in with_leaf(points, tree).groupBy("leaf").count().collect()]
    assert max(sizes) <= 4 * neighbors.BLOCK and len(sizes) > points.count() / (3 * neighbors.BLOCK)

    def compared(t):
        seen = visits(points.select("v", "label"), t, F.lit(0.05), "euclidean")
        return paired(pack_chunks(seen), pack_blocks(points, t), block_parts(points, t)).agg(F.sum(F.size("chunk") * F.size("block"))).first()[0]

    capped = compared(tree.outer)  # what one tree of so many leaves compares
    assert compared(tree) * 5 < capped


def test_every_region_holds_its_points(spark, small):
    points = points_of(cloud(spark))
    small(4)
    tree = tree_for(points)
    inner = {r.top: neighbors._opened(bytes(r.nodes), bytes(r.regions), 2) for r in tree.inner.collect()}
    assert len(inner) == tree.outer.leaves
    for r in with_leaf(points, tree).collect():
        t, leaf = inner[r.leaf >> neighbors.INNER_BITS], r.leaf & ((1 << neighbors.INNER_BITS) - 1)
        assert (np.array(r.v) >= t.low[leaf]).all() and (np.array(r.v) <= t.high[leaf]).all()
