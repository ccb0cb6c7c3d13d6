"""Exact sizes with awkward keys, whole series, forests node by node, robust distances without a clamp, broken images."""

import io
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.functions.ordering import hash_key
from tablemine.operators.grid import roll
from tablemine.operators.learners import DecisionTree, RandomForest, tree_structure
from tablemine.operators.outliers import outlier_scores
from tablemine.operators.sampling import sample
from tablemine.sources.images import read_image_grid
from tablemine.streaming.records import AnomalyScorer


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def alike(spark):
    """Keys that only differ in where a part ends, or in NULL and empty text."""
    return spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x"), ("1:a", ""), ("1", ":a|"), ("~", None), (None, "~")], "k string, j string")


def test_different_keys_hash_differently(alike):
    assert alike.select(hash_key(["k", "j"])).distinct().count() == alike.count()


@pytest.mark.parametrize("n", [0, 1, 3, 5, 8, 20])
def test_sizes_are_exact_whatever_the_keys(spark, alike, n):
    chosen, rest = sample(alike, kind="fixed", n=n, key=["k", "j"])
    assert (chosen.count(), rest.count()) == (min(n, 8), 8 - min(n, 8))
    repeated = spark.createDataFrame([(1, i) for i in range(30)] + [(2, i) for i in range(5)], "k int, v int")
    chosen, rest = sample(repeated, kind="fixed", n=n, key=["k"])
    assert (chosen.count(), rest.count()) == (n, 35 - n)
    assert not {r.v for r in chosen.where("k = 1").collect()} & {r.v for r in rest.where("k = 1").collect()}


def test_classes_give_their_share_even_if_keys_repeat(spark):
    df = spark.createDataFrame([(i % 3, "ab"[i % 2], i) for i in range(60)], "k int, c string, v int")
    chosen, rest = sample(df, pct=40, stratify="c", key=["k"])
    assert {r.c: r["count"] for r in chosen.groupBy("c").count().collect()} == {"a": 12, "b": 12} and rest.count() == 36


def test_rows_stay_where_they_are_in_a_stratified_sample(read):
    chosen, _ = sample(read("orders"), pct=70, stratify="o_orderpriority", key=["o_orderkey"])
    assert "SortMergeJoin" not in plan_of(chosen)


def test_roll_keeps_every_row(spark):
    df = spark.createDataFrame([("s", 1, 5.0, 1), ("s", 1, 7.0, 0), ("s", 2, 1.0, 0), ("s", 3, 9.0, 0), (None, 1, 2.0, 0)], "s string, t int, v double, k int")
    got = sorted((r.v, r.filtered) for r in roll(df, series="s", order="t", value="v", kind="mean", ties=["k"]).collect())
    assert len(got) == 5
    line = {v: f for v, f in got if v != 2.0}  # in order 7, 5, 1, 9, mirrored at the ends
    assert line == {7.0: pytest.approx(19 / 3), 5.0: pytest.approx(13 / 3), 1.0: pytest.approx(5.0), 9.0: pytest.approx(19 / 3)}


def test_roll_needs_a_place(spark):
    with pytest.raises(ValueError, match="without a place"):
        roll(spark.createDataFrame([("s", None, 1.0)], "s string, t int, v double"), series="s", order="t", value="v")


@pytest.fixture(scope="module")
def flowers(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(300), "a": rng.normal(size=300), "b": rng.normal(size=300)})
    pdf["y"] = np.where(pdf["a"] + pdf["b"] > 0.3, "p", "q")
    return set_roles(spark.createDataFrame(pdf), discrete=["y"], target="y", metas=["id"])


def test_forest_node_by_node(flowers):
    nodes = tree_structure(RandomForest(n_estimators=3, max_depth=4).fit(flowers)).toPandas()
    assert sorted(nodes["tree"].unique()) == [0, 1, 2] and not nodes.duplicated(["tree", "id"]).any()
    depth = nodes.set_index(["tree", "id"])["depth"]
    for r in nodes.itertuples():
        assert r.depth == 0 if np.isnan(r.parent) else depth[r.tree, int(r.parent)] == r.depth - 1


def test_no_condition_at_the_depth_that_is_shown(flowers):
    shown = tree_structure(DecisionTree(max_depth=4).fit(flowers), max_depth=1).toPandas()
    assert shown.loc[shown["depth"] == 1, "condition"].isna().all() and shown.loc[shown["depth"] == 0, "condition"].notna().all()


def test_robust_covariance_has_no_largest_distance(spark):
    """Most values are zero, so spreads are tiny and the others are thousands of them away; half of the rows must still do."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((400, 2)) < 0.8, rng.normal(0, 1e-6, (400, 2)), rng.normal(0, 1e3, (400, 2)))
    df = set_roles(spark.createDataFrame(pd.DataFrame({"id": range(400), "a": x[:, 0], "b": x[:, 1]})), metas=["id"])
    got = outlier_scores(df, method="covariance", contamination=0.2, key=["id"]).toPandas().sort_values("id")
    flagged = (got["Outlier"] == "yes").to_numpy()
    assert flagged.sum() == 80 and (np.abs(x[flagged]).max(1) > 1).all()
    assert got["score"].to_numpy()[np.abs(x).max(1) > 100].min() > 1e6


def test_anomalies_of_a_stream_follow_contamination(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"id": range(500), "v": rng.normal(size=500)}))
    for share in (0.02, 0.2):
        flags = AnomalyScorer(df, ["v"], key=["id"], contamination=share).flag(df).where("Outlier = 'yes'").count()
        assert flags == pytest.approx(500 * share, abs=3)


def test_broken_images_are_named(spark, tmp_path):
    (tmp_path / "broken.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="broken.png"):
        read_image_grid(spark, str(tmp_path)).count()
    assert read_image_grid(spark, str(tmp_path), skip_broken=True).count() == 0


@pytest.mark.parametrize("block", [2000, 150])
def test_neighbours_are_paired_by_block(spark, monkeypatch, block):
    """No product of chunks and blocks, be the points one leaf or many; neighbours are those of brute force."""
    from tablemine.operators import neighbors

    monkeypatch.setattr(neighbors, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3))
    points = neighbors.weighted_points(spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))), F.array("a", "b", "c"))
    got = neighbors.nearest(points.select("v", "label"), points, 4, exclude_self=True)
    plan = plan_of(got)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag(np.full(900, np.inf))
    want = {tuple(v): sorted(r)[:4] for v, r in zip(x.tolist(), d.tolist())}
    found: dict = {}
    for r in got.collect():
        found.setdefault(tuple(r.v), []).append(r.d)
    assert {k: sorted(v) for k, v in found.items()} == {k: pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("kind", ["sgd", "network"])
def test_gradient_learners_do_not_depend_on_partitions(spark, monkeypatch, kind):
    from tablemine.operators.learners import NeuralNetwork, Sgd, descent

    monkeypatch.setattr(descent, "SHARD", 300)
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(1500, 3)).round(2), columns=list("abc")).assign(id=range(1500))
    pdf["y"] = np.where(pdf["a"] - pdf["b"] + rng.normal(0, 0.2, 1500) > 0, "p", "q")
    pdf.loc[:500, ["a", "b", "c", "y"]] = [1.0, 0.0, 0.0, "p"]  # a third of the rows are alike
    learner = Sgd(loss="log_loss", max_iter=30) if kind == "sgd" else NeuralNetwork(hidden_layer_sizes="8", max_iter=25)
    found = []
    for parts in (2, 8, 32):
        df = set_roles(spark.createDataFrame(pdf).repartition(parts, "id"), discrete=["y"], target="y", metas=["id"])
        out = learner.fit(df).transform(df).select("id", "prediction", F.expr("probabilities[0]").alias("p")).toPandas().sort_values("id")
        found.append(out)
    for other in found[1:]:
        assert (other["prediction"].to_numpy() == found[0]["prediction"].to_numpy()).all()
        assert other["p"].to_numpy() == pytest.approx(found[0]["p"].to_numpy(), abs=1e-6)
    assert (found[0]["prediction"].to_numpy() == pdf["y"].to_numpy()).mean() > 0.9


def test_coefficients_of_every_linear_model(flowers):
    from tablemine.operators.learners import Sgd, Svm, coefficients

    for learner in (Svm(kernel="linear", max_iter=20), Sgd(loss="log_loss", max_iter=20)):
        got = {r["name"]: r["q"] for r in coefficients(learner.fit(flowers)).collect()}
        assert set(got) == {"Intercept", "a", "b"} and got["a"] < 0 and got["b"] < 0
    with pytest.raises(ValueError, match="linear kernel"):
        coefficients(Svm(kernel="rbf", max_iter=2, components=8).fit(flowers))
