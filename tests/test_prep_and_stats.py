"""Preparation, statistics, correlations, scores: edge cases and properties."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemine.domain import domain_of, set_roles
from tablemine.functions.entropy import split_points
from tablemine.functions.special import betainc, correlation_p
from tablemine.operators.correlation import correlation_matrix, correlations
from tablemine.operators.prep import Preprocessor, continuize, discretize, impute, interval_labels, normalize
from tablemine.operators.projection import landmark_mds, pca
from tablemine.operators.ranking import rank, rank_scores, rrelieff
from tablemine.operators.statistics import column_stats, dataset_profile, value_distribution


@pytest.fixture
def gaps(spark):
    df = spark.createDataFrame(
        [(1.0, "a", None, 5.0), (None, "a", None, 5.0), (3.0, None, None, 5.0), (8.0, "b", None, 5.0)], "x double, c string, empty double, same double")
    return set_roles(df, discrete=["c"])


def test_column_stats(gaps):
    s = {r.column: r for r in column_stats(gaps).collect()}
    assert (s["x"].min, s["x"].max, s["x"].mean, s["x"].missing) == (1.0, 8.0, 4.0, 1)
    assert s["empty"].mean is None and s["empty"].missing == 4 and s["c"].missing == 1
    assert {(r.value, r["count"]) for r in value_distribution(gaps).collect()} == {("a", 2), ("b", 1)}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    row = column_stats(df).first()
    assert row.mean == 1.0 and row.missing == 1


def test_impute(gaps):
    assert [r.x for r in impute(gaps).collect()] == [1.0, 4.0, 3.0, 8.0]
    assert [r.c for r in impute(gaps, method="whatever").collect()] == ["a", "a", "a", "b"]
    assert [r.x for r in impute(gaps, method="median").collect()] == [1.0, 3.0, 3.0, 8.0]
    assert [r.x for r in impute(gaps, method="default").collect()] == [1.0, 0.0, 3.0, 8.0]
    assert impute(gaps.drop("empty"), method="drop").count() == 2
    assert all(r.empty is None for r in impute(gaps).collect())


def test_normalize_without_spread(gaps):
    assert [r.same for r in normalize(gaps).collect()] == [0.0] * 4
    assert [r.same for r in normalize(gaps, method="minmax").collect()] == [0.0] * 4
    assert [r.same for r in normalize(gaps, method="robust").collect()] == [0.0] * 4
    assert [r.x for r in normalize(gaps, method="minmax").collect()] == [0.0, None, pytest.approx(2 / 7), 1.0]


def test_encoding(gaps):
    assert continuize(gaps).columns == ["x", "c=a", "c=b", "empty", "same"]
    assert continuize(gaps, treatment="first_as_base").columns == ["x", "c=b", "empty", "same"]
    assert [r.c for r in continuize(gaps, treatment="as_ordinal").collect()] == [0.0, 0.0, None, 1.0]


def test_bins(gaps):
    t = discretize(gaps, method="equal_width", n_bins=7)
    assert [r.x for r in t.collect()] == ["< 2", None, "[3, 4)", ">= 7"]
    assert {r.same for r in t.collect()} == {"all"} and domain_of(t)["x"].var_type == "discrete"
    assert interval_labels([1.5]) == ["< 1.5", ">= 1.5"]


def test_entropy_split():
    values, counts = np.arange(10.0), np.array([[10, 0]] * 5 + [[0, 10]] * 5, dtype=float)
    assert split_points(values, counts) == [5.0]
    assert split_points(values, np.full((10, 2), 5.0)) == []


def test_entropy_binning_finds_planted_cut(spark):
    df = spark.range(2000).select((F.col("id") % 100).cast("double").alias("x"), F.when(F.col("id") % 100 < 37, "lo").otherwise("hi").alias("y"))
    t = discretize(set_roles(df, discrete=["y"], target="y"), method="entropy")
    assert domain_of(t)["x"].values == ("< 37", ">= 37")


def test_preprocessor_replays_training_numbers(spark):
    train = spark.createDataFrame([(0.0,), (10.0,), (None,)], "x double")
    other = spark.createDataFrame([(20.0,), (None,)], "x double")
    step = Preprocessor(("impute", {}), ("normalize", {"method": "minmax"})).fit(train)
    assert [r.x for r in step(other).collect()] == [2.0, 0.5]


def test_incomplete_beta():
    # Closed forms: I_x(1, b) = 1 - (1 - x)^b, I_x(a, 1) = x^a, I_{1/2}(a, a) = 1/2.
    x = np.linspace(0, 1, 11)
    assert betainc(1, 3, x) == pytest.approx(1 - (1 - x) ** 3)
    assert betainc(2.5, 1, x) == pytest.approx(x**2.5)
    assert betainc(50, 50, 0.5) == pytest.approx(0.5)
    # Two degrees of freedom: p = 1 - |r|.
    assert correlation_p(0.4, 4) == pytest.approx(0.6)
    assert correlation_p(0.4, 2) == 1.0 and correlation_p(1.0, 10) == 0.0


def test_spearman_paths_agree_with_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 400).astype(float), "b": rng.normal(size=400), "c": rng.normal(size=400)})
    pdf["c"] += pdf["a"]
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    want = pdf.corr(method="spearman")
    for r in correlations(df, method="spearman").collect():
        a, b = r["Feature A"], r["Feature B"]
        both = pdf[[a, b]].dropna()
        assert r["Correlation"] == pytest.approx(both[a].rank().corr(both[b].rank()))
    assert want.loc["a", "c"] > 0


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "a double, b double")
    row = correlations(df).first()
    assert row["Correlation"] == 0.0 and row["p-value"] == 1.0
    assert correlations(df.select("a")) is None
    m = correlation_matrix(spark.createDataFrame([(1.0, 2.0, 1.0, 0.0)] * 3 + [(2.0, 1.0, 5.0, 1.0)], "a double, b double, c double, d double"))
    assert m.count() == 4 and len(m.columns) == 5


def test_rank_top_two_of_four(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 600)
    pdf = pd.DataFrame({"noise": rng.normal(size=600), "strong": y + rng.normal(0, 0.1, 600), "weak": y + rng.normal(0, 1, 600), "flat": 1.0, "y": y.astype(str)})
    df = set_roles(spark.createDataFrame(pdf), discrete=["y"], target="y")
    reduced, scores = rank(df, n_selected=2)
    assert scores.count() == 4 and scores.columns == ["Feature", "InfoGain", "GainRatio", "Gini", "ANOVA", "Chi2"]
    assert reduced.columns == ["strong", "weak", "y"]
    assert rank(df, select_mode="threshold", threshold=99.0)[0].columns == ["strong", "y"]
    by_gini = rank_scores(df, scoring_method="gini").collect()
    assert [r.Gini for r in by_gini] == sorted((r.Gini for r in by_gini), reverse=True)


def test_rrelieff_prefers_the_cause(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(500), "cause": rng.random(500), "noise": rng.random(500)})
    pdf["y"] = pdf["cause"] * 3
    df = set_roles(spark.createDataFrame(pdf), target="y", metas=["id"])
    w = {r.feature: r.RReliefF for r in rrelieff(df, "y", ["cause", "noise"], key=["id"]).collect()}
    assert w["cause"] > w["noise"]


def test_profile_is_json(read):
    doc = json.loads(dataset_profile(set_roles(read("part"), metas=["p_partkey"]), key=["p_partkey"]).first().json)
    assert doc["row_count"] == 200 and len(doc["sample_rows"]) == 5 and {c["name"] for c in doc["schema"]} == set(read("part").columns)
    assert len(doc["correlations"]) == 1


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ np.array([[3, 1, 0], [0, 1, 0.2], [0, 0, 0.1]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    scores, components = pca(df, n_components=9)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert scores.columns == ["PC1", "PC2", "PC3"]
    assert [r.variance for r in components.collect()] == pytest.approx(values / values.sum())
    assert np.var(scores.toPandas()["PC1"], ddof=1) == pytest.approx(values[0])
    assert abs(scores.toPandas()["PC2"].mean()) < 1e-9
    assert pca(df, explained=values[0] / values.sum() - 1e-6)[1].count() == 1


def test_landmark_mds_keeps_planar_distances(spark):
    rng = np.random.default_rng(0)
    flat = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 5))
    pdf = pd.DataFrame(flat, columns=list("abcde")).assign(id=range(300))
    out = landmark_mds(set_roles(spark.createDataFrame(pdf), metas=["id"]), landmarks=40, key=["id"]).toPandas().sort_values("id")
    got = out[["mds-x1", "mds-x2"]].to_numpy()
    want = np.linalg.norm(flat[:50, None] - flat[None, :50], axis=2)
    assert np.linalg.norm(got[:50, None] - got[None, :50], axis=2) == pytest.approx(want, abs=1e-6)
