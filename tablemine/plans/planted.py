"""Learners and clusters on tables whose answer is known: classes and values that follow a rule with a wide margin.

The attributes are the part's size with a gap between small and large parts, and its mirror image, so every split or plane
that separates the classes gives the rule itself, whatever the learner's random choices. Naive Bayes bins by quartiles, which
separate the classes only where the gap holds one: its classes part at the median.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.functions.ordering import column_quantiles
from tablemine.operators.clusters import kmeans
from tablemine.operators.learners import (
    AdaBoost, DecisionTree, Knn, LinearRegression, LogisticRegression, NaiveBayes, NeuralNetwork, RandomForest, Sgd, Svm,
)
from tablemine.operators.outliers import outlier_scores
from tablemine.operators.prep import Preprocessor
from tablemine.plans.registry import query, rounded, table

SCALED = Preprocessor(("normalize", {}))
_GAP = "p_size + CASE WHEN p_size > 25 THEN 40 ELSE 0 END"


def _parts(spark, sf, target):
    gap = (F.col("p_size") + F.when(F.col("p_size") > 25, 40).otherwise(0)).cast("double")
    return table(spark, sf, "part").select("p_partkey", gap.alias("gap"), (100 - gap).alias("mirror"), target.alias("y"))


def _classify(name, make):
    @query(f"{name}_planted", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS prediction FROM part")
    def _run(spark, sf):
        df = _parts(spark, sf, F.when(F.col("p_size") > 25, "large").otherwise("small"))
        df = set_roles(df, discrete=["y"], target="y", metas=["p_partkey"])
        return make().fit(df).transform(df).select("p_partkey", "prediction")


def _steps(name, make):
    @query(f"{name}_planted", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 12.5 ELSE 3.25 END::DOUBLE AS prediction FROM part")
    def _run(spark, sf):
        df = set_roles(_parts(spark, sf, F.when(F.col("p_size") > 25, 12.5).otherwise(3.25)), target="y", metas=["p_partkey"])
        return rounded(make().fit(df).transform(df).select("p_partkey", "prediction"))


@query("linear_planted", f"SELECT p_partkey, (3.0 * ({_GAP}) - 7)::DOUBLE AS prediction FROM part")
def _plane(spark, sf):
    gap = F.col("p_size") + F.when(F.col("p_size") > 25, 40).otherwise(0)
    df = set_roles(_parts(spark, sf, 3.0 * gap - 7), target="y", metas=["p_partkey"])
    return rounded(LinearRegression().fit(df).transform(df).select("p_partkey", "prediction"))


_classify("logistic_regression", lambda: LogisticRegression(preprocessor=SCALED))
_classify("knn", Knn)
_classify("decision_tree", DecisionTree)
_classify("random_forest", RandomForest)
_classify("adaboost", AdaBoost)
_classify("svm_linear", lambda: Svm(kernel="linear", preprocessor=SCALED))
_classify("svm_rbf", lambda: Svm(kernel="rbf", preprocessor=SCALED))
_classify("svm_poly", lambda: Svm(kernel="poly", preprocessor=SCALED))
_classify("sgd_classifier", Sgd)
_classify("neural_network", NeuralNetwork)
_steps("decision_tree_regression", DecisionTree)
_steps("random_forest_regression", RandomForest)
_steps("adaboost_regression", AdaBoost)


@query("naive_bayes_planted", """
SELECT p_partkey, CASE WHEN p_size >= (SELECT quantile_cont(p_size, 0.5) FROM part) THEN 'large' ELSE 'small' END AS prediction FROM part""")
def _naive_bayes(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    large = F.col("size") >= column_quantiles(df, ["size"], [0.5])["size"][0.5]
    gap = F.col("size") + F.when(large, 40).otherwise(0)
    df = df.select("p_partkey", gap.alias("gap"), (100 - gap).alias("mirror"), F.when(large, "large").otherwise("small").alias("y"))
    return NaiveBayes().fit(set_roles(df, discrete=["y"], target="y", metas=["p_partkey"])).transform(df).select("p_partkey", "prediction")


@query("tree_node_size_planted", """
WITH n AS (SELECT count(*) FILTER (WHERE p_size <= 10) AS a, count(*) FILTER (WHERE p_size > 10) AS b FROM part WHERE p_size <= 20)
SELECT p_partkey, CASE WHEN p_size > 20 THEN 'c' WHEN a >= b THEN 'a' ELSE 'b' END AS prediction FROM part, n""")
def _node_size(spark, sf):
    """The cut at 20 leaves a node of two classes with fewer rows than a split needs."""
    kind = F.when(F.col("p_size") > 20, "c").when(F.col("p_size") > 10, "b").otherwise("a")
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), kind.alias("y"))
    tree = DecisionTree(min_samples_split=df.count() // 2).fit(set_roles(df, discrete=["y"], target="y", metas=["p_partkey"]))
    return tree.transform(df).select("p_partkey", "prediction")


def _customers(spark, sf):
    """Three groups far apart."""
    far = (F.col("c_nationkey") % 3 * 1000).cast("double")
    return set_roles(table(spark, sf, "customer").select("c_custkey", far.alias("far"), (F.col("c_acctbal") / 10000).alias("near")), metas=["c_custkey"])


@query("kmeans_annotated_planted", "SELECT c_custkey, 'C' || (c_nationkey % 3 + 1) AS \"Cluster\" FROM customer")
def _kmeans(spark, sf):
    return kmeans(_customers(spark, sf), k=3)[0].select("c_custkey", "Cluster")


@query("kmeans_centroids_planted", """
SELECT (c_nationkey % 3 * 1000)::DOUBLE AS far, round(avg(c_acctbal / 10000), 6) + 0.0 AS near FROM customer GROUP BY c_nationkey % 3""")
def _centroids(spark, sf):
    return rounded(kmeans(_customers(spark, sf), k=3)[1].select("far", "near"))


@query("outliers_covariance_planted", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN 'outlier' ELSE 'inlier' END AS part FROM orders""")
def _covariance_planted(spark, sf):
    """Two of five orders lie in a tight cluster far off: too many for a start from the medians alone."""
    far = F.col("o_orderkey") % 5 < 2
    wide = lambda c, a: F.crc32(F.concat(F.lit(a), c.cast("string")).cast("binary")) / F.lit(2.0**32)
    a, b = wide(F.col("o_orderkey"), "a"), wide(F.col("o_orderkey"), "b")
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(far, a / 10 + 500).otherwise(a).alias("a"), F.when(far, b / 10 - 500).otherwise(a + b).alias("b"),
    )
    scored = outlier_scores(set_roles(df, metas=["o_orderkey"]), method="covariance", key=["o_orderkey"])
    return scored.select("o_orderkey", F.when(F.col("score") > 1000, "outlier").otherwise("inlier").alias("part"))
