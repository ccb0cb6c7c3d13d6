"""Queries over learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.operators.learners import (
    AdaBoost, Constant, DecisionTree, Knn, LinearRegression, LogisticRegression, NaiveBayes, NeuralNetwork, RandomForest, Sgd, Svm,
    coefficients, learner_contract, train_metrics,
)
from tablemine.operators.prep import Preprocessor
from tablemine.plans.registry import query, rounded, table

# Line items with a class derived from the revenue.
BASE = """(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_linestatus,
  CASE WHEN l_extendedprice * (1 - l_discount) > 40000 THEN 'high' WHEN l_extendedprice * (1 - l_discount) > 15000 THEN 'mid' ELSE 'low' END AS band FROM lineitem)"""


def banded(spark, sf):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus",
        F.when(revenue > 40000, "high").when(revenue > 15000, "mid").otherwise("low").alias("band"),
    )
    return set_roles(df, discrete=["l_linestatus", "band"], target="band", metas=["l_orderkey", "l_linenumber", "l_partkey"])


def numbers(spark, sf):
    """Orders: price in thousands against its square root and the order year."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("price"), F.year("o_orderdate").cast("double").alias("year"),
        F.sqrt("o_totalprice").alias("root"),
    )
    return set_roles(o, target="root", metas=["o_orderkey"])


SCALED = Preprocessor(("normalize", {}))


@query("learner_contract", """
SELECT 'lineitem' AS name, count(*) AS rows, 4 AS attributes, true AS valid, NULL::VARCHAR AS reason FROM lineitem
UNION ALL SELECT 'empty', 0, 4, false, 'no rows'
UNION ALL SELECT 'no class', count(*), 3, false, 'no class' FROM lineitem
UNION ALL SELECT 'one class', count(*), 3, false, 'fewer than two class values' FROM lineitem WHERE l_linestatus = 'O'""")
def _contract(spark, sf):
    df = banded(spark, sf)
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linestatus")
    cases = {
        "lineitem": df, "empty": df.where(F.lit(False)), "no class": li,
        "one class": set_roles(li.where("l_linestatus = 'O'"), discrete=["l_linestatus"], target="l_linestatus"),
    }
    out = None
    for name, case in cases.items():
        row = learner_contract(case).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("train_metrics", f"""
SELECT 'train_CA' AS metric, round(max(n) / sum(n), 4) AS value FROM (SELECT count(*) AS n FROM {BASE} GROUP BY band)
UNION ALL SELECT 'train_RMSE', round(stddev_pop(sqrt(o_totalprice)), 4) FROM orders
UNION ALL SELECT 'train_R2', 0.0""")
def _train_metrics(spark, sf):
    df, reg = banded(spark, sf), numbers(spark, sf)
    both = train_metrics(Constant().fit(df), df).unionByName(train_metrics(Constant().fit(reg), reg))
    return rounded(both, 4)


@query("constant_classifier", f"""
SELECT l_orderkey, l_linenumber, l_partkey, (SELECT band FROM {BASE} GROUP BY band ORDER BY count(*) DESC, band LIMIT 1) AS prediction,
  round((SELECT count(*) FROM {BASE} WHERE band = 'mid') / (SELECT count(*) FROM lineitem), 6) AS p_mid FROM lineitem""")
def _constant_classifier(spark, sf):
    df = banded(spark, sf)
    out = Constant().fit(df).transform(df)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "prediction", F.get("probabilities", F.lit(2)).alias("p_mid")))


@query("constant_regressor", "SELECT o_orderkey, round((SELECT avg(sqrt(o_totalprice)) FROM orders), 6) AS prediction FROM orders")
def _constant_regressor(spark, sf):
    df = numbers(spark, sf)
    return rounded(Constant().fit(df).transform(df).select("o_orderkey", "prediction"))


def _one(spark, sf):
    """One attribute of small spread, so penalties matter."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 100000).alias("x"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("y"),
    )
    return set_roles(li, target="y", metas=["l_orderkey", "l_linenumber", "l_partkey"])


_XY = "(SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 100000 AS x, l_extendedprice * (1 - l_discount) / 1000 AS y FROM lineitem)"
_SLOPES = {
    "ols": "covar_pop(x, y) / var_pop(x)",
    "ridge": "count(*) * covar_pop(x, y) / (count(*) * var_pop(x) + 500)",
    "lasso": "greatest(covar_pop(x, y) - 0.5, 0) / var_pop(x)",
    "elastic_net": "greatest(covar_pop(x, y) - 0.5 * 0.3, 0) / (var_pop(x) + 0.5 * 0.7)",
}
_LINEAR = {
    "ols": {}, "ridge": {"regularization": "ridge", "alpha": 500.0}, "lasso": {"regularization": "lasso", "alpha": 0.5},
    "elastic_net": {"regularization": "elastic_net", "alpha": 0.5, "l1_ratio": 0.3},
}

for _name, _slope in _SLOPES.items():
    @query(f"linear_{_name}", f"""
WITH m AS (SELECT {_slope} AS w, avg(x) AS mx, avg(y) AS my FROM {_XY})
SELECT l_orderkey, l_linenumber, l_partkey, round(my + w * (x - mx), 5) AS prediction FROM {_XY}, m""")
    def _linear(spark, sf, settings=_LINEAR[_name]):
        df = _one(spark, sf)
        out = LinearRegression(**settings).fit(df).transform(df)
        return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "prediction"), 5)


@query("coefficients", f"""
SELECT 'Intercept' AS name, round(regr_intercept(y, x), 5) AS coef FROM {_XY}
UNION ALL SELECT 'x', round(regr_slope(y, x), 5) FROM {_XY}""")
def _coefficients(spark, sf):
    return rounded(coefficients(LinearRegression().fit(_one(spark, sf))), 5)


def _nb_sql() -> str:
    attrs = ["l_quantity", "l_extendedprice", "l_discount"]
    bins = []
    for c in attrs:
        cuts = " + ".join(f"({c} >= (SELECT quantile_cont({c}, {p}) FROM lineitem))::INT" for p in (0.25, 0.5, 0.75))
        bins.append(f"SELECT rid, '{c}' AS f, ({cuts})::VARCHAR AS b, band AS cls FROM base")
    bins.append("SELECT rid, 'l_linestatus', l_linestatus, band FROM base")
    return f"""
WITH base AS (SELECT *, row_number() OVER () AS rid FROM {BASE}),
long AS ({' UNION ALL '.join(bins)}),
classes AS (SELECT band AS cls, ln((count(*) + 1) / ((SELECT count(*) FROM base) + 3)) AS prior, count(*) AS nc FROM base GROUP BY band),
levels AS (SELECT f, count(DISTINCT b) AS k FROM long GROUP BY f),
cells AS (SELECT f, b, cls, count(*) AS n FROM long GROUP BY ALL),
probs AS (SELECT l.f, l.b, c.cls, ln((coalesce(n, 0) + 1) / (nc + k)) AS lp FROM (SELECT DISTINCT f, b FROM long) l
  JOIN classes c ON true JOIN levels USING (f) LEFT JOIN cells ON cells.f = l.f AND cells.b = l.b AND cells.cls = c.cls),
scores AS (SELECT rid, p.cls, sum(lp) AS s FROM long JOIN probs p ON long.f = p.f AND long.b = p.b GROUP BY rid, p.cls),
full_scores AS (SELECT rid, cls, s + prior AS s FROM scores JOIN classes USING (cls)),
wide AS (SELECT rid, max(s) AS top, sum(exp(s)) AS total, max(s) FILTER (WHERE cls = 'high') AS hi,
  arg_min(cls, cls) FILTER (WHERE cls IS NOT NULL) AS c0 FROM full_scores GROUP BY rid),
best AS (SELECT rid, min(cls) AS prediction FROM full_scores JOIN wide USING (rid) WHERE s = top GROUP BY rid)
SELECT l_orderkey, l_linenumber, l_partkey, round(exp(hi) / total, 6) + 0.0 AS p_high, prediction
FROM base JOIN wide USING (rid) JOIN best USING (rid)"""


@query("naive_bayes", _nb_sql())
def _naive_bayes(spark, sf):
    df = banded(spark, sf)
    out = NaiveBayes().fit(df).transform(df)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", F.get("probabilities", F.lit(0)).alias("p_high"), "prediction"))


# All pairs of distinct points; neighbours in order of distance, vector and class until their weights reach 5.
@query("knn", """
WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y, p_brand AS c, count(*) AS w FROM part GROUP BY ALL),
q AS (SELECT DISTINCT x, y FROM p),
pr AS (SELECT q.x, q.y, p.c, p.w, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS d, p.x AS nx, p.y AS ny FROM q, p),
o AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY x, y ORDER BY d, nx, ny, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pr),
v AS (SELECT x, y, c, sum(least(w, 5 - before)) AS votes FROM o WHERE before < 5 GROUP BY x, y, c),
b AS (SELECT x, y, c, votes, row_number() OVER (PARTITION BY x, y ORDER BY votes DESC, c) AS r FROM v)
SELECT p_partkey, c AS prediction, votes / 5 AS share FROM part JOIN b ON p_size = x AND p_retailprice = y WHERE r = 1""")
def _knn(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    df = set_roles(p, discrete=["p_brand"], target="p_brand", metas=["p_partkey"])
    out = Knn(n_neighbors=5).fit(df).transform(df)
    return rounded(out.select("p_partkey", "prediction", F.array_max("probabilities").alias("share")))


def _classify(name, make):
    @query(name)
    def _run(spark, sf):
        df = banded(spark, sf)
        out = make().fit(df).transform(df)
        return out.select("l_orderkey", "l_linenumber", "l_partkey", "prediction", F.transform("probabilities", lambda p: F.round(p, 6)).alias("probabilities"))


def _regress(name, make):
    @query(name)
    def _run(spark, sf):
        df = numbers(spark, sf)
        return rounded(make().fit(df).transform(df).select("o_orderkey", "prediction"))


_classify("logistic_regression", lambda: LogisticRegression(preprocessor=SCALED))
_classify("random_forest", lambda: RandomForest())
_classify("decision_tree", lambda: DecisionTree())
_classify("svm_linear", lambda: Svm(kernel="linear", preprocessor=SCALED))
_classify("svm_rbf", lambda: Svm(kernel="rbf", preprocessor=SCALED))
_classify("svm_poly", lambda: Svm(kernel="poly", preprocessor=SCALED))
_classify("neural_network", lambda: NeuralNetwork())
_classify("adaboost", lambda: AdaBoost())
_classify("sgd_classifier", lambda: Sgd(loss="log_loss"))
_regress("decision_tree_regression", lambda: DecisionTree())
_regress("random_forest_regression", lambda: RandomForest())
_regress("adaboost_regression", lambda: AdaBoost())
_regress("sgd_regressor", lambda: Sgd())
