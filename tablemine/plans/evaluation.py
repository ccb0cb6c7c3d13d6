"""Queries over predictions, resampling, scores, curves, trees and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemine.domain import CLASS, DISCRETE, ColumnSpec, set_roles, stamp
from tablemine.operators.evaluate import (
    confusion_matrix, predict, roc, roc_macro, score_auc, score_classification, score_regression, test_and_score,
)
from tablemine.operators.learners import Constant, DecisionTree, tree_structure
from tablemine.operators.runs import fit_and_log, get_run, list_runs, load_model
from tablemine.plans.models import BASE, banded, numbers
from tablemine.plans.registry import query, rounded, table
from tablemine.session import scratch_path


def _orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority")
    return set_roles(o, discrete=["o_orderpriority"], target="o_orderpriority", metas=["o_orderkey", "o_custkey"])


_MAJORITY = "(SELECT {c} FROM {t} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("predictions", f"""
SELECT o_orderkey, o_orderpriority, {_MAJORITY.format(c='o_orderpriority', t='orders')} AS "Constant",
  {_MAJORITY.format(c='o_orderpriority', t='orders')} AS "Constant (1)" FROM orders""")
def _predictions(spark, sf):
    df = _orders(spark, sf)
    broken = Constant(name="absent").fit(df)
    broken.score = lambda t: t.withColumn("prediction", F.col("no_such_column"))
    out = predict(df, [Constant().fit(df), broken, Constant().fit(df)])
    return out.select("o_orderkey", "o_orderpriority", "Constant", "Constant (1)")


@query("predictions_proba", """
WITH s AS (SELECT round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 6) AS u,
  round(count(*) FILTER (WHERE o_orderpriority = '2-HIGH') / count(*), 6) AS h FROM orders)
SELECT o_orderkey, u AS "Constant (1-URGENT)", h AS "Constant (2-HIGH)" FROM orders, s""")
def _predictions_proba(spark, sf):
    df = _orders(spark, sf)
    out = predict(df, [Constant().fit(df)], probabilities=True)
    return rounded(out.select("o_orderkey", "Constant (1-URGENT)", "Constant (2-HIGH)"))


_ORD = "(SELECT o_orderkey, o_orderpriority AS y, md5('{seed}|' || length(o_orderkey::VARCHAR) || ':' || o_orderkey) AS h FROM orders)"
_PICK = "SELECT fold, y, count(*) AS n, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, y) AS r FROM t GROUP BY fold, y"


@query("eval_kfold", f"""
WITH f AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY h) - 1) % 5)::INT AS k FROM {_ORD.format(seed=42)}),
t AS (SELECT g.fold, f.* FROM f, (SELECT unnest(range(5))::INT AS fold) g WHERE f.k <> g.fold),
best AS ({_PICK})
SELECT 'Constant' AS learner, k AS fold, o_orderkey::VARCHAR AS row_id, f.y AS actual, b.y AS predicted
FROM f JOIN best b ON f.k = b.fold AND b.r = 1""")
def _kfold(spark, sf):
    return test_and_score(_orders(spark, sf), [Constant()], key=["o_orderkey"]).drop("probabilities")


def _split_sql(i: int) -> str:
    return f"""SELECT {i} AS fold, o_orderkey, y, row_number() OVER (PARTITION BY y ORDER BY h) <= ceil(0.75 * count(*) OVER (PARTITION BY y)) AS train
FROM {_ORD.format(seed=42 + i)}"""


@query("eval_shuffle_split", f"""
WITH f AS ({' UNION ALL '.join(_split_sql(i) for i in range(3))}), t AS (SELECT * FROM f WHERE train), best AS ({_PICK})
SELECT 'Constant' AS learner, f.fold, o_orderkey::VARCHAR AS row_id, f.y AS actual, b.y AS predicted
FROM f JOIN best b ON f.fold = b.fold AND b.r = 1 WHERE NOT train""")
def _shuffle(spark, sf):
    return test_and_score(_orders(spark, sf), [Constant()], resampling="shuffle", key=["o_orderkey"]).drop("probabilities")


@query("eval_leave_one_out", """
WITH c AS (SELECT o_orderpriority AS y, count(*) AS n FROM orders GROUP BY 1),
m AS (SELECT a.y, b.y AS p, row_number() OVER (PARTITION BY a.y ORDER BY b.n - (a.y = b.y)::INT DESC, b.y) AS r FROM c a, c b)
SELECT 'Constant' AS learner, 0 AS fold, o_orderkey::VARCHAR AS row_id, o_orderpriority AS actual, p AS predicted
FROM orders JOIN m ON y = o_orderpriority AND r = 1""")
def _leave_one_out(spark, sf):
    return test_and_score(_orders(spark, sf), [Constant()], resampling="leave_one_out", key=["o_orderkey"]).drop("probabilities")


@query("eval_train", f"""
SELECT 'Constant' AS learner, 0 AS fold, o_orderkey::VARCHAR AS row_id, o_orderpriority AS actual,
  {_MAJORITY.format(c='o_orderpriority', t='orders')} AS predicted FROM orders""")
def _train(spark, sf):
    return test_and_score(_orders(spark, sf), [Constant()], resampling="train", key=["o_orderkey"]).drop("probabilities")


@query("eval_test", f"""
SELECT 'Constant' AS learner, 0 AS fold, o_orderkey::VARCHAR AS row_id, o_orderpriority AS actual,
  {_MAJORITY.format(c='o_orderpriority', t="(SELECT * FROM orders WHERE o_orderstatus = 'F')")} AS predicted FROM orders WHERE o_orderstatus <> 'F'""")
def _test(spark, sf):
    status = table(spark, sf, "orders")
    o = status.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    roles = lambda t: set_roles(t.drop("o_orderstatus"), discrete=["o_orderpriority"], target="o_orderpriority", metas=["o_orderkey"])
    train, test = roles(o.where("o_orderstatus = 'F'")), roles(o.where("o_orderstatus <> 'F'"))
    return test_and_score(train, [Constant()], resampling="test", test=test, key=["o_orderkey"]).drop("probabilities")


# --- scores: two rules that guess the return flag from other columns --------------------------------------------

_FLAGS = ("A", "N", "R")
_RESULTS = """(SELECT 'by quantity' AS learner, l_returnflag AS actual, CASE WHEN l_quantity > 33 THEN 'A' WHEN l_quantity > 10 THEN 'N' ELSE 'R' END AS predicted,
  l_quantity / 100 AS pa, (50 - l_quantity) / 100 AS pn, 0.5::DOUBLE AS pr FROM lineitem
UNION ALL SELECT 'by status', l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_discount > 0.05 THEN 'A' ELSE 'N' END,
  CASE WHEN l_linestatus = 'O' THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END, CASE WHEN l_linestatus = 'O' THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END,
  CASE WHEN l_linestatus = 'O' THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END FROM lineitem)"""


def _guesses(spark, sf):
    li = table(spark, sf, "lineitem")
    flag = ColumnSpec("actual", DISCRETE, CLASS, _FLAGS)
    q, old = F.col("l_quantity"), F.col("l_linestatus") != "O"
    quantity = li.select(
        F.lit("by quantity").alias("learner"), stamp(F.col("l_returnflag"), flag),
        F.when(q > 33, "A").when(q > 10, "N").otherwise("R").alias("predicted"),
        F.array(q / 100, (50 - q) / 100, F.lit(0.5)).alias("probabilities"),
    )
    side = F.when(old, 0.4).otherwise(0.1)
    status = li.select(
        F.lit("by status").alias("learner"), stamp(F.col("l_returnflag"), flag),
        F.when(~old, "N").when(F.col("l_discount") > 0.05, "A").otherwise("N").alias("predicted"),
        F.array(side, F.when(old, 0.2).otherwise(0.8), side).alias("probabilities"),
    )
    return quantity.unionByName(status)


_LONG = "(" + " UNION ALL ".join(
    f"SELECT learner, '{c}' AS cls, {p} AS s, (actual = '{c}')::INT AS pos FROM {_RESULTS}" for c, p in zip(_FLAGS, ("pa", "pn", "pr"))) + ")"
_AUC = f"""auc AS (SELECT learner, sum(a * p) / sum(p) AS auc FROM
(SELECT learner, cls, sum(pos) AS p, (sum(CASE WHEN pos = 1 THEN r END) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(1 - pos)) AS a FROM
 (SELECT *, rank() OVER (PARTITION BY learner, cls ORDER BY s) + (count(*) OVER (PARTITION BY learner, cls, s) - 1) / 2 AS r FROM {_LONG})
 GROUP BY learner, cls) GROUP BY learner)"""


@query("score_auc", f"WITH {_AUC} SELECT learner, round(auc, 6) AS \"AUC\" FROM auc")
def _auc(spark, sf):
    return rounded(score_auc(_guesses(spark, sf)))


@query("score_classification", f"""
WITH c AS (SELECT learner, cls, count(*) FILTER (WHERE actual = cls) AS sup, count(*) FILTER (WHERE predicted = cls) AS cl,
  count(*) FILTER (WHERE actual = cls AND predicted = cls) AS tp FROM {_RESULTS}, (VALUES ('A'), ('N'), ('R')) v(cls) GROUP BY learner, cls),
m AS (SELECT learner, sum(tp) / sum(sup) AS ca, sum(sup * 2 * tp / (sup + cl)) / sum(sup) AS f1,
  sum(CASE WHEN cl > 0 THEN sup * tp / cl ELSE 0 END) / sum(sup) AS pr, sum(tp) / sum(sup) AS re FROM c GROUP BY learner), {_AUC}
SELECT learner, round(ca, 6) AS "CA", round(f1, 6) AS "F1", round(auc, 6) AS "AUC", round(pr, 6) AS "Precision", round(re, 6) AS "Recall"
FROM m JOIN auc USING (learner)""")
def _classification(spark, sf):
    return rounded(score_classification(_guesses(spark, sf)))


@query("score_regression", """
WITH r AS (SELECT 'half' AS learner, o_totalprice / 1000 AS a, o_totalprice / 2000 AS p FROM orders
UNION ALL SELECT 'root', o_totalprice / 1000, sqrt(o_totalprice) / 3 FROM orders)
SELECT learner, round(sqrt(avg((a - p) * (a - p))), 6) AS "RMSE", round(avg(abs(a - p)), 6) AS "MAE",
  round(1 - avg((a - p) * (a - p)) / var_pop(a), 6) AS "R2" FROM r GROUP BY learner""")
def _regression(spark, sf):
    o = table(spark, sf, "orders")
    actual = (F.col("o_totalprice") / 1000).alias("actual")
    half = o.select(F.lit("half").alias("learner"), actual, (F.col("o_totalprice") / 2000).alias("predicted"))
    root = o.select(F.lit("root").alias("learner"), actual, (F.sqrt("o_totalprice") / 3).alias("predicted"))
    return rounded(score_regression(half.unionByName(root)))


_CELLS = f"""(SELECT l.learner, a.c AS actual, p.c AS predicted, count(r.learner) AS n FROM (VALUES ('by quantity'), ('by status')) l(learner),
(VALUES ('A'), ('N'), ('R')) a(c), (VALUES ('A'), ('N'), ('R')) p(c)
LEFT JOIN {_RESULTS} r ON r.learner = l.learner AND r.actual = a.c AND r.predicted = p.c GROUP BY ALL)"""


@query("confusion_matrix", f"SELECT learner, actual, predicted, n AS count FROM {_CELLS}")
def _confusion(spark, sf):
    return confusion_matrix(_guesses(spark, sf))


@query("confusion_proportion", f"SELECT learner, actual, predicted, round(n / sum(n) OVER (PARTITION BY learner, actual), 6) AS proportion FROM {_CELLS}")
def _proportion(spark, sf):
    return rounded(confusion_matrix(_guesses(spark, sf), proportion=True))


_SHARP = """(SELECT 'by price' AS learner, l_returnflag AS actual, l_extendedprice / 100000 AS pa, 1 - l_extendedprice / 100000 AS pn,
  l_discount AS pr FROM lineitem)"""
_SHARP_LONG = "(" + " UNION ALL ".join(
    f"SELECT learner, '{c}' AS cls, {p} AS s, (actual = '{c}')::INT AS pos FROM {_SHARP}" for c, p in zip(_FLAGS, ("pa", "pn", "pr"))) + ")"
_CURVE = f"""
g AS (SELECT learner, cls, s, count(*) AS n, sum(pos) AS p FROM {_SHARP_LONG} GROUP BY ALL),
w AS (SELECT learner, cls, row_number() OVER o AS place, count(*) OVER (PARTITION BY learner, cls) + 1 AS size,
  sum(n - p) OVER o / sum(n - p) OVER (PARTITION BY learner, cls) AS fpr, sum(p) OVER o / sum(p) OVER (PARTITION BY learner, cls) AS tpr
  FROM g WINDOW o AS (PARTITION BY learner, cls ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
z AS (SELECT * FROM w UNION ALL SELECT DISTINCT learner, cls, 0, size, 0, 0 FROM w),
r AS (SELECT learner, cls, i.i::INT AS i, fpr, tpr FROM z, (SELECT unnest(range(200)) AS i) i
  WHERE (size > 200 AND place = floor(i.i * (size - 1) / 199)) OR (size <= 200 AND place = i.i))"""


def _sharp(spark, sf):
    price = F.col("l_extendedprice") / 100000
    return table(spark, sf, "lineitem").select(
        F.lit("by price").alias("learner"), stamp(F.col("l_returnflag"), ColumnSpec("actual", DISCRETE, CLASS, _FLAGS)),
        F.array(price, 1 - price, F.col("l_discount")).alias("probabilities"),
    )


@query("roc_curve", f"WITH {_CURVE} SELECT learner, cls, i, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM r")
def _roc(spark, sf):
    return rounded(roc(_sharp(spark, sf)))


@query("roc_macro", f"""
WITH {_CURVE},
k AS (SELECT learner, cls, fpr, tpr, lead(fpr) OVER o AS nf, lead(tpr) OVER o AS nt FROM z WINDOW o AS (PARTITION BY learner, cls ORDER BY fpr, tpr)),
m AS (SELECT learner, cls, q.g / 100 AS x, tpr, nt, fpr, nf FROM k, (SELECT unnest(range(101)) AS g) q
  WHERE fpr <= q.g / 100 AND (nf > q.g / 100 OR nf IS NULL))
SELECT learner, x AS fpr, round(avg(CASE WHEN nf IS NULL THEN tpr ELSE tpr + (nt - tpr) / (nf - fpr) * (x - fpr) END), 6) AS tpr
FROM m GROUP BY learner, x""")
def _macro(spark, sf):
    return rounded(roc_macro(_sharp(spark, sf)))


@query("tree_structure")
def _tree(spark, sf):
    return rounded(tree_structure(DecisionTree(max_depth=3).fit(banded(spark, sf))))


# --- runs -------------------------------------------------------------------------------------------------------


def _log_three(spark, sf):
    path = scratch_path(spark, "runs")
    o, b, n = _orders(spark, sf), banded(spark, sf), numbers(spark, sf)
    ids = {}
    for name, df, tag in (("priority", o, "first"), ("band", b, "second"), ("root", n, "second")):
        ids[name] = fit_and_log(spark, path, Constant(name=name), df, params={"learner": name, "skip": None}, tag=tag)[1]
    return path, ids


_CA = "(SELECT round(max(n) / sum(n), 4) FROM (SELECT count(*) AS n FROM {t} GROUP BY {c}))"
_RUNS = f"""(SELECT 'priority' AS name, 'first' AS tag, (SELECT count(*) FROM orders) AS data_rows, 'train_CA' AS metric,
  {_CA.format(t='orders', c='o_orderpriority')} AS value
UNION ALL SELECT 'band', 'second', (SELECT count(*) FROM lineitem), 'train_CA', {_CA.format(t=BASE, c='band')}
UNION ALL SELECT 'root', 'second', (SELECT count(*) FROM orders), 'train_RMSE', (SELECT round(stddev_pop(sqrt(o_totalprice)), 4) FROM orders))"""


def _shown(runs):
    metric = F.when(F.col("metrics")["train_CA"].isNotNull(), "train_CA").otherwise("train_RMSE")
    return rounded(runs.select(
        "name", "tag", "data_rows", metric.alias("metric"), F.col("metrics")[metric].alias("value"), "status", F.to_json("params").alias("params")
    ), 4)


_SHOW = "SELECT name, tag, data_rows, metric, value, 'FINISHED' AS status, '{\"learner\":\"' || name || '\"}' AS params FROM " + _RUNS


@query("run_log", _SHOW)
def _run_log(spark, sf):
    path, _ = _log_three(spark, sf)
    return _shown(list_runs(spark, path))


@query("run_list", f"{_SHOW} WHERE tag = 'second'")
def _run_list(spark, sf):
    path, _ = _log_three(spark, sf)
    return _shown(list_runs(spark, path, tag="second"))


@query("run_get", f"{_SHOW} WHERE name = 'priority'")
def _run_get(spark, sf):
    path, ids = _log_three(spark, sf)
    return _shown(get_run(spark, path, ids["priority"]))


@query("run_load_model", f"""
SELECT o_orderkey, {_MAJORITY.format(c='o_orderpriority', t='orders')} AS prediction FROM orders""")
def _run_load(spark, sf):
    path, ids = _log_three(spark, sf)
    return load_model(spark, path, ids["priority"]).transform(_orders(spark, sf)).select("o_orderkey", "prediction")
