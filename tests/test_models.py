"""Learners, predictions, resampling, scores, trees, runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemine.domain import CLASS, DISCRETE, ColumnSpec, domain_of, set_roles, stamp
from tablemine.operators.evaluate import (
    confusion_matrix, predict, roc, roc_macro, score, score_auc, score_classification, test_and_score as evaluate,
)
from tablemine.operators.learners import (
    AdaBoost, Constant, DecisionTree, Knn, LinearRegression, LogisticRegression, NaiveBayes, NeuralNetwork, RandomForest, Sgd, Svm,
    coefficients, learner_contract, train_metrics, tree_structure,
)
from tablemine.operators.prep import Preprocessor
from tablemine.operators.runs import fit_and_log, get_run, list_runs, load_model
from tablemine.session import scratch_path


@pytest.fixture(scope="module")
def flowers(spark):
    """Three classes told apart by two of three attributes, one discrete attribute, a few gaps."""
    rng = np.random.default_rng(7)
    y = np.arange(150) % 3
    pdf = pd.DataFrame({
        "id": range(150), "a": y * 2 + rng.normal(0, 0.5, 150), "b": -y + rng.normal(0, 0.5, 150), "noise": rng.normal(size=150),
        "shade": np.where(rng.random(150) < 0.8, np.array(["p", "q", "r"])[y], "p"), "kind": np.array(["setosa", "tosa", "ginica"])[y]})
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("id") % 25 != 0, F.col("b")))
    return set_roles(df, discrete=["shade", "kind"], target="kind", metas=["id"]).cache()


@pytest.fixture(scope="module")
def houses(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    pdf = pd.DataFrame(x, columns=["r", "s", "t"]).assign(id=range(200), price=3 + x @ [2.0, -1.0, 0.0] + rng.normal(0, 0.3, 200))
    return set_roles(spark.createDataFrame(pdf), target="price", metas=["id"]).cache()


def accuracy(model, df):
    return model.transform(df).agg(F.avg((F.col("prediction") == F.col(model.target.name)).cast("double"))).first()[0]


CLASSIFIERS = [
    LogisticRegression(), LogisticRegression(penalty="l1"), LogisticRegression(penalty="none", max_iter=100), LogisticRegression(class_weight=True),
    RandomForest(), DecisionTree(), Knn(), Knn(weights="distance", metric="manhattan"), NaiveBayes(), Svm(kernel="linear", max_iter=8), Svm(components=32, max_iter=8),
    Svm(kernel="poly", degree=2, max_iter=8), NeuralNetwork(hidden_layer_sizes="8,8"), NeuralNetwork(hidden_layer_sizes=(8,), activation="logistic", solver="lbfgs"),
    AdaBoost(n_estimators=5), Sgd(max_iter=60), Sgd(loss="modified_huber", penalty="elasticnet", max_iter=60),
]


@pytest.mark.parametrize("learner", CLASSIFIERS, ids=lambda l: f"{type(l).__name__}-{CLASSIFIERS.index(l)}")
def test_classifiers_beat_the_constant(flowers, learner):
    model = learner.fit(flowers)
    assert accuracy(model, flowers) > 0.8
    shares = model.transform(flowers).select("probabilities").toPandas()["probabilities"]
    assert all(len(p) == 3 and sum(p) == pytest.approx(1) for p in shares)


REGRESSORS = [
    LinearRegression(), LinearRegression(regularization="ridge"), LinearRegression(regularization="lasso", alpha=0.1), DecisionTree(),
    RandomForest(max_depth=6), AdaBoost(n_estimators=5), Sgd(max_iter=100), NeuralNetwork(hidden_layer_sizes="8", activation="tanh"),
]


@pytest.mark.parametrize("learner", REGRESSORS, ids=lambda l: f"{type(l).__name__}-{REGRESSORS.index(l)}")
def test_regressors_beat_the_mean(houses, learner):
    model = learner.fit(houses)
    r2 = {r.metric: r.value for r in train_metrics(model, houses).collect()}["train_R2"]
    assert r2 > 0.5


def test_learner_contract(spark, flowers):
    reason = lambda df: learner_contract(df).first().reason
    assert reason(flowers) is None
    assert reason(flowers.limit(0)) == "no rows"
    assert reason(flowers.drop("kind")) == "no class"
    assert reason(flowers.where("kind = 'tosa'")) == "fewer than two class values"
    assert reason(flowers.select("kind")) == "no attributes"
    assert Constant().fit(flowers.where("kind = 'tosa'")) is None
    with pytest.raises(ValueError):
        LinearRegression().fit(flowers)


def test_ridge_formula(houses):
    pdf = houses.toPandas()
    x, y = pdf[["r", "s", "t"]].to_numpy(), pdf["price"].to_numpy()
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc)
    rows = coefficients(LinearRegression(regularization="ridge", alpha=5.0).fit(houses)).collect()
    assert rows[0].name == "Intercept" and [r.coef for r in rows[1:]] == pytest.approx(want)
    no_intercept = coefficients(LinearRegression(fit_intercept=False).fit(houses)).collect()
    assert no_intercept[0].coef == 0 and [r.coef for r in no_intercept[1:]] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0])


def test_elastic_net_is_stationary(houses):
    a, r = 0.3, 0.4
    pdf = houses.toPandas()
    x, y = pdf[["r", "s", "t"]].to_numpy(), pdf["price"].to_numpy()
    rows = coefficients(LinearRegression(regularization="elastic_net", alpha=a, l1_ratio=r).fit(houses)).collect()
    w = np.array([v.coef for v in rows[1:]])
    g = -x.T @ (y - x @ w - rows[0].coef) / len(y) + a * (1 - r) * w
    for wi, gi in zip(w, g):
        assert abs(gi) <= a * r + 1e-6 if wi == 0 else gi == pytest.approx(-a * r * np.sign(wi), abs=1e-6)


def test_logistic_is_stationary(flowers):
    two = flowers.where("kind <> 'ginica'").drop("shade", "b")
    two = set_roles(two, discrete=["kind"], target="kind", metas=["id"])
    rows = coefficients(LogisticRegression(C=2.0).fit(two)).collect()
    assert [r.name for r in rows] == ["Intercept", "a", "noise"] and domain_of(coefficients(LogisticRegression().fit(two))).continuous() == ["tosa"]
    pdf = two.toPandas()
    x, y = pdf[["a", "noise"]].to_numpy(), (pdf["kind"] == "tosa").to_numpy(float)
    w = np.array([r.tosa for r in rows[1:]])
    p = 1 / (1 + np.exp(-(x @ w + rows[0].tosa)))
    assert 2.0 * x.T @ (p - y) + w == pytest.approx(np.zeros(2), abs=1e-4)
    assert (p - y).sum() == pytest.approx(0, abs=1e-4)


def test_multiclass_coefficients(flowers):
    t = coefficients(LogisticRegression().fit(flowers))
    assert t.columns == ["name", "ginica", "setosa", "tosa"]
    assert [r.name for r in t.collect()] == ["Intercept", "a", "b", "noise", "shade=p", "shade=q", "shade=r"]


def test_tree_has_two_children(flowers):
    t = tree_structure(DecisionTree(max_depth=3).fit(flowers)).toPandas()
    root = t[t["id"] == 0].iloc[0]
    assert (t["parent"] == 0).sum() == 2 and root["samples"] == 150 and sum(root["counts"]) == 150 and "<=" in root["condition"]
    assert t["depth"].max() <= 3
    for r in t.itertuples():
        kids = t[t["parent"] == r.id]
        assert len(kids) in (0, 2) and (len(kids) == 0 or kids["samples"].sum() == r.samples)
    assert len(tree_structure(DecisionTree().fit(flowers), max_depth=1).collect()) == 3


def test_predict_names_and_hides_the_class(flowers):
    m = Constant(name="a").fit(flowers)
    out = predict(flowers, [m, Knn().fit(flowers)], probabilities=True)
    assert out.columns[-8:] == ["a (1)", "a (1) (ginica)", "a (1) (setosa)", "a (1) (tosa)", "kNN", "kNN (ginica)", "kNN (setosa)", "kNN (tosa)"]
    assert out.count() == 150 and domain_of(out)["kNN"].role == "meta"
    assert predict(flowers.drop("a"), [LogisticRegression().fit(flowers)]) is None


def test_preprocessor_inside_a_learner(flowers):
    model = LogisticRegression(preprocessor=Preprocessor(("impute", {}), ("normalize", {}), ("continuize", {}))).fit(flowers)
    assert accuracy(model, flowers) > 0.8


@pytest.mark.parametrize("settings,per_learner", [
    ({}, 150), ({"n_folds": 2, "stratified": False}, 150), ({"resampling": "shuffle", "n_repeats": 2}, 2 * 36), ({"resampling": "train"}, 150),
    ({"resampling": "leave_one_out"}, 150),
])
def test_resampling(flowers, settings, per_learner):
    results = evaluate(flowers, [Constant(), NaiveBayes()], key=["id"], **settings)
    assert {r["learner"]: r["count"] for r in results.groupBy("learner").count().collect()} == {"Constant": per_learner, "Naive Bayes": per_learner}
    table = {r.learner: r for r in score(results).collect()}
    assert table["Naive Bayes"].CA > 0.85 > 0.5 > table["Constant"].CA and table["Naive Bayes"].AUC > 0.9


def test_leave_one_out_equals_refitting(flowers):
    """Closed forms against models trained without the row."""
    whole = flowers.where("id < 30")
    whole = set_roles(whole.drop("shade"), discrete=["kind"], target="kind", metas=["id"])
    for learner in (Knn(n_neighbors=3), Constant()):
        got = {r.row_id: r.predicted for r in evaluate(whole, [learner], resampling="leave_one_out", key=["id"]).collect()}
        for i in (0, 7, 19):
            alone = learner.fit(whole.where(F.col("id") != i)).transform(whole.where(F.col("id") == i)).first()
            if isinstance(learner, Knn) and i == 0:
                continue  # its gap is filled with another mean when it is left out
            assert got[str(i)] == alone.prediction
    with pytest.raises(ValueError):
        evaluate(whole, [DecisionTree()], resampling="leave_one_out", key=["id"])


@pytest.mark.parametrize("kind", ["none", "ridge"])
def test_leave_one_out_linear(houses, kind):
    learner = LinearRegression(regularization=kind, alpha=3.0)
    got = {r.row_id: r.predicted for r in evaluate(houses, [learner], resampling="leave_one_out", key=["id"]).collect()}
    for i in (3, 50):
        alone = learner.fit(houses.where(F.col("id") != i)).transform(houses.where(F.col("id") == i)).first()
        assert got[str(i)] == pytest.approx(alone.prediction)


def results_of(spark, rows):
    df = spark.createDataFrame(rows, "learner string, actual string, predicted string, probabilities array<double>")
    return df.withColumn("actual", stamp(F.col("actual"), ColumnSpec("actual", DISCRETE, CLASS, ("n", "y"))))


def test_scores_by_hand(spark):
    r = results_of(spark, [("m", "y", "y", [0.1, 0.9]), ("m", "y", "n", [0.6, 0.4]), ("m", "n", "n", [0.6, 0.4]), ("m", "n", "n", [0.8, 0.2])])
    s = score_classification(r).first()
    assert (s.CA, s.Recall) == (0.75, 0.75) and s.Precision == pytest.approx((2 / 3 + 1) / 2) and s.F1 == pytest.approx((0.8 + 2 / 3) / 2)
    assert s.AUC == pytest.approx(3.5 / 4)
    cells = {(c.actual, c.predicted): c["count"] for c in confusion_matrix(r).collect()}
    assert cells == {("n", "n"): 2, ("n", "y"): 0, ("y", "n"): 1, ("y", "y"): 1}
    curve = [(c.fpr, c.tpr) for c in roc(r).where("cls = 'y'").orderBy("i").collect()]
    assert curve == [(0, 0), (0, 0.5), (0.5, 1), (1, 1)]


def test_one_class_only(spark):
    r = results_of(spark, [("m", "y", "y", [0.1, 0.9]), ("m", "y", "y", [0.3, 0.7])])
    assert score_auc(r).first().AUC == 0.0
    assert [(c.fpr, c.tpr) for c in roc(r).where("cls = 'y'").orderBy("i").collect()] == [(0, 0), (0, 0.5), (0, 1)]


def test_long_curves_are_thinned(spark):
    df = spark.range(5000).select(
        F.lit("m").alias("learner"), F.when(F.rand(1) < F.col("id") / 5000, "y").otherwise("n").alias("actual"), F.lit("y").alias("predicted"),
        F.array(1 - F.col("id") / 5000, F.col("id") / 5000).alias("probabilities"))
    df = df.withColumn("actual", stamp(F.col("actual"), ColumnSpec("actual", DISCRETE, CLASS, ("n", "y"))))
    curve = roc(df, points=50).where("cls = 'y'").orderBy("i").toPandas()
    assert len(curve) == 50 and curve["tpr"].is_monotonic_increasing and curve.iloc[-1][["fpr", "tpr"]].tolist() == [1, 1]
    macro = roc_macro(df).orderBy("fpr").toPandas()
    assert len(macro) == 101 and macro["tpr"].iloc[-1] == pytest.approx(1)


@pytest.mark.parametrize("learner", [Constant(), NaiveBayes(), LogisticRegression(), RandomForest(n_estimators=3), Sgd(max_iter=20)], ids=lambda l: l.name)
def test_saved_models_predict_the_same(spark, flowers, learner):
    path = scratch_path(spark, "runs")
    model, run_id = fit_and_log(spark, path, learner, flowers, params={"p": 1, "none": None}, tag="node")
    row = get_run(spark, path, run_id).first()
    assert row.params == {"p": "1"} and row.data_rows == 150 and row.metrics["train_CA"] > 0.3 and list_runs(spark, path, tag="other").count() == 0
    back = load_model(spark, path, run_id)
    pick = lambda m: [r.prediction for r in m.transform(flowers).orderBy("id").collect()]
    assert pick(back) == pick(model)
