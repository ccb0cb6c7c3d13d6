"""Predictions, resampling, scores, confusion matrices, ROC curves."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablemine.domain import CLASS, DISCRETE, META, ColumnSpec, col, discrete_values, domain_of, finite, stamp
from tablemine.functions.ordering import cumulative
from tablemine.operators.learners.base import PREDICTION, PROBABILITIES, Design, Learner, Model, class_code, unique_name
from tablemine.operators.learners.linear import LinearRegression
from tablemine.operators.learners.simple import Constant, Knn, NaiveBayes, NaiveBayesModel, vote, with_softmax
from tablemine.operators.sampling import sample, with_fold
from tablemine.session import cut

#: Points of the common false-positive grid of the macro curve.
MACRO_GRID = 100


# --- predictions ------------------------------------------------------------------------------------------------


def predict(df: DataFrame, models: Sequence[Model], *, probabilities: bool = False) -> DataFrame | None:
    """The table with one meta per model holding its prediction; with ``probabilities`` also one column per class,
    ``model (class)``. The class is hidden from the models. Models whose attributes are absent are skipped."""
    domain = domain_of(df)
    hidden = {c.name: f"_hidden_{i}" for i, c in enumerate(domain.class_vars)}
    out = df.withColumnsRenamed(hidden)
    taken, added = list(df.columns), []
    for m in models:
        base = [c for c in out.columns]
        try:
            scored = m.transform(out)
            scored.schema  # analysis fails here if an attribute is absent
        except Exception as failure:
            if "UNRESOLVED_COLUMN" in str(failure) or isinstance(failure, KeyError):
                continue
            raise
        name = unique_name(taken, m.name)
        taken.append(name)
        values = tuple(m.classes) if m.classes is not None else ()
        spec = ColumnSpec(name, DISCRETE if m.classes is not None else "continuous", META, values)
        columns = [stamp(F.col(PREDICTION), spec)]
        added.append(name)
        if probabilities and m.classes is not None:
            for i, c in enumerate(m.classes):
                each = unique_name(taken, f"{name} ({c})")
                taken.append(each)
                added.append(each)
                columns.append(stamp(F.get(PROBABILITIES, F.lit(i)), ColumnSpec(each, "continuous", META)))
        kept = [col(c) for c in base] if m.prepare is None else [col(c) for c in base if c in scored.columns]
        out = scored.select(*kept, *columns)
    if not added:
        return None
    back = {v: k for k, v in hidden.items()}
    out = out.withColumnsRenamed(back)
    return out.select(*[col(c) for c in df.columns if c in out.columns], *[col(c) for c in added])


# --- resampling -------------------------------------------------------------------------------------------------


def _results(scored: DataFrame, model_name: str, target: ColumnSpec, classes, fold: Column, key: Sequence[str]) -> DataFrame:
    row = F.concat_ws("|", *[col(k).cast("string") for k in key]).alias("row_id")
    if classes is None:
        return scored.select(
            F.lit(model_name).alias("learner"), fold.cast("int").alias("fold"), row,
            stamp(finite(col(target.name)), ColumnSpec("actual", target.var_type, CLASS)), F.col(PREDICTION).alias("predicted"),
        )
    spec = ColumnSpec("actual", DISCRETE, CLASS, tuple(classes))
    return scored.select(
        F.lit(model_name).alias("learner"), fold.cast("int").alias("fold"), row, stamp(col(target.name).cast("string"), spec),
        F.col(PREDICTION).alias("predicted"), F.col(PROBABILITIES).alias("probabilities"),
    )


def _with_classes(df: DataFrame) -> DataFrame:
    """Declare the class values once, so every fold uses the same class order."""
    target = domain_of(df).class_var
    if target is None or target.var_type != DISCRETE or target.values:
        return df
    values = tuple(discrete_values(df, [target.name])[target.name])
    return df.withMetadata(target.name, replace(target, values=values).metadata())


def test_and_score(
    df: DataFrame,
    learners: Sequence[Learner],
    *,
    resampling: str = "kfold",
    n_folds: int = 5,
    n_repeats: int = 3,
    train_pct: float = 75,
    stratified: bool = True,
    test: DataFrame | None = None,
    seed: int = 42,
    key: Sequence[str],
) -> DataFrame | None:
    """Long results: learner, fold, row_id, actual, predicted, probabilities (classes only).

    ``resampling``: kfold, shuffle (``n_repeats`` splits), leave_one_out (closed forms only), train, test.
    Fold columns are computed once and written to the shared folder; learner x fold fits run as separate Spark jobs.
    """
    df = _with_classes(df)
    target = domain_of(df).class_var
    if target is None or not learners or (resampling == "test" and test is None):
        return None
    by = target.name if stratified and target.var_type == DISCRETE else None
    parts = []

    def run(learner: Learner, train: DataFrame, held: DataFrame, fold: int):
        model = learner.fit(train)
        if model is not None:
            parts.append(_results(model.transform(held), learner.name, target, model.classes, F.lit(fold), key))

    if resampling == "kfold":
        folded = _cut_with_roles(with_fold(df, n_folds, stratify=by, seed=seed, key=key, name="_fold"), df)
        for learner in learners:
            for f in range(n_folds):
                run(learner, folded.where(F.col("_fold") != f).drop("_fold"), folded.where(F.col("_fold") == f).drop("_fold"), f)
    elif resampling == "shuffle":
        for i in range(n_repeats):
            train, held = sample(df, pct=train_pct, stratify=by, seed=seed + i, key=key)
            both = train.withColumn("_fold", F.lit(0)).unionByName(held.withColumn("_fold", F.lit(1)))
            split = _cut_with_roles(both, df)
            for learner in learners:
                run(learner, split.where("_fold = 0").drop("_fold"), split.where("_fold = 1").drop("_fold"), i)
    elif resampling == "leave_one_out":
        parts = [_leave_one_out(df, learner, target, key) for learner in learners]
    elif resampling == "train":
        for learner in learners:
            run(learner, df, df, 0)
    elif resampling == "test":
        for learner in learners:
            run(learner, df, test, 0)
    else:
        raise ValueError(f"unknown resampling {resampling!r}")
    return reduce(DataFrame.unionByName, parts) if parts else None


def _cut_with_roles(folded: DataFrame, like: DataFrame) -> DataFrame:
    """A checkpoint keeps values; put the column metadata back on top."""
    done = cut(folded)
    specs = domain_of(like).columns
    return done.select(*[stamp(col(s.name), s) for s in specs], "_fold")


def _leave_one_out(df: DataFrame, learner: Learner, target: ColumnSpec, key: Sequence[str]) -> DataFrame:
    """Predictions of each row by the model of all other rows, without refitting."""
    if learner.preprocessor is not None:
        raise ValueError("leave-one-out has no closed form with a preprocessor")
    known = df.where(col(target.name).isNotNull())
    model = learner.train(known)
    if isinstance(learner, Constant):
        scored = _loo_constant(known, model, target)
    elif isinstance(learner, NaiveBayes):
        scored = _loo_naive_bayes(known, model, target)
    elif isinstance(learner, Knn):
        scored = _loo_knn(known, model, target)
    elif isinstance(learner, LinearRegression) and learner.regularization in ("none", "ridge"):
        scored = _loo_linear(known, learner, target)
    else:
        raise ValueError(f"leave-one-out for {learner.name} would refit once per row; use kfold")
    return _results(scored, learner.name, target, model.classes, F.lit(0), key)


def _loo_constant(df: DataFrame, model, target: ColumnSpec) -> DataFrame:
    if model.classes is None:
        s = df.agg(F.sum(finite(col(target.name))).alias("s"), F.count(F.lit(1)).alias("n")).first()
        return df.withColumn(PREDICTION, (F.lit(s.s) - finite(col(target.name))) / F.lit(s.n - 1))
    counts = {r.c: r.n for r in df.groupBy(col(target.name).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values()) - 1
    y = col(target.name).cast("string")
    shares = F.array(*[(F.lit(counts.get(c, 0)) - (y == c).cast("int")) / F.lit(total) for c in model.classes])
    scored = df.withColumn(PROBABILITIES, shares)
    return scored.withColumn(PREDICTION, model.label_of_best(F.col(PROBABILITIES)))


def _loo_naive_bayes(df: DataFrame, model: NaiveBayesModel, target: ColumnSpec) -> DataFrame:
    """Subtract the row from the counts behind its own class: only those logarithms change."""
    y = col(target.name).cast("string")
    counts = {r.c: r.n for r in df.groupBy(y.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    k, n = len(model.classes), sum(counts.values())
    binned, position_of = model.with_bins(df)
    scores = []
    for c in model.classes:
        size = counts.get(c, 0)
        own = (y == c).cast("int")
        total = F.log((F.lit(size) - own + 1) / F.lit(n - 1 + k))
        for f, position in position_of.items():
            counted = model.counts[f][c]
            here = F.get(F.array(*[F.lit(float(x)) for x in counted]), position)
            share = (here - own + 1) / (F.lit(float(sum(counted))) - own + F.lit(float(len(counted))))
            total = total + F.coalesce(F.log(share), F.lit(0.0))
        scores.append(total)
    scored = with_softmax(binned, scores)
    return scored.withColumn(PREDICTION, model.label_of_best(F.col(PROBABILITIES)))


def _loo_knn(df: DataFrame, model, target: ColumnSpec) -> DataFrame:
    keyed = df.withColumn("_v", model.design.values).withColumn("_label", class_code(target.name, model.classes).cast("int"))
    votes = vote(model.neighbours(model.points.select("v", "label"), exclude_self=True), model.classes, model.settings["weights"])
    joined = keyed.join(votes.select(F.col("v").alias("_v"), F.col("label").alias("_label"), PROBABILITIES), ["_v", "_label"])
    return joined.withColumn(PREDICTION, model.label_of_best(F.col(PROBABILITIES)))


def _loo_linear(df: DataFrame, learner: LinearRegression, target: ColumnSpec) -> DataFrame:
    """Least squares and ridge by hat values: y - (y - fitted) / (1 - h), from one aggregate of cross products."""
    design = Design.fit(df)
    width = len(design.feature_names) + learner.fit_intercept
    data = df.withColumn("_x", F.concat(design.values, F.array(F.lit(1.0))) if learner.fit_intercept else design.values)
    y, x = finite(col(target.name)), lambda i: F.get("_x", F.lit(i))
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = data.agg(*[F.sum(x(i) * x(j)) for i, j in pairs], *[F.sum(x(i) * y) for i in range(width)]).first()
    gram = np.zeros((width, width))
    for (i, j), s in zip(pairs, sums):
        gram[i, j] = gram[j, i] = s
    if learner.regularization == "ridge":
        # The intercept, the last column, is not penalised.
        gram += learner.alpha * np.diag([1.0] * (width - learner.fit_intercept) + [0.0] * learner.fit_intercept)
    inverse = np.linalg.pinv(gram)
    beta = inverse @ np.array(sums[len(pairs) :])
    fitted = reduce(Column.__add__, [x(i) * F.lit(float(beta[i])) for i in range(width)])
    hat = reduce(Column.__add__, [x(i) * x(j) * F.lit(float(inverse[i, j] * (1 if i == j else 2))) for i, j in pairs])
    return data.withColumn(PREDICTION, y - (y - fitted) / (1 - hat)).drop("_x")


# --- scores -----------------------------------------------------------------------------------------------------


def classes_of(results: DataFrame) -> list[str]:
    """Class order: the declared values of ``actual``, else the sorted values seen."""
    return discrete_values(results, ["actual"])["actual"]


def confusion_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("learner", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def score_classification(results: DataFrame) -> DataFrame:
    """learner, CA, F1, AUC, Precision, Recall; all but CA are class means weighted by class frequency; 0 / 0 is 0.

    Everything but AUC comes from the confusion counts.
    """
    counts = confusion_counts(results)
    cells = counts.select(
        "learner", "n",
        F.inline(F.array(
            F.struct(F.col("actual").alias("cls"), F.lit(1).alias("is_actual"), F.lit(0).alias("is_predicted")),
            F.struct(F.col("predicted").alias("cls"), F.lit(0).alias("is_actual"), F.lit(1).alias("is_predicted")),
        )),
        (F.col("actual") == F.col("predicted")).alias("hit"),
    )
    per_class = cells.groupBy("learner", "cls").agg(
        F.sum(F.col("n") * F.col("is_actual")).alias("support"),
        F.sum(F.col("n") * F.col("is_predicted")).alias("claimed"),
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("is_actual")).otherwise(0)).alias("tp"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    p, r = ratio("tp", "claimed"), ratio("tp", "support")
    scored = per_class.select(
        "learner", "support", "tp", p.alias("p"), r.alias("r"),
        F.when(F.col("support") + F.col("claimed") > 0, 2 * F.col("tp") / (F.col("support") + F.col("claimed"))).otherwise(0.0).alias("f"),
    )
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    table = scored.groupBy("learner").agg(
        (F.sum("tp") / F.sum("support")).alias("CA"), weighted("f").alias("F1"),
        weighted("p").alias("Precision"), weighted("r").alias("Recall"),
    )
    return table.join(score_auc(results), "learner").select("learner", "CA", "F1", "AUC", "Precision", "Recall")


def _curves(results: DataFrame) -> int:
    """Number of curves: classes times learners, counted on the one column that names them."""
    return results.select("learner").distinct().count() * len(classes_of(results))


def class_scores(results: DataFrame) -> DataFrame:
    """learner, cls, score, positive: one row per row and class."""
    classes = classes_of(results)
    each = F.array(*[F.struct(F.lit(c).alias("cls"), F.get("probabilities", F.lit(i)).alias("score")) for i, c in enumerate(classes)])
    long = results.select("learner", "actual", F.inline(each))
    return long.select("learner", "cls", "score", (F.col("actual") == F.col("cls")).cast("long").alias("positive"))


def score_auc(results: DataFrame) -> DataFrame:
    """learner, AUC: one-vs-rest areas weighted by class frequency.

    The area is the share of (positive, negative) pairs in the right order, ties half, from running counts over the
    distinct scores.
    """
    run = cumulative(
        class_scores(results), "score", by=["learner", "cls"], sums={"n": F.count(F.lit(1)), "pos": F.sum("positive")},
        groups=_curves(results),
    )
    negative, before = F.col("n") - F.col("pos"), F.col("n_before") - F.col("pos_before")
    area = run.groupBy("learner", "cls").agg(
        F.sum(F.col("pos") * (before + negative / 2)).alias("wins"), F.sum("pos").alias("p"), F.sum(negative).alias("q")
    )
    auc = F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("wins") / (F.col("p") * F.col("q")))
    scored = area.select("learner", auc.alias("a"), F.when(auc.isNotNull(), F.col("p")).otherwise(0).alias("w"))
    return scored.groupBy("learner").agg(F.coalesce(F.sum(F.col("a") * F.col("w")) / F.sum("w"), F.lit(0.0)).alias("AUC"))


def score_regression(results: DataFrame) -> DataFrame:
    """learner, RMSE, MAE, R2."""
    e = F.col("actual") - F.col("predicted")
    a = results.groupBy("learner").agg(
        F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"), F.avg(e * e).alias("mse"), F.var_pop("actual").alias("v")
    )
    return a.select("learner", "RMSE", "MAE", F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).otherwise(0.0).alias("R2"))


def score(results: DataFrame) -> DataFrame:
    return score_classification(results) if "probabilities" in results.columns else score_regression(results)


def confusion_matrix(results: DataFrame, *, proportion: bool = False) -> DataFrame:
    """learner, actual, predicted, count of all class pairs, with zeros; ``proportion``: share of the actual class."""
    classes = classes_of(results)
    filled = results.groupBy("learner", "actual").agg(
        F.array(*[F.struct(F.lit(c).alias("predicted"), F.count_if(F.col("predicted") == c).alias("count")) for c in classes]).alias("_c")
    )
    rows = filled.select("learner", "actual", F.inline("_c"))
    # Classes that never occur as actual have a row of zeros.
    every = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted")) for a in classes for p in classes])
    pairs = results.select("learner").distinct().select("learner", F.inline(every))
    full = pairs.join(rows, ["learner", "actual", "predicted"], "left").select(
        "learner", "actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count")
    )
    if not proportion:
        return full
    total = F.sum("count").over(W.partitionBy("learner", "actual"))
    return full.select("learner", "actual", "predicted", F.when(total > 0, F.col("count") / total).otherwise(0.0).alias("proportion"))


def roc(results: DataFrame, *, points: int = 200) -> DataFrame:
    """learner, cls, i, fpr, tpr: one point per distinct score from high to low after a leading (0, 0).

    More than ``points`` points are thinned to evenly spaced positions. Without positives or negatives the rate stays
    a raw count. Running counts come from the bucketed order, one bucket at a time.
    """
    whole = _whole_curve(results)
    # Position i of the thinned curve is floor(i * (size - 1) / (points - 1)); keep a point if some i lands on it.
    last, at = F.col("size") - 1, F.col("at")
    i = F.ceil(at * (points - 1) / last)
    lands = F.floor(i * last / (points - 1)) == at
    kept = whole.withColumn("i", F.when(F.col("size") > points, i).otherwise(at)).where((F.col("size") <= points) | lands)
    return kept.select("learner", "cls", F.col("i").cast("int").alias("i"), "fpr", "tpr")


def _whole_curve(results: DataFrame) -> DataFrame:
    """learner, cls, at, size, fpr, tpr: every point of every curve."""
    down = class_scores(results).withColumn("down", -F.col("score"))
    run = cumulative(
        down, "down", by=["learner", "cls"],
        sums={"n": F.count(F.lit(1)), "pos": F.sum("positive"), "one": F.max(F.lit(1))}, groups=_curves(results),
    )
    tp, fp = F.col("pos_before") + F.col("pos"), (F.col("n_before") + F.col("n")) - (F.col("pos_before") + F.col("pos"))
    p, q = F.col("pos_total"), F.col("n_total") - F.col("pos_total")
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(a.cast("double"))
    curve = run.select(
        "learner", "cls", (F.col("one_before") + 1).alias("at"), (F.col("one_total") + 1).alias("size"), rate(fp, q).alias("fpr"), rate(tp, p).alias("tpr")
    )
    start = run.groupBy("learner", "cls").agg(F.max("one_total").alias("t")).select(
        "learner", "cls", F.lit(0).cast("long").alias("at"), (F.col("t") + 1).alias("size"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return curve.unionByName(start)


def roc_macro(results: DataFrame) -> DataFrame:
    """learner, fpr, tpr: the class curves read off at a common grid of false-positive rates, then averaged.

    Between two points a curve is a straight line. Of the whole curve only the first and the last point between two grid
    values can be neighbours of one, so these are kept, and a curve is one array of them.
    """
    cell = F.ceil(F.col("fpr") * MACRO_GRID - 1e-9)
    ends = F.array(F.min(F.struct("fpr", "tpr")), F.max(F.struct("fpr", "tpr")))
    cells = _whole_curve(results).groupBy("learner", "cls", cell.alias("cell")).agg(ends.alias("e"))
    curve = cells.groupBy("learner", "cls").agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("c"))
    grid = curve.select("learner", "c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MACRO_GRID)), lambda g: g / MACRO_GRID)).alias("fpr"))
    left = F.element_at(F.filter("c", lambda x: x["fpr"] <= F.col("fpr")), -1)
    right = F.get(F.filter("c", lambda x: x["fpr"] > F.col("fpr")), F.lit(0))
    slope = (right["tpr"] - left["tpr"]) / (right["fpr"] - left["fpr"])
    tpr = F.when(right.isNull(), left["tpr"]).otherwise(left["tpr"] + slope * (F.col("fpr") - left["fpr"]))
    return grid.select("learner", "fpr", tpr.alias("tpr")).groupBy("learner", "fpr").agg(F.avg("tpr").alias("tpr"))
