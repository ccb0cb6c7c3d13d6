"""L-BFGS: gradients against differences, known minima, networks of every activation on the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.operators.learners import NeuralNetwork, descent, quasi_newton


def network(rng, sizes):
    out = []
    for a, b in zip(sizes, sizes[1:]):
        out += [rng.normal(size=(a, b)), rng.normal(size=b)]
    return out


@pytest.mark.parametrize("activation", ["relu", "tanh", "identity", "logistic"])
@pytest.mark.parametrize("many", [True, False])
def test_gradient_equals_differences(activation, many):
    rng = np.random.default_rng(3)
    params = network(rng, [4, 5, 3, 3 if many else 1])
    x, w = rng.normal(size=(20, 4)), rng.uniform(1, 3, 20)
    goal = np.eye(3)[rng.integers(0, 3, 20)] if many else rng.normal(size=(20, 1))
    _, grads = descent._gradient(params, x, goal, w, activation, many)
    for p, g in zip(params, grads):
        for at in np.ndindex(p.shape):
            keep, ends = p[at], []
            for e in (1e-6, -1e-6):
                p[at] = keep + e
                ends.append(descent._gradient(params, x, goal, w, activation, many)[0])
            p[at] = keep
            assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-5)


def test_known_minimum():
    def valley(x):
        a, b = x
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    place, values = quasi_newton.minimise(valley, np.array([-1.2, 1.0]), max_iter=200, tol=1e-8)
    assert place == pytest.approx([1, 1]) and all(a >= b for a, b in zip(values, values[1:])) and len(values) < 60
    assert quasi_newton.minimise(valley, np.array([1.0, 1.0]), max_iter=5, tol=1e-8)[1] == [0.0]


def rows(spark, many):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 2)).round(2)
    y = ((x[:, 0] * x[:, 1] > 0).astype(int) if many else np.sin(2 * x[:, 0]) + x[:, 1] ** 2).tolist()
    data = [(i, float(a), float(b), str(c) if many else float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    data += [(600 + i, 0.5, 0.5, "1" if many else 1.0) for i in range(200)]
    df = spark.createDataFrame(data, f"id int, a double, b double, y {'string' if many else 'double'}").repartition(4)
    return set_roles(df, discrete=["y"] if many else [], target="y", metas=["id"])


def test_sums_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(quasi_newton, "PIECE", 3)
    shards = descent.sharded(spark.range(500).select(F.array(F.col("id").cast("double")).alias("raw"), F.array(F.col("id") % 7 * 1.0, F.col("id") % 3 * 1.0).alias("x"), (F.col("id") % 5 * 1.0).alias("y")))
    total = quasi_newton.SummedGradient(shards, 2, lambda p, x, y, w: (float(w @ y), np.r_[w @ x, p[2] * w.sum(), 0, 1, 2, 3]))
    value, gradient = total(np.arange(7.0))
    ids = np.arange(500)
    assert total.rows == 500 and value == (ids % 5).sum()
    assert gradient[:4].tolist() == [(ids % 7).sum(), (ids % 3).sum(), 1000.0, 0.0]


@pytest.mark.parametrize("many, activation", [(True, "tanh"), (True, "relu"), (False, "relu"), (False, "logistic")])
def test_networks_by_the_whole_gradient(spark, many, activation):
    df = rows(spark, many)
    net = NeuralNetwork(hidden_layer_sizes="12", activation=activation, solver="lbfgs", max_iter=60)
    model = net.fit(df)
    assert all(a >= b for a, b in zip(net.losses, net.losses[1:])) and net.losses[-1] < 0.5 * net.losses[0]
    out = model.transform(df)
    if many:
        assert out.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.93
    else:
        r = out.agg(F.avg((F.col("prediction") - F.col("y")) ** 2), F.var_pop("y")).first()
        assert r[0] < 0.15 * r[1]


def test_whole_gradient_is_not_worse_than_averaged_shards(spark):
    df = rows(spark, False)
    loss = lambda m: m.transform(df).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    fit = lambda solver: NeuralNetwork(hidden_layer_sizes="8", activation="tanh", solver=solver, max_iter=60, alpha=0.0).fit(df)
    assert loss(fit("lbfgs")) <= loss(fit("adam")) * 1.02


def test_unknown_solver():
    with pytest.raises(ValueError):
        NeuralNetwork(solver="newton")


def test_sums_of_tasks_meet_either_way(spark, monkeypatch):
    """Few numbers come straight from the tasks, many in two rounds; shards keep their rows as bytes."""
    from tablemine.operators.learners import quasi_newton

    table = spark.range(0, 100, 1, 6)
    each = lambda parts: np.array([float(sum(np.asarray(b.column(0)).sum() for b in parts)), 1.0, 0.5])
    assert quasi_newton.summed(table, 6, 3, each).tolist() == [4950.0, 6.0, 3.0]
    monkeypatch.setattr(quasi_newton, "DIRECT", 0)
    assert quasi_newton.summed(table, 6, 3, each).tolist() == [4950.0, 6.0, 3.0]


def test_rounds_average_shards_by_their_rows(spark, monkeypatch):
    data = spark.range(1000).select(F.array(F.col("id").cast("double")).alias("raw"), F.array(F.col("id") * 1.0).alias("x"), (F.col("id") % 2 * 1.0).alias("y"))
    monkeypatch.setattr(descent, "SHARD", 100)
    seen = lambda params, x, y, w, r: ([np.array([(x[:, 0] * w).sum() / w.sum(), (y * w).sum() / w.sum()])], float(w.sum()))
    (mean,) = descent.average_rounds(data, [np.zeros(2)], seen, rounds=1, tol=0.0)
    assert mean == pytest.approx([499.5, 0.5])
