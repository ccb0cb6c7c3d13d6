"""Trees against a plain grower, node for node, however the work is split between passes and tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.operators.learners import AdaBoost, DecisionTree, RandomForest
from tablemine.operators.learners import growth
from tablemine.operators.learners.trees import weighted_median


def plain(bins, label, weight, times, rule, node_hash, depth=0):
    """Nested (stats, feature, bin, left, right): every cut of every attribute tried one by one."""
    total = growth.stats_of(label, weight, times, rule).sum(0)
    node = [tuple(total), -1, 0, None, None]
    if not rule.open(total[None], np.array([depth]))[0]:
        return node
    first = rule.chosen(np.array([node_hash], np.uint64))[0]
    for tried in (first, ~first):
        best = None
        for j in np.flatnonzero(tried):
            for b in np.unique(bins[:, j]):
                left = bins[:, j] <= b
                s = growth.stats_of(label[left], weight[left], times[left], rule).sum(0)
                score = float(rule.scores(s, total))
                if best is None or score > best[0]:
                    best = (score, j, b, left)
        if best is not None and rule.better(np.array([best[0]]), total[None])[0]:
            break
    else:
        return node
    _, j, b, left = best
    h = growth.child_hashes(np.array([node_hash], np.uint64))
    sides = [plain(bins[m], label[m], weight[m], times[m], rule, h[i], depth + 1) for i, m in enumerate((left, ~left))]
    return [tuple(total), int(j), int(b), *sides]


def nested(tree, n=0):
    node = [tuple(tree.stats[n]), int(tree.feature[n]), int(tree.bin[n]), None, None]
    if tree.left[n] >= 0:
        node[3:] = [nested(tree, tree.left[n]), nested(tree, tree.left[n] + 1)]
    return node


def made(spark, classes, n=2000, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 400, n), rng.integers(0, 5, n), rng.normal(size=n).round(3), np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 90, n))], 1)
    y = (x[:, 0] > 200) + (x[:, 1] == 2) * (x[:, 3] > 30) + (rng.random(n) < 0.15)
    y = y % classes if classes else (x[:, 0] // 50 + rng.integers(0, 3, n))
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "features array<double>, label double").repartition(5)


CASES = [
    (3, growth.Rule(3, 4, 4, 5, 5, 2), 1, False), (3, growth.Rule(3, 4, 2, None, 5), 3, True),
    (0, growth.Rule(0, 4, 4, 4, 20, 7), 1, False), (0, growth.Rule(0, 4, 1, None, 8, 3), 2, True), (2, growth.Rule(2, 4, 4, None, 2), 1, False),
]


@pytest.mark.parametrize("classes, rule, trees, resample", CASES)
def test_node_for_node(spark, classes, rule, trees, resample):
    data = growth.to_bins(made(spark, classes), 4)
    rows = data.table.toPandas()
    bins = np.stack([np.frombuffer(b, np.uint8) for b in rows["bins"]])
    grown = [growth.grow(data, rule, trees=trees, seed=9, resample=resample, deal=d) for d in (10_000, 300, 40)]
    for t in range(trees):
        times = growth._times(rows["id"].to_numpy(), 9, t, resample)
        m = times > 0
        want = plain(bins[m], rows["label"].to_numpy()[m], rows["weight"].to_numpy()[m], times[m], rule, growth.root_hash(9, t))
        for g in grown:
            assert nested(g[t]) == want
    leaves = grown[0][0].stats[grown[0][0].left < 0]
    inner = grown[0][0].stats[grown[0][0].left >= 0]
    assert leaves[:, -1].min() >= rule.min_leaf and inner[:, -1].min() >= rule.min_split and len(leaves) > 4


def test_more_open_nodes_than_memory_for_histograms(spark, monkeypatch):
    data = growth.to_bins(made(spark, 3), 4)
    rule = growth.Rule(3, 4, 2, 6, 5)
    whole = growth.grow(data, rule, trees=2, deal=0)
    monkeypatch.setattr(growth, "HISTOGRAM_BYTES", 1)
    assert [nested(t) for t in growth.grow(data, rule, trees=2, deal=0)] == [nested(t) for t in whole]


def test_depth_has_no_limit(spark):
    """A staircase of values: each cut takes one step off, so the tree is deeper than 30."""
    rows = [([float(i), 0.0], float(3**i % 1_000_003 if i < 60 else 0)) for i in range(60)]
    data = growth.to_bins(spark.createDataFrame(rows, "features array<double>, label double"), 2)
    (tree,) = growth.grow(data, growth.Rule(0, 2, 2))
    assert (tree.left < 0).sum() == 60 and (tree.stats[tree.left < 0, -1] == 1).all()
    chain = [([float(2**i)], float(4.0**i)) for i in range(40)]
    (deep,) = growth.grow(growth.to_bins(spark.createDataFrame(chain, "features array<double>, label double"), 1), growth.Rule(0, 1, 1))
    depth, at = 0, np.array([0])
    while len(at := np.r_[deep.left[at][deep.left[at] >= 0], deep.left[at][deep.left[at] >= 0] + 1]):
        depth += 1
    assert depth > 30


def test_learners_keep_the_rows_of_a_node(spark):
    df = set_roles(made(spark, 0).select(F.get("features", F.lit(0)).alias("a"), F.get("features", F.lit(3)).alias("b"), "label"), target="label")
    for learner, least in ((DecisionTree(max_depth=None, min_samples_split=40, min_samples_leaf=3), 40), (RandomForest(n_estimators=2, min_samples_split=60), 60)):
        for t in learner.fit(df).trees:
            assert t.stats[t.left >= 0, -1].min() >= least


def test_boosting_against_the_plain_rounds(spark):
    raw = made(spark, 2)
    df = raw.select(*[F.get("features", F.lit(j)).alias(f"x{j}") for j in range(4)], F.col("label").cast("int").cast("string").alias("y"))
    df = set_roles(df, discrete=["y"], target="y")
    model = AdaBoost(n_estimators=6).fit(df)
    x = np.array([r[:4] for r in df.collect()], float)
    y = np.array([int(r.y) for r in df.collect()])
    bins, w, votes = growth.binned(x, model.cuts), np.ones(len(y)), np.zeros(len(y))
    rule = growth.Rule(2, 4, 4, 1)
    for tree in model.trees:
        want = plain(bins, y, w, np.ones(len(y)), rule, growth.root_hash(42, 0))
        assert (want[1], want[2]) == (tree.feature[0], tree.bin[0])
        vote = tree.stats[:, :-1].argmax(1)[tree.leaf_of(bins)]
        error = w[vote != y].sum() / w.sum()
        alpha = np.log((1 - error) / error)
        w = w * np.exp(alpha * (vote != y))
        w *= len(y) / w.sum()
        votes += alpha * np.where(vote == 1, 1, -1)
    got = {tuple(r[:4]): r.prediction for r in model.transform(df).select("x0", "x1", "x2", "x3", "prediction").collect()}
    assert all(got[tuple(a)] == str(int(v > 0)) for a, v in zip(x, votes) if abs(v) > 1e-9)


def test_weighted_median():
    v, w = np.array([[3.0, 1.0, 2.0], [5.0, 5.0, 9.0]]), np.array([1.0, 1.0, 3.0])
    assert weighted_median(v, w).tolist() == [2.0, 9.0]


def test_lookups_reach_the_leaves():
    """Outcomes as bits of one byte against walking down, for trees of depth 3 and larger ones."""
    from tablemine.operators.learners.growth import Paths

    rng = np.random.default_rng(3)
    bins = rng.integers(0, 255, (4000, 3)).astype(np.uint8)
    for depth in (0, 1, 3, 5):
        stats = np.stack([rng.normal(size=4000), np.ones(4000), np.ones(4000) * 3, np.ones(4000)], 1)
        (tree,) = growth.grow_rows(bins, stats, np.zeros(4000, int), np.array([7], np.uint64), np.zeros(1, int), growth.Rule(0, 3, 3, depth))
        value = rng.normal(size=len(tree.feature))
        assert (Paths(tree).values(bins, value) == value[tree.leaf_of(bins)]).all()


def test_equal_rows_are_counted_once(spark):
    """Boosting reads rows of equal bins and class as one; the stump is that of the single rows."""
    df = spark.createDataFrame([([float(i % 7), float(i % 3)], float(i % 7 > 3 or i % 3 == 2)) for i in range(2000)], "features array<double>, label double")
    data = growth.to_bins(df, 2)
    few = data.combined()
    assert few.table.count() == 21 and few.rows == 2000
    rule = growth.Rule(2, 2, 2, 1)
    weigh = lambda bins, label: np.exp(label - bins[:, 0])
    (a,), (b,) = (growth.grow(x, rule, weigh=weigh, deal=0) for x in (data, few))
    assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and a.stats == pytest.approx(b.stats)
