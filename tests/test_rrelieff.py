"""RReliefF against the definition over all rows, with attributes that many rows share."""

import math
import random

import pytest

from tablemine.operators import neighbors, ranking
from tablemine.operators.ranking import rrelieff


def plain(rows, k):
    """Scores of rows (attributes..., target); rows of equal attributes count alike, others in order of distance and attributes."""
    scale = []
    for column in zip(*rows):
        low, high = min(column), max(column)
        scale.append([(x - low) / (high - low) if high > low else 0.0 for x in column])
    rows, size = list(zip(*scale)), len(scale) - 1
    c = m = 0.0
    a, ca = [0.0] * size, [0.0] * size
    for i, q in enumerate(rows):
        groups = {}
        for j, r in enumerate(rows):
            if i != j:
                groups.setdefault(r[:-1], []).append(r[-1])
        order = sorted(groups, key=lambda v: (sum(abs(x - y) for x, y in zip(v, q)), v))
        ranks, left = [], 0
        for v in order:
            take = min(len(groups[v]), k - left)
            ranks.append((v, sum(math.exp(-((r / 20) ** 2)) for r in range(left + 1, left + take + 1))))
            left += take
        whole = sum(w for _, w in ranks)
        for v, w in ranks:
            w /= whole
            dy = sum(abs(q[-1] - y) for y in groups[v]) / len(groups[v])
            c, m = c + w * dy, m + w
            for x in range(size):
                d = abs(v[x] - q[x])
                a[x] += w * d
                ca[x] += w * dy * d
    return [ca[x] / c - (a[x] - ca[x]) / (m - c) for x in range(size)]


@pytest.mark.parametrize("k", [5, 50])
def test_all_rows_are_queries(spark, k):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        x, z = (0.5, 0.5) if i % 3 == 0 else (rng.random(), rng.randrange(5) / 4)
        rows.append((x, z, rng.randrange(4) / 4 if i % 3 == 0 else (x * x if z > 0.4 else -x)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, x double, z double, y double").repartition(3)
    got = {r.feature: r.RReliefF for r in rrelieff(df, "y", ["x", "z"], neighbours=k, key=["id"]).collect()}
    assert [got["x"], got["z"]] == pytest.approx(plain(rows, k), abs=1e-9)


def test_awkward_tables(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 1.0, None)], "id long, x double, y double")
    for t in (df, df.where("id = 1"), df.limit(0), df.where("id = 3")):
        assert [(r.feature, r.RReliefF) for r in rrelieff(t, "y", ["x"], key=["id"]).collect()] == [("x", 0.0)]


def test_neighbours_stay_in_their_tasks(spark, monkeypatch):
    """Many leaves, points dropped on the way, one point of more values than travel with it: never a row per neighbour."""
    rng = random.Random(6)
    rows = [(0.5, 0.5, rng.random()) if i < 120 else (rng.random(), rng.random(), rng.randrange(9) / 8) for i in range(900)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, x double, z double, y double").repartition(3)
    made = []

    def counted(table, cut=ranking.cut):
        made.append((out := cut(table)).count())
        return out

    monkeypatch.setattr(ranking, "cut", counted)
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    monkeypatch.setattr(neighbors, "HELD", 100, raising=False)
    got = {r.feature: r.RReliefF for r in rrelieff(df, "y", ["x", "z"], key=["id"]).collect()}
    assert [got["x"], got["z"]] == pytest.approx(plain(rows, 50), abs=1e-9)
    assert max(made) < 900


def test_some_rows_ask(spark):
    """With ``samples`` every row is still a neighbour: asking with all rows by number is asking with all."""
    rows = [(i, (i * 37 % 101) / 101, (i * 53 % 97) / 97, (i % 7) / 7) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, z double, y double")
    scores = lambda **k: sorted((r.feature, round(r.RReliefF, 9)) for r in rrelieff(df, "y", ["x", "z"], neighbours=7, key=["id"], **k).collect())
    assert scores() == scores(samples=300) != scores(samples=40)
