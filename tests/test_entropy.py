"""Entropy cuts of columns with many distinct values, against the same recursion in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemine.functions.entropy import mdl_cuts, split_points


def plain(values, classes):
    found, at = np.unique(values, return_inverse=True)
    counts = np.zeros((len(found), classes.max() + 1))
    np.add.at(counts, (at, classes), 1)
    return split_points(found, counts)


def test_rare_class_in_a_tail(spark):
    df = spark.range(40000).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") >= 39989, "rare").otherwise("rest").alias("y"))
    assert mdl_cuts(df, ["x"], "y") == {"x": [39989.0]}


@pytest.mark.parametrize("parts", [1, 7])
def test_all_boundaries_are_candidates(spark, parts):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(20000) < 0.33, 500.0, np.round(rng.normal(500, 200, 20000), 2))
    y = (x >= 500.01).astype(int) + (x > 871.3) + ((x < 120.7) & (rng.random(20000) < 0.9))
    z = rng.integers(0, 9, 20000).astype(float)
    df = spark.createDataFrame([(float(a), float(b), str(c)) for a, b, c in zip(x, z, y)], "x double, z double, y string").repartition(parts)
    assert mdl_cuts(df, ["x", "z"], "y") == {"x": plain(x, y), "z": plain(z, y)}
    assert 500.01 in plain(x, y) or min(v for v in x if v >= 500.01) in plain(x, y)


def test_awkward_columns(spark):
    rows = [(None, 1.0, float("nan"), "a"), (None, 1.0, 2.0, "b"), (None, 1.0, float("inf"), "b"), (None, 1.0, float("-inf"), None)]
    df = spark.createDataFrame(rows, "none double, one double, odd double, y string")
    assert mdl_cuts(df, ["none", "one", "odd"], "y") == {"none": [], "one": [], "odd": []}
    assert mdl_cuts(df.where("y = 'a'"), ["one"], "y") == {"one": []}
    assert mdl_cuts(df.limit(0), ["one"], "y") == {"one": []}
