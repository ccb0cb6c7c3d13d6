"""Ranks, running sums, quantiles and hash samples against numpy."""

import io
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemine.functions.ordering import (
    average_rank, column_quantiles, cumulative, hash_cut, hash_key, hash_rank, quantiles_of,
)


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; a tenth are missing."""
    rng = np.random.default_rng(1)
    v = np.where(rng.random(3000) < 0.33, 5.0, np.round(rng.normal(5, 3, 3000), 2))
    pdf = pd.DataFrame({"id": range(3000), "g": rng.integers(0, 3, 3000), "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("id") % 10 != 0, F.col("v")))
    pdf.loc[pdf["id"] % 10 == 0, "v"] = np.nan
    return df, pdf


def test_quantiles_match_numpy(skewed):
    df, pdf = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = column_quantiles(df, ["v"], probs)["v"]
    for p in probs:
        assert got[p] == pytest.approx(np.nanquantile(pdf["v"], p))


def test_grouped_quantiles(skewed):
    df, pdf = skewed
    for groups in (3, None):
        got = {(r.g, r.p): r.q for r in quantiles_of(df, [0.3, 0.7], by=["g"], value="v", groups=groups).collect()}
        for g, part in pdf.groupby("g"):
            for p in (0.3, 0.7):
                assert got[(g, p)] == pytest.approx(np.nanquantile(part["v"], p))


def test_average_ranks(skewed):
    df, pdf = skewed
    ranks = {r.v: r["rank"] for r in average_rank(df, "v").collect()}
    want = pdf["v"].rank()
    for v, r in zip(pdf["v"], want):
        if not np.isnan(v):
            assert ranks[v] == r


def test_running_sums(skewed):
    df, pdf = skewed
    got = cumulative(df, "v", by=["g"], sums={"n": F.count(F.lit(1)), "s": F.sum("id")}, groups=3).toPandas()
    for g, part in got.sort_values("v").groupby("g"):
        mine = pdf[(pdf["g"] == g) & pdf["v"].notna()]
        assert part["n"].sum() == len(mine) and (part["n_total"] == len(mine)).all()
        assert list(part["n_before"]) == [int((mine["v"] < v).sum()) for v in part["v"]]
        assert list(part["s_before"]) == [int(mine.loc[mine["v"] < v, "id"].sum()) for v in part["v"]]


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "v double")
    assert column_quantiles(empty, ["v"], [0.5]) == {"v": {}}
    one = spark.createDataFrame([(3.0,)], "v double")
    assert column_quantiles(one, ["v"], [0.2, 0.5]) == {"v": {0.2: 3.0, 0.5: 3.0}}
    nothing = spark.createDataFrame([(None,)], "v double")
    assert column_quantiles(nothing, ["v"], [0.5]) == {"v": {}}


@pytest.mark.parametrize("size", [0, 1, 7, 500, 2999, 3000, 5000])
def test_hash_cut_is_exact(skewed, size):
    df, _ = skewed
    cut = hash_cut(df, ["id"], size)
    got = 0 if cut is None else df.where(hash_key(["id"]) <= cut).count()
    assert got == min(size, 3000)


def test_hash_rank_is_dense_and_ignores_partitioning(skewed):
    df, _ = skewed
    a = {r.id: r._rank for r in hash_rank(df, ["id"]).collect()}
    b = {r.id: r._rank for r in hash_rank(df.repartition(13), ["id"]).collect()}
    assert a == b and sorted(a.values()) == list(range(3000))
    per = hash_rank(df, ["id"], by=["g"]).toPandas()
    for _, part in per.groupby("g"):
        assert sorted(part["_rank"]) == list(range(len(part)))


def test_rows_never_meet_in_one_partition(skewed):
    """The only single-partition exchanges carry bucket totals or one-row facts."""
    df, _ = skewed
    assert "SinglePartition" not in plan_of(hash_rank(df, ["id"], by=["g"]))
    assert "SinglePartition" not in plan_of(quantiles_of(df, [0.5], by=["g"], value="v"))
