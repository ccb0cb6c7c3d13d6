"""Principal components and landmark multidimensional scaling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.domain import ATTRIBUTE, CONTINUOUS, META, STRING, ColumnSpec, col, domain_of, finite, stamp
from tablemine.functions.ordering import hash_cut, hash_key
from tablemine.operators.neighbors import feature_vector


def pca(
    df: DataFrame, *, n_components: int = 5, normalize: bool = False, explained: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """(scores, components): the table with its continuous attributes replaced by PC1.., and one row per component
    with its share of the variance and its loadings.

    At most min(n, attributes, rows) components, at least one; ``explained`` keeps the fewest that reach that share of
    the variance. Rows are centred (and scaled with ``normalize``); the largest loading of a component is positive.
    Spark builds the covariance in one pass; what comes back is attributes x components numbers.
    """
    names = domain_of(df).continuous()
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(finite(col(c))).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_pop(finite(col(c))).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    means = [facts[f"m{i}"] or 0.0 for i in range(len(names))]
    sds = [(facts[f"s{i}"] or 1.0) if normalize else 1.0 for i in range(len(names))]
    centred = F.array(*[
        (F.coalesce(finite(col(c)), F.lit(m)) - F.lit(m)) / F.lit(s) for c, m, s in zip(names, means, sds)
    ])
    most = max(1, min(n_components if explained is None else len(names), len(names), facts.n))
    rows = df.withColumn("_x", array_to_vector(centred))
    model = PCA(k=most, inputCol="_x", outputCol="_pc").fit(rows.select("_x"))
    loadings, shares = model.pc.toArray(), model.explainedVariance.toArray()
    if explained is not None:
        most = min(most, int(np.searchsorted(np.cumsum(shares), explained - 1e-12)) + 1)
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] >= 0 else -1.0 for j in range(most)]
    scored = model.transform(rows).withColumn("_a", vector_to_array("_pc"))
    scores = [stamp(F.get("_a", F.lit(j)) * F.lit(signs[j]), ColumnSpec(f"PC{j + 1}", CONTINUOUS, ATTRIBUTE)) for j in range(most)]
    kept = [col(c) for c in df.columns if c not in names]
    table = [(f"PC{j + 1}", float(shares[j]), *[float(x * signs[j]) for x in loadings[:, j]]) for j in range(most)]
    schema = "component string, variance double, " + ", ".join(f"`{n}` double" for n in names)
    components = df.sparkSession.createDataFrame(table, schema).select(
        stamp(F.col("component"), ColumnSpec("component", STRING, META)), stamp(F.col("variance"), ColumnSpec("variance", CONTINUOUS, META)),
        *[stamp(col(n), ColumnSpec(n, CONTINUOUS)) for n in names],
    )
    return scored.select(*scores, *kept), components


def landmark_mds(
    df: DataFrame, *, n_components: int = 2, landmarks: int = 200, seed: int = 42, key: Sequence[str]
) -> DataFrame:
    """The table with metas mds-x1.. that keep distances (landmark MDS, de Silva and Tenenbaum 2004).

    A hash sample of at most ``landmarks`` rows is scaled classically on the driver (a landmarks x landmarks matrix);
    every row is then placed by a linear map of its squared distances to the landmarks, in Arrow batches.
    """
    names = domain_of(df).continuous()
    vector = feature_vector(df, names)
    cut = hash_cut(df, key, landmarks, seed=seed) or ""
    chosen = df.select(hash_key(key, seed).alias("h"), vector.alias("v")).where(F.col("h") <= cut).orderBy("h").limit(landmarks)
    points = np.array([r.v for r in chosen.collect()]).reshape(-1, len(names))
    place, mean = landmark_map(points, n_components)

    @F.pandas_udf("array<double>")
    def embed(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy())
        squared = np.zeros((len(x), len(points)))
        for j in range(x.shape[1]):
            squared += (x[:, j][:, None] - points[:, j][None, :]) ** 2
        return pd.Series(list((mean - squared) @ place))

    out = df.withColumn("_e", embed(vector))
    return out.select(
        *[col(c) for c in df.columns],
        *[stamp(F.get("_e", F.lit(j)), ColumnSpec(f"mds-x{j + 1}", CONTINUOUS, META)) for j in range(n_components)],
    )


def landmark_map(points: np.ndarray, n_components: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, mean squared distances) such that (mean - squared distances to the landmarks) @ matrix is the place."""
    squared = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    mean = squared.mean(axis=0) if len(points) else np.zeros(0)
    centred = -0.5 * (squared - mean[:, None] - mean[None, :] + (mean.mean() if len(points) else 0.0))
    values, vectors = np.linalg.eigh(centred) if len(points) else (np.zeros(0), np.zeros((0, 0)))
    place = np.zeros((len(points), n_components))
    for j in range(min(n_components, len(values))):
        v, value = vectors[:, -1 - j], values[-1 - j]
        if value > 1e-9 * max(values[-1], 1.0):
            sign = 1.0 if v[np.argmax(np.abs(v))] >= 0 else -1.0
            place[:, j] = 0.5 * sign * v / np.sqrt(value)
    return place, mean
