"""k-means and DBSCAN."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablemine.domain import CONTINUOUS, DISCRETE, META, ColumnSpec, col, domain_of, stamp
from tablemine.operators import lloyd
from tablemine.operators.components import connected_components
from tablemine.operators.neighbors import (
    block_parts, distances, feature_vector, pack_blocks, pack_chunks, paired, tree_for, unpack, visits,
)
from tablemine.session import cut


def kmeans(
    df: DataFrame, *, k: int = 3, max_iterations: int = 300, n_init: int = 10, init_method: str = "k-means++", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(annotated, centroids): the table with the meta ``Cluster`` (C1..Ck), and one row of means per cluster.

    All ``n_init`` starts are made and moved together, one pass over the distinct vectors per step, and the one with the
    lowest cost is kept. Missing values count as the column mean while fitting; the output keeps the original values.
    Clusters are numbered by their centres in ascending order.
    """
    names = domain_of(df).continuous()
    vector = feature_vector(df, names)
    points = df.select(vector.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    centres = lloyd.fit(points, len(names), k=k, max_iterations=max_iterations, n_init=n_init, init_method=init_method, seed=seed)
    labels = [f"C{i + 1}" for i in range(k)]
    off = lambda j, x: F.get("_v", F.lit(j)) - F.lit(float(x))
    far = [sum((off(j, x) * off(j, x) for j, x in enumerate(c)), F.lit(0.0)) for c in centres] or [F.lit(0.0)]
    nearest = F.array_position("_far", F.array_min("_far")) - 1
    scored = df.withColumn("_v", vector).withColumn("_far", F.array(*far))
    cluster = stamp(F.get(F.array(*[F.lit(x) for x in labels]), nearest.cast("int")), ColumnSpec("Cluster", DISCRETE, META, tuple(labels)))
    annotated = scored.select(*[col(c) for c in df.columns], cluster)
    centres = [list(map(float, c)) for c in centres]
    rows = [(labels[i], *c) for i, c in enumerate(centres)]
    schema = "Cluster string, " + ", ".join(f"`{n}` double" for n in names)
    table = df.sparkSession.createDataFrame(rows, schema)
    centroids = table.select(
        stamp(F.col("Cluster"), ColumnSpec("Cluster", DISCRETE, META, tuple(labels))),
        *[stamp(col(n), ColumnSpec(n, CONTINUOUS)) for n in names],
    )
    return annotated, centroids


def dbscan(
    df: DataFrame, *, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean", key: Sequence[str]
) -> DataFrame:
    """The table with the meta ``Cluster``: C1.. or Noise. Metrics: euclidean, manhattan, cosine.

    Exact. Points are distinct vectors with weights, compared block by block through the k-d tree of the neighbour
    search. Linking core points emits only a spanning forest per block pair, not the pairs. Clusters are numbered by
    the smallest row key of a core point; a border point goes to the lowest-numbered cluster in reach.
    """
    if metric not in ("euclidean", "manhattan", "cosine"):
        raise ValueError(f"unknown metric {metric!r}; known: euclidean, manhattan, cosine")
    names = domain_of(df).continuous()
    vector = feature_vector(df, names)
    if metric == "cosine":
        # On unit vectors the cosine distance is half the squared length of the difference. A vector of zeros has
        # distance 1 to all others: an extra dimension of its own.
        eps, metric = float(np.sqrt(2 * eps)), "euclidean"
        length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
        unit = F.transform(vector, lambda x: F.when(length > 0, x / length).otherwise(0.0))
        vector = F.concat(unit, F.array(F.when(length > 0, 0.0).otherwise(1.0)))
    rows = df.withColumn("_v", vector)
    smallest = F.min(F.struct(*[col(k) for k in key]))
    points = cut(
        rows.groupBy(F.col("_v").alias("v")).agg(F.count(F.lit(1)).alias("w"), smallest.alias("first_key"))
        .select("v", F.lit(0).alias("label"), "w", "first_key", F.md5(F.col("v").cast("string")).alias("id"))
    )
    tree = tree_for(points)
    reach = F.lit(float(eps))

    def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, block in zip(batch["chunk"], batch["block"]):
                q, _, _ = unpack(chunk)
                x, _, w = unpack(block)
                yield pd.DataFrame({"id": [c["id"] for c in chunk], "n": (distances(q, x, metric) <= eps) @ w})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Spanning forest of the links between a chunk and a block: at most one edge per point."""
        for batch in batches:
            for chunk, block in zip(batch["chunk"], batch["block"]):
                q, _, _ = unpack(chunk)
                x, _, _ = unpack(block)
                qid, xid = [c["id"] for c in chunk], [c["id"] for c in block]
                a, b = spanning_forest(distances(q, x, metric) <= eps)
                yield pd.DataFrame({"a": [qid[i] for i in a], "b": [xid[j] for j in b]})

    def reachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, block in zip(batch["chunk"], batch["block"]):
                q, _, _ = unpack(chunk)
                x, _, _ = unpack(block)
                number = np.array([c["number"] for c in block], dtype=float)
                lowest = np.where(distances(q, x, metric) <= eps, number, np.inf).min(axis=1)
                hit = np.isfinite(lowest)
                yield pd.DataFrame({"id": np.array([c["id"] for c in chunk])[hit], "number": lowest[hit].astype("int64")})

    blocks, parts = pack_blocks(points, tree, ["id"]), block_parts(points, tree)
    seen = visits(points.select("v", "label", "id"), tree, reach, metric)
    counted = paired(pack_chunks(seen, ["id"]), blocks, parts).mapInPandas(count_pairs, "id string, n bigint")
    core_ids = cut(counted.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("id"))
    core = cut(points.join(core_ids, "id", "left_semi"))
    core_blocks, core_parts = pack_blocks(core, tree, ["id"]), block_parts(core, tree)
    core_seen = visits(core.select("v", "label", "id"), tree, reach, metric)
    edges = paired(pack_chunks(core_seen, ["id"]), core_blocks, core_parts).mapInPandas(link, "a string, b string")
    parts = connected_components(core.select("id"), edges)
    member = cut(core.join(parts, "id"))
    heads = member.groupBy("component").agg(F.min("first_key").alias("head"))
    numbers = _dense_number(heads)
    numbered = cut(member.join(numbers, "component").select("id", "v", "label", "w", "number"))
    others = points.join(core_ids, "id", "left_anti")
    other_seen = visits(others.select("v", "label", "id"), tree, reach, metric)
    border = (
        paired(pack_chunks(other_seen, ["id"]), pack_blocks(numbered, tree, ["number"]), block_parts(numbered, tree))
        .mapInPandas(reachable, "id string, number bigint").groupBy("id").agg(F.min("number").alias("number"))
    )
    found = numbered.select("id", "number").unionByName(border)
    named = points.join(found, "id").select(F.col("v").alias("_v"), F.concat(F.lit("C"), F.col("number").cast("string")).alias("_name"))
    label = F.coalesce("_name", F.lit("Noise"))
    return rows.join(named, "_v", "left").select(*[col(c) for c in df.columns], stamp(label, ColumnSpec("Cluster", DISCRETE, META)))


def spanning_forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges (row, column) that connect everything the boolean matrix connects: a breadth-first forest."""
    rows, columns = near.shape
    row_left = near.any(axis=1)
    column_left = near.any(axis=0)
    a: list[int] = []
    b: list[int] = []
    for start in range(rows):
        if not row_left[start]:
            continue
        row_left[start] = False
        frontier = [start]
        while frontier:
            nxt = []
            for r in frontier:
                found = np.flatnonzero(near[r] & column_left)
                column_left[found] = False
                a.extend([r] * len(found))
                b.extend(found.tolist())
                for c in found:
                    back = np.flatnonzero(near[:, c] & row_left)
                    row_left[back] = False
                    a.extend(back.tolist())
                    b.extend([int(c)] * len(back))
                    nxt.extend(back.tolist())
            frontier = nxt
    return a, b


def _dense_number(heads: DataFrame) -> DataFrame:
    """component -> number 1.. in the order of ``head`` (a struct of key columns of any type).

    Heads are sorted into ranges and written with their range number; counting on from the size of the lower ranges
    (one row per range) numbers them without one task seeing all.
    """
    ranged = heads.repartitionByRange("head").withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged)
    below = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_range").orderBy("head")
    return ranged.join(offsets, "_range").select("component", (F.col("_off") + F.row_number().over(inside)).alias("number"))
