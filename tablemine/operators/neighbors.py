"""Exact nearest neighbours and range neighbours of whole tables, without comparing all pairs.

Points are first reduced to distinct vectors with a weight (how many rows share the vector), so a vector that holds a
third of the table is one point. A k-d tree, built from a bounded sample, splits space into leaves; the points of a
leaf are packed into blocks of bounded size. A query visits its own leaf, which bounds the distance to its k-th
neighbour, and then only those leaves whose region comes within that distance. Queries travel in chunks of bounded
size, so one task holds one chunk and one block whatever the data looks like. What leaves a task is at most k rows
per query and block, never the pairs. Where the points need more leaves than one tree may have, each leaf holds a
tree of its own, built where its points lie: leaves stay as small as they are, and neither tree is large.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tablemine.domain import col, finite
from tablemine.functions.ordering import hash_cut
from tablemine.session import cut, scratch_path

#: Points per block and queries per chunk (what one task compares at a time).
BLOCK, CHUNK = 2000, 1000
#: Leaves of a tree: about one per ``BLOCK`` points up to this many, beyond which leaves hold trees.
MAX_LEAVES = 4096
#: Rows that meet an inner tree in one task.
INNER_ROWS = 50_000
#: Bits of the inner leaf in a leaf's number.
INNER_BITS = 24
#: Rows of the sample that shapes the tree.
TREE_SAMPLE = 100_000
#: For :func:`fold_nearest`: points of a leaf, points of a cell inside it, points a task holds before it drops those nobody needs.
GROUP, CELL, HELD = 32_768, 128, 200_000

METRICS = ("euclidean", "manhattan", "chebyshev", "minkowski")


def feature_vector(df: DataFrame, names: Sequence[str]) -> Column:
    """Continuous columns as one array, missing values as the column mean (collected: one number per column)."""
    means = df.agg(*[F.avg(finite(col(n))).alias(f"m{i}") for i, n in enumerate(names)]).first()
    return F.array(*[F.coalesce(finite(col(n)), F.lit(means[f"m{i}"]), F.lit(0.0)) + F.lit(0.0) for i, n in enumerate(names)])


@dataclass(frozen=True)
class Tree:
    """Split dimension, threshold and children per node (dimension -1: leaf, whose number is ``left``); leaf regions."""

    dim: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.low)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=int)
        while True:
            inner = self.dim[node] >= 0
            if not inner.any():
                return self.left[node]
            i = np.flatnonzero(inner)
            n = node[i]
            goes_left = x[i, self.dim[n]] < self.at[n]
            node[i] = np.where(goes_left, self.left[n], self.right[n])

    def near(self, x: np.ndarray, radius: np.ndarray, metric: str, p: float) -> list[np.ndarray]:
        """Leaves whose region lies within ``radius`` of each point (a hair more, to absorb rounding)."""
        out = []
        for point, r in zip(x, radius):
            gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
            out.append(np.flatnonzero(norm(gap, metric, p) <= r * (1 + 1e-9) + 1e-12))
        return out


def norm(gap: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """Length of the rows of ``gap``, adding dimensions one by one in order."""
    gap = np.abs(gap)
    total = np.zeros(gap.shape[:-1])
    for j in range(gap.shape[-1]):
        g = gap[..., j]
        if metric == "manhattan":
            total = total + g
        elif metric == "chebyshev":
            total = np.maximum(total, g)
        elif metric == "minkowski":
            total = total + g**p
        else:
            total = total + g * g
    if metric == "minkowski":
        return total ** (1 / p)
    return np.sqrt(total) if metric == "euclidean" else total


def distances(q: np.ndarray, x: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """Distance matrix of two bounded sets of points, one dimension at a time."""
    total = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        g = np.abs(q[:, j][:, None] - x[:, j][None, :])
        if metric == "manhattan":
            total += g
        elif metric == "chebyshev":
            np.maximum(total, g, out=total)
        elif metric == "minkowski":
            total += g**p
        else:
            total += g * g
    if metric == "minkowski":
        return total ** (1 / p)
    return np.sqrt(total) if metric == "euclidean" else total


def grow_tree(sample: np.ndarray, leaves: int, region: tuple[np.ndarray, np.ndarray] | None = None) -> Tree:
    """Halve the sample at the median of its widest dimension until there are about ``leaves`` leaves, within ``region``."""
    width = sample.shape[1]
    dim, at, left, right, low, high = [], [], [], [], [], []
    bounds = region or (np.full(width, -np.inf), np.full(width, np.inf))
    stack = [(np.arange(len(sample)), leaves, *bounds, None)]
    while stack:
        rows, parts, lo, hi, parent = stack.pop()
        me = len(dim)
        if parent is not None:
            node, side = parent
            (left if side == "l" else right)[node] = me
        spread = sample[rows].max(axis=0) - sample[rows].min(axis=0) if len(rows) else np.zeros(width)
        d = int(np.argmax(spread)) if width else 0
        cutpoint = float(np.median(sample[rows, d])) if len(rows) and width else 0.0
        if len(rows):
            below = sample[rows, d] < cutpoint
            if not below.any() and spread[d] > 0:
                cutpoint = float(np.min(sample[rows, d][sample[rows, d] > cutpoint]))
                below = sample[rows, d] < cutpoint
        if parts < 2 or len(rows) < 2 or spread[d] <= 0:
            dim.append(-1), at.append(0.0), left.append(len(low)), right.append(-1)
            low.append(lo), high.append(hi)
            continue
        dim.append(d), at.append(cutpoint), left.append(-1), right.append(-1)
        lhi, rlo = hi.copy(), lo.copy()
        lhi[d], rlo[d] = cutpoint, cutpoint
        stack.append((rows[~below], parts - parts // 2, rlo, hi, (me, "r")))
        stack.append((rows[below], parts // 2, lo, lhi, (me, "l")))
    return Tree(np.array(dim), np.array(at), np.array(left), np.array(right), np.array(low), np.array(high))


@dataclass(frozen=True)
class Nested:
    """A tree whose leaves hold trees: ``inner(top, nodes, regions)``, one row per leaf of ``outer``."""

    outer: Tree
    inner: DataFrame

    @property
    def leaves(self) -> int:
        return self.outer.leaves


def _packed(tree: Tree) -> tuple[bytes, bytes]:
    nodes = np.stack([tree.dim, tree.left, tree.right]).astype("<i4").tobytes() + tree.at.astype("<f8").tobytes()
    return nodes, np.stack([tree.low, tree.high]).astype("<f8").tobytes()


def _opened(nodes: bytes, regions: bytes, width: int) -> Tree:
    n = len(nodes) // 20
    dim, left, right = np.frombuffer(nodes, "<i4", 3 * n).reshape(3, n)
    low, high = np.frombuffer(regions, "<f8").reshape(2, -1, width)
    return Tree(dim, np.frombuffer(nodes, "<f8", offset=12 * n), left, right, low, high)


def nested_for(points: DataFrame, outer: Tree, seed: int) -> Nested:
    """Trees in the leaves of ``outer``, each from a sample of its leaf's points, about 64 for each inner leaf."""
    by_hash = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    placed = with_leaf(points.select("v"), outer).withColumnRenamed("leaf", "top")
    sizes = placed.groupBy("top").agg(F.count(F.lit(1)).alias("size"))  # at most MAX_LEAVES rows
    share = F.least(F.lit(64.0 / BLOCK), F.lit(float(TREE_SAMPLE)) / F.col("size"))
    drawn = placed.join(F.broadcast(sizes), "top").where(by_hash < share)
    bounds = sizes.join(drawn.groupBy("top").agg(F.count(F.lit(1)).alias("n")), "top", "left")
    without = bounds.where("n IS NULL").select("top", F.lit(None).cast("array<double>").alias("v"), "size")

    def build(group: pa.Table) -> pa.Table:
        top, size = group.column("top")[0].as_py(), group.column("size")[0].as_py()
        rows = [v for v in group.column("v").to_pylist() if v is not None]
        region = outer.low[top], outer.high[top]
        tree = grow_tree(np.array(rows).reshape(-1, len(region[0])), -(-size // BLOCK) if rows else 1, region)
        nodes, regions = _packed(tree)
        return pa.table({"top": pa.array([top], pa.int32()), "nodes": pa.array([nodes]), "regions": pa.array([regions])})

    grown = drawn.select("top", "v", "size").unionByName(without).groupBy("top").applyInArrow(build, "top int, nodes binary, regions binary")
    return Nested(outer, cut(grown))


def _inside(df: DataFrame, tree: Nested, find, radius: str | None = None) -> DataFrame:
    """``df(top, v, ...)`` with ``leaf`` in place of ``top``: rows meet their leaf's inner tree in groups of about INNER_ROWS.

    ``find(inner, vectors, radii)`` gives the inner leaves of each row; a row comes out once for each.
    """
    parts = df.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / INNER_ROWS).cast("int").alias("parts"))
    spread = df.join(F.broadcast(parts), "top").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts")
    trees = tree.inner.join(F.broadcast(parts), "top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    kept = [c for c in df.columns if c != "top"]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("leaf", T.LongType())])

    def place(rows: pa.Table, inner: pa.Table) -> pa.Table:
        if not rows.num_rows:  # a tree's part without rows
            return rows.select(kept).append_column("leaf", pa.array([], pa.int64()))
        x = np.array(rows.column("v").to_pylist())
        radii = np.asarray(rows.column(radius), dtype=float) if radius else None
        found = find(_opened(inner.column("nodes")[0].as_py(), inner.column("regions")[0].as_py(), x.shape[1]), x, radii)
        n = np.array([len(f) for f in found])
        leaf = (np.int64(inner.column("top")[0].as_py()) << INNER_BITS) | np.concatenate(found).astype(np.int64)
        return rows.select(kept).take(pa.array(np.repeat(np.arange(len(n)), n))).append_column("leaf", pa.array(leaf))

    return spread.groupBy("top", "part").cogroup(trees.groupBy("top", "part")).applyInArrow(place, schema)


def tree_for(points: DataFrame, *, seed: int = 42) -> Tree | Nested:
    """Tree over the distinct vectors in column ``v``, from at most ``TREE_SAMPLE`` of them; nested for more than MAX_LEAVES blocks."""
    n = points.count()
    leaves = max(1, min(MAX_LEAVES, -(-n // BLOCK)))
    if leaves == 1:
        first = points.select("v").first()
        return grow_tree(np.zeros((1, len(first.v) if first else 0)), 1)
    keyed = points.select("v", F.col("v").cast("string").alias("k"))
    edge = hash_cut(keyed, ["k"], min(n, TREE_SAMPLE, 64 * leaves), seed=seed)
    from tablemine.functions.ordering import hash_key

    rows = keyed.where(hash_key(["k"], seed) <= edge).select("v").toPandas()
    tree = grow_tree(np.stack(rows["v"].to_numpy()), leaves)
    return nested_for(points, tree, seed) if n > BLOCK * MAX_LEAVES and tree.leaves > 1 else tree


def with_leaf(df: DataFrame, tree: Tree | Nested) -> DataFrame:
    """``df`` with the number of its leaf: int for one tree, long for nested ones."""
    if isinstance(tree, Nested):
        top = with_leaf(df, tree.outer).withColumnRenamed("leaf", "top")
        return _inside(top, tree, lambda inner, x, _: inner.leaf_of(x)[:, None])

    @F.pandas_udf("int")
    def leaf(v: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf_of(np.stack(v.to_numpy())) if len(v) else [], dtype="int32")

    return df.withColumn("leaf", _only_leaf() if tree.leaves == 1 else leaf("v"))


def _only_leaf() -> Column:
    """0 in every row, but not a constant to Spark, which would turn joins on it into products."""
    return F.pmod(F.xxhash64("v"), F.lit(1)).cast("int")


def _split(df: DataFrame, size: int, key: Column) -> DataFrame:
    """Add ``part``: rows of a leaf spread by hash over enough parts of about ``size`` rows.

    The part count per leaf is a broadcast table of at most ``MAX_LEAVES`` rows for one tree, and joined otherwise.
    """
    parts = df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_parts"))
    return df.join(_per_leaf(parts), "leaf").withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts"))).drop("_parts")


def _per_leaf(parts: DataFrame) -> DataFrame:
    """A table of one row per leaf, broadcast if one tree bounds its rows."""
    return F.broadcast(parts) if isinstance(parts.schema["leaf"].dataType, T.IntegerType) else parts


def pack_blocks(points: DataFrame, tree: Tree | Nested, extra: Sequence[str] = ()) -> DataFrame:
    """leaf, part, block: arrays of the points of one leaf, at most about ``BLOCK`` of them, sorted by vector and label."""
    cells = F.struct("v", "label", "w", *extra)
    split = _split(with_leaf(points, tree), BLOCK, F.col("v"))
    return split.groupBy("leaf", "part").agg(F.array_sort(F.collect_list(cells)).alias("block"))


def block_parts(points: DataFrame, tree: Tree | Nested) -> DataFrame:
    """leaf, parts: how many blocks :func:`pack_blocks` makes of each leaf."""
    return with_leaf(points, tree).groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))


def paired(chunks: DataFrame, blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """chunk, block: each chunk with each block of its leaf. A chunk first gets the list of its blocks and then meets them
    one by one on (leaf, part), so every pair is a row of its own and a large leaf is many keys."""
    asked = chunks.join(_per_leaf(parts), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return asked.select("leaf", F.col("part").cast("long").alias("part"), "chunk").join(blocks.withColumn("part", F.col("part").cast("long")), ["leaf", "part"]).select("chunk", "block")


def pack_chunks(queries: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """leaf, chunk: arrays of the queries that visit one leaf, at most about ``CHUNK`` of them."""
    split = _split(queries, CHUNK, F.col("v"))
    return split.groupBy("leaf", "part").agg(F.collect_list(F.struct("v", "label", *extra)).alias("chunk")).select("leaf", "chunk")


def visits(queries: DataFrame, tree: Tree | Nested, radius: Column, metric: str, p: float = 2.0, *, skip_own: bool = False) -> DataFrame:
    """One row per query and leaf within ``radius`` of it."""
    if isinstance(tree, Nested):
        asked = queries.withColumn("_reach", radius.cast("double"))
        if skip_own:
            asked = with_leaf(asked, tree).withColumnRenamed("leaf", "_own")
        top = visits(asked, tree.outer, F.col("_reach"), metric, p).withColumnRenamed("leaf", "top")
        found = _inside(top, tree, lambda inner, x, r: inner.near(x, r, metric, p), "_reach")
        return found.where(F.col("leaf") != F.col("_own")).drop("_reach", "_own") if skip_own else found.drop("_reach")
    if tree.leaves == 1:
        return queries.where(F.lit(not skip_own)).withColumn("leaf", _only_leaf())

    @F.pandas_udf("array<int>")
    def leaves(v: pd.Series, r: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, 1))
        own = tree.leaf_of(x) if skip_own else None
        found = tree.near(x, r.to_numpy(dtype=float), metric, p)
        return pd.Series([f[f != own[i]] if skip_own else f for i, f in enumerate(found)])

    return queries.withColumn("leaf", F.explode(leaves("v", radius.cast("double"))))


def unpack(cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, labels and weights (1 for queries) of a chunk or block."""
    v = np.array([np.asarray(c["v"], dtype=float) for c in cells])
    label = np.array([c["label"] for c in cells])
    w = np.array([c.get("w", 1) for c in cells])
    return v, label, w


_PAIR = "v array<double>, label int, d double, nv array<double>, nlabel int, w bigint"


def _compare(pairs: DataFrame, k: int, metric: str, p: float, exclude_self: bool) -> DataFrame:
    """The k best points of each block for each query of the chunks that visit it; ``pairs`` as :func:`paired` makes them."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, block in zip(batch["chunk"], batch["block"]):
                qv, ql, _ = unpack(chunk)
                x, xl, w = unpack(block)
                limit = np.array([c["radius"] for c in chunk]) if "radius" in chunk[0] else None
                d = distances(qv, x, metric, p)
                weight = np.broadcast_to(w, d.shape)
                if exclude_self:
                    own = (d == 0) & (ql[:, None] == xl[None, :])
                    weight = weight - own
                    d = np.where(weight > 0, d, np.inf)
                if limit is not None:
                    d = np.where(d <= limit[:, None], d, np.inf)
                edge = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                row, place = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
                if not len(row):
                    continue
                # Blocks are sorted, so the place in the block settles ties by vector, then label.
                order = np.lexsort((place, d[row, place], row))
                row, place = row[order], place[order]
                start = np.searchsorted(row, row)
                keep = np.arange(len(row)) - start < k
                row, place = row[keep], place[keep]
                yield pd.DataFrame({
                    "v": list(qv[row]), "label": ql[row], "d": d[row, place], "nv": list(x[place]),
                    "nlabel": xl[place], "w": weight[row, place],
                })

    return pairs.mapInPandas(best, _PAIR)


def _keep_k(found: DataFrame, k: int) -> DataFrame:
    """The nearest points of each query until their weights reach k; the last one counts only as far as needed."""
    order = W.partitionBy("v", "label").orderBy("d", "nv", "nlabel")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    before = F.coalesce(F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = top.withColumn("take", F.least(F.col("w"), F.lit(k) - before)).where(F.col("take") > 0)
    return taken.select("v", "label", "rank", "d", "nv", "nlabel", "take")


def nearest(
    queries: DataFrame, points: DataFrame, k: int, *, metric: str = "euclidean", p: float = 2.0, exclude_self: bool = False
) -> DataFrame:
    """v, label, rank, d, nv, nlabel, take: the k nearest points of each query, exact, ties by vector then label.

    ``points``: distinct (v, label) with weight w; ``queries``: distinct (v, label). ``take`` is the share of the
    neighbour's weight used, so that the takes of a query add up to k (or to all points there are).
    ``exclude_self`` leaves out one row equal to the query in vector and label.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    points = cut(points)
    tree = tree_for(points)
    blocks, parts = pack_blocks(points, tree), block_parts(points, tree)
    own = pack_chunks(with_leaf(queries, tree))
    if tree.leaves == 1:
        return _keep_k(_compare(paired(own, blocks, parts), k, metric, p, exclude_self), k)
    blocks = cut(blocks)
    first = cut(_keep_k(_compare(paired(own, blocks, parts), k, metric, p, exclude_self), k))
    reached = first.groupBy("v", "label").agg(
        F.when(F.sum("take") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("radius")
    )
    # A query whose own leaf held no other point has no row yet and must see every leaf.
    radius = queries.join(reached, ["v", "label"], "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    wider = cut(visits(radius, tree, F.col("radius"), metric, p, skip_own=True))
    second = _compare(paired(pack_chunks(wider, ["radius"]), blocks, parts), k, metric, p, exclude_self)
    again = first.select("v", "label", "d", "nv", "nlabel", F.col("take").alias("w"))
    return _keep_k(again.unionByName(second), k)


def weighted_points(df: DataFrame, vector: Column, label: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Distinct (v, label) with the number of rows w: the map-side combined form every search starts from."""
    label = F.lit(0) if label is None else label
    extra = extra or {}
    return df.select(vector.alias("v"), label.cast("int").alias("label"), *[e.alias(n) for n, e in extra.items()]).groupBy(
        "v", "label"
    ).agg(F.count(F.lit(1)).alias("w"), *[F.min(n).alias(n) for n in extra])


# --- neighbours that never leave the task that finds them ---------------------------------------------------------------

#: (query, neighbour, take) of some queries, as row numbers, by query and rank.
Lists = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _vectors(rows: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    column = rows.column("v")
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(-1, width)


def _cells(x: np.ndarray, rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """``rows`` of ``x`` in parts of at most ``size`` that lie together, by halving at the median of the widest dimension."""
    stack = [rows]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            yield rows
            continue
        part = x[rows]
        order = rows[np.argsort(part[:, int(np.argmax(part.max(0) - part.min(0)))] if x.shape[1] else np.arange(len(rows)), kind="stable")]
        stack += [order[len(order) // 2 :], order[: len(order) // 2]]


def _bounded_cells(x: np.ndarray, own: np.ndarray, asks: np.ndarray, k: int, metric: str, p: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, radius): the queries of each cell of the rows ``own``, and a distance within which each has k others at least."""
    for cell in _cells(x, own, max(CELL, 2 * (k + 1))):
        q = cell[asks[cell]]
        if len(q):
            yield q, np.partition(distances(x[q], x[cell], metric, p), k, 1)[:, k] if len(cell) > k else np.full(len(q), np.inf)


def _lists(x: np.ndarray, w: np.ndarray, own: np.ndarray, asks: np.ndarray, k: int, metric: str, p: float) -> Lists:
    """The nearest of the points ``x``, which are in order, to those of ``own`` that ask, until their weights reach k."""
    for q, radius in _bounded_cells(x, own, asks, k, metric, p):
        reach = radius.max() * (1 + 1e-9) + 1e-12
        near = np.ones(len(x), bool)
        for j in range(x.shape[1]):
            near &= (x[:, j] >= x[q, j].min() - reach) & (x[:, j] <= x[q, j].max() + reach)
        at = np.flatnonzero(near)
        for some in np.array_split(np.arange(len(q)), max(1, len(q) * len(at) >> 21)):
            d = distances(x[q[some]], x[at], metric, p)
            self = np.searchsorted(at, q[some])
            alone = w[q[some]] <= 1
            d[np.flatnonzero(alone), self[alone]] = np.inf
            edge = np.partition(d, k - 1, 1)[:, k - 1] if len(at) > k else np.full(len(d), np.inf)
            row, place = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
            order = np.lexsort((place, d[row, place], row))  # points are in order, so the place settles ties
            row, place = row[order], place[order]
            weight = w[at[place]] - (place == self[row])
            upto = np.cumsum(weight)
            start = np.searchsorted(row, row)
            take = np.minimum(weight, k - (upto - weight - (upto - weight)[start]))
            keep = take > 0
            yield q[some][row[keep]], at[place[keep]], take[keep]


def _meeting(tree: Tree, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each point of ``x`` and each leaf whose box ``low``, ``high`` holds it."""
    inner = tree.dim >= 0
    lows, highs = (np.empty((len(tree.dim), x.shape[1])) for _ in range(2))
    lows[~inner], highs[~inner] = low[tree.left[~inner]], high[tree.left[~inner]]
    for n in np.flatnonzero(inner)[::-1]:  # children come after their parent
        a, b = tree.left[n], tree.right[n]
        lows[n], highs[n] = np.minimum(lows[a], lows[b]), np.maximum(highs[a], highs[b])
    row, node, found = np.arange(len(x)), np.zeros(len(x), dtype=int), []
    while len(row):
        inside = ((x[row] >= lows[node]) & (x[row] <= highs[node])).all(1)
        row, node = row[inside], node[inside]
        leaf = ~inner[node]
        found.append((row[leaf], tree.left[node[leaf]]))
        row, node = row[~leaf], node[~leaf]
        row, node = np.r_[row, row], np.r_[tree.left[node], tree.right[node]]
    return tuple(np.concatenate(c).astype(np.int64) if found else np.empty(0, np.int64) for c in zip(*found)) if found else (row, row)


def _by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Each leaf with the pieces of its rows, of batches in order of leaves."""

    def pieces():
        for b in batches:
            leaf = np.asarray(b.column("leaf"))
            edges = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True]) if len(leaf) else []
            for i, j in itertools.pairwise(edges):
                yield int(leaf[i]), b.slice(i, j - i)

    for leaf, group in itertools.groupby(pieces(), key=lambda x: x[0]):
        yield leaf, (b for _, b in group)


def fold_nearest(
    points: DataFrame, k: int, fold: Callable[[pa.Table, Lists], Iterator[pa.RecordBatch]], schema: str, *, metric: str = "euclidean", p: float = 2.0, seed: int = 42
) -> DataFrame:
    """The rows that ``fold`` makes of points and their k nearest others: those of :func:`nearest` with ``exclude_self``.

    ``points``: distinct v, weight w, asks, and what ``fold`` reads; read several times. A leaf's points come to a task
    with those of other leaves near enough to be neighbours, so lists of neighbours are neither sent nor kept. In many
    dimensions all points are near; a task holds about HELD of them and drops those in no list so far.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    n, width = points.count(), len((points.select("v").first() or [[]])[0])
    columns, cores = points.columns, 4 * points.sparkSession.sparkContext.defaultParallelism
    leaves = max(1, min(MAX_LEAVES, max(-(-n // GROUP), min(-(-n // BLOCK), cores))))
    share = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < F.lit(round(min(1.0, 64 * leaves / max(n, 1)) * (1 << 30)))
    drawn = points.where(share).select("v").toPandas()["v"] if leaves > 1 else []
    tree = grow_tree(np.stack(drawn.to_numpy()) if len(drawn) else np.zeros((1, width)), leaves)

    def dealt(df: DataFrame, *order: str) -> DataFrame:
        return df.repartition(tree.leaves, "leaf").sortWithinPartitions("leaf", *order)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf, pieces in _by_leaf(batches):
            rows = pa.Table.from_batches(pieces)
            x, asks = _vectors(rows, width), np.asarray(rows.column("asks"))
            low, high = np.full(width, np.inf), np.full(width, -np.inf)
            for q, radius in _bounded_cells(x, np.arange(len(x)), asks, k, metric, p):
                r = (radius * (1 + 1e-9) + 1e-12)[:, None]
                low, high = np.minimum(low, (x[q] - r).min(0)), np.maximum(high, (x[q] + r).max(0))
            yield pa.RecordBatch.from_arrays([pa.array([leaf]), pa.array([low.tolist()]), pa.array([high.tolist()])], ["leaf", "low", "high"])

    low, high = np.full((tree.leaves, width), np.inf), np.full((tree.leaves, width), -np.inf)
    if tree.leaves > 1:
        for r in dealt(with_leaf(points.select("v", "asks"), tree)).mapInArrow(reach, "leaf long, low array<double>, high array<double>").collect():
            low[r.leaf], high[r.leaf] = r.low, r.high

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b, width)
            own = tree.leaf_of(x)
            row, leaf = _meeting(tree, low, high, x)
            other = leaf != own[row]
            row, leaf = np.r_[np.arange(len(x)), row[other]], np.r_[own, leaf[other]]
            out = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(leaf, pa.int32()), pa.array(np.arange(len(row)) >= len(x))], [*columns, "leaf", "foreign"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in _by_leaf(batches):
            held, limit = [], HELD
            for piece in pieces:
                held.append(piece)
                if sum(h.num_rows for h in held) > limit and piece.column("foreign")[-1].as_py():
                    rows, x, own, asks = ready(held)
                    needed = ~np.asarray(rows.column("foreign"))
                    for _, near, _ in _lists(x, np.asarray(rows.column("w")), own, asks, k, metric, p):
                        needed[near] = True
                    held = rows.filter(pa.array(needed)).to_batches()
                    limit = max(HELD, 2 * int(needed.sum()))
            rows, x, own, asks = ready(held)
            yield from fold(rows, _lists(x, np.asarray(rows.column("w")), own, asks, k, metric, p))

    def ready(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """Rows in order of their vectors, the vectors, which rows are the leaf's own, which ask."""
        rows = pa.Table.from_batches(held)
        x = _vectors(rows, width)
        order = np.lexsort(x.T[::-1]) if width else np.arange(len(x))
        rows, x = rows.take(pa.array(order)), x[order]
        return rows, x, np.flatnonzero(~np.asarray(rows.column("foreign"))), np.asarray(rows.column("asks"))

    sent_schema = T.StructType([*points.schema.fields, T.StructField("leaf", T.IntegerType()), T.StructField("foreign", T.BooleanType())])
    return dealt(points.mapInArrow(send, sent_schema), "foreign").mapInArrow(search, schema)
