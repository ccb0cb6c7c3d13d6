"""k-means for many starts at once: every pass over the table serves all starts.

Points are distinct vectors with weights, laid out in leaves of neighbouring points with their boxes and sums. A pass brings
each leaf to its nearest centres; where the box has only one of them in reach, the leaf's sums are added as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.session import scratch_path, spread

#: Points in a leaf, and points that are dealt out to leaves at once.
LEAF, AT_ONCE = 512, 200_000

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


def _uniform(x: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) for each point, a function of its values and the number of the draw."""
    h = np.full(len(x), draw + 1, np.uint64) * _ODD[1]
    for j in range(x.shape[1]):
        h = _mixed(h + (x[:, j] + 0.0).view(np.uint64) * _ODD[1])
    return ((_mixed(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def split(x: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of leaves: halves along the widest attribute until at most LEAF points are left."""
    open_ = [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF:
            yield rows
            continue
        part = x[rows]
        order = np.argpartition(part[:, np.ptp(part, 0).argmax()], len(rows) // 2)
        open_ += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]


def leaves_of(b: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points, weights) of each leaf of a batch."""
    for i in range(b.num_rows):
        yield np.frombuffer(b.column(0)[i].as_py()).reshape(-1, width), np.frombuffer(b.column(1)[i].as_py())


class Leaves:
    """The written leaves of ``points(v array<double>, w)``."""

    def __init__(self, points: DataFrame, width: int):
        self.width, self.spark = width, points.sparkSession

        def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            xs, ws, size = [], [], 0

            def leaves() -> pa.RecordBatch:
                x, w = np.concatenate(xs), np.concatenate(ws)
                out = [(x[r].tobytes(), w[r].tobytes()) for r in split(x)]
                return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.binary()) for i in range(2)], ["x", "w"])

            for b in parts:
                xs.append(np.asarray(b.column(0).flatten(), np.float64).reshape(-1, width))
                ws.append(np.asarray(b.column(1)).astype(np.float64))
                size += b.num_rows
                if size >= AT_ONCE:
                    yield leaves()
                    xs, ws, size = [], [], 0
            if size:
                yield leaves()

        path = scratch_path(self.spark, "kmeans-leaves")
        spread(points.select("v", "w"), "v").mapInArrow(each, "x binary, w binary").write.parquet(path)
        self.table = self.spark.read.schema("x binary, w binary").parquet(path)

    def variance(self) -> float:
        """Mean over the attributes of their variance."""
        width = self.width

        def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, width))
            mass = 0.0
            for b in parts:
                for x, w in leaves_of(b, width):
                    total += np.stack([w @ x, w @ (x * x)])
                    mass += w.sum()
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total[0]), pa.array(total[1]), pa.array([mass] * width)], ["j", "s", "q", "m"])

        got = self.table.mapInArrow(sums, "j int, s double, q double, m double").groupBy("j").agg(F.sum("s"), F.sum("q"), F.sum("m")).collect()
        return float(np.mean([max(0.0, q / m - (s / m) ** 2) for _, s, q, m in got if m] or [0.0]))

    def draw(self, centres: list[np.ndarray], number: int, seed: int, *, spread: bool, count: int = 1) -> list[np.ndarray]:
        """For each start ``count`` further points, drawn with probability by weight and, if ``spread``, by squared distance to
        the start's centres: the points first to come in a race of exponential times. One pass, ``count`` rows per task and start."""
        width, k = self.width, len(centres)

        def race(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first: list[list[tuple]] = [[] for _ in range(k)]
            for b in parts:
                for x, w in leaves_of(b, width):
                    for s in range(k):
                        mass = w * nearest(x, centres[s])[1] if spread and len(centres[s]) else w
                        time = np.divide(-np.log(_uniform(x, ((seed + s) << 16) + number)), mass, out=np.full(len(x), np.inf), where=mass > 0)
                        take = np.argsort(time, kind="stable")[:count]
                        first[s] = sorted([*first[s], *((float(time[i]), x[i].tolist()) for i in take if np.isfinite(time[i]))])[:count]
            rows = [(s, t, x) for s in range(k) for t, x in first[s]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["s", "t", "x"])

        rows = self.table.mapInArrow(race, "s int, t double, x array<double>")
        best = rows.groupBy("s").agg(F.slice(F.array_sort(F.collect_list(F.struct("t", "x"))), 1, count).alias("c")) if count > 1 else rows.groupBy("s").agg(F.array(F.min(F.struct("t", "x"))).alias("c"))
        found = {r.s: np.array([c.x for c in r.c]).reshape(-1, width) for r in best.collect()}
        return [found.get(s, np.empty((0, width))) for s in range(k)]

    def step(self, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
        """{start: (sums, weights, cost)} of the points nearest to each of the start's centres, for all starts in one pass."""
        width = self.width
        sent = self.spark.sparkContext.broadcast(centres)

        def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = sent.value
            sums = {s: np.zeros((len(c), width + 2)) for s, c in now.items()}
            for b in parts:
                for x, w in leaves_of(b, width):
                    low, high = x.min(0), x.max(0)
                    whole = None
                    for s, c in now.items():
                        least = np.maximum(np.maximum(low - c, c - high), 0)
                        most = np.maximum(np.abs(c - low), np.abs(c - high))
                        reach = np.flatnonzero((least * least).sum(1) <= (most * most).sum(1).min())
                        if len(reach) == 1:
                            if whole is None:
                                whole = np.r_[w @ x, w.sum()], float(w @ (x * x).sum(1))
                            at, centre = reach[0], c[reach[0]]
                            sums[s][at, :-1] += whole[0]
                            sums[s][at, -1] += max(0.0, whole[1] - 2 * centre @ whole[0][:-1] + whole[0][-1] * centre @ centre)
                            continue
                        near, d = nearest(x, c[reach])
                        for i in np.unique(near):
                            m = near == i
                            sums[s][reach[i]] += np.r_[w[m] @ x[m], w[m].sum(), w[m] @ d[m]]
            rows = [(s, i, *v) for s, t in sums.items() for i, v in enumerate(t.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.float64()) for i in range(width + 4)], names)

        values = [f"v{j}" for j in range(width + 2)]
        names = ["s", "i", *values]
        out = self.table.mapInArrow(assign, "s int, i int, " + ", ".join(f"{v} double" for v in values))
        got: dict[int, np.ndarray] = {s: np.zeros((len(c), width + 2)) for s, c in centres.items()}
        for r in out.groupBy("s", "i").agg(*[F.sum(v) for v in values]).collect():
            got[r[0]][r[1]] = r[2:]
        return {s: (t[:, :-2], t[:, -2], float(t[:, -1].sum())) for s, t in got.items()}


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance to it) of each point, the first centre on ties."""
    best, near = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for i, c in enumerate(centres):
        d = ((x - c) ** 2).sum(1)
        less = d < best
        best[less], near[less] = d[less], i
    return near, best


def fit(points: DataFrame, width: int, *, k: int, max_iterations: int, n_init: int, init_method: str, seed: int, tolerance: float = 1e-4) -> np.ndarray:
    """The centres of the start with the lowest cost, in ascending order. ``points(v, w)`` are weighted vectors.

    A start ends when its centres together move by at most ``tolerance`` of the mean variance (squared), or after
    ``max_iterations``. The best one then goes on until no centre moves. A centre without points stays where it is; fewer
    distinct points than ``k`` give as many centres.
    """
    leaves = Leaves(points, width)
    starts = [np.empty((0, width)) for _ in range(n_init)]
    if init_method == "random":
        starts = leaves.draw(starts, 0, seed, spread=False, count=k)
    else:
        for number in range(k):
            more = leaves.draw(starts, number, seed, spread=number > 0)
            starts = [np.concatenate([a, b]) for a, b in zip(starts, more)]
    enough = leaves.variance() * tolerance
    live, cost = {s: c for s, c in enumerate(starts) if len(c)}, {s: np.inf for s in range(n_init)}
    left = dict.fromkeys(live, max_iterations)
    centres = dict(live)

    def move(now: dict[int, np.ndarray]) -> dict[int, float]:
        moved = {}
        for s, (sums, mass, cost[s]) in leaves.step(now).items():
            new = np.where(mass[:, None] > 0, sums / np.where(mass > 0, mass, 1)[:, None], now[s])
            moved[s] = float(((new - now[s]) ** 2).sum())
            centres[s] = new
            left[s] -= 1
        return moved

    while live:
        moved = move(live)
        live = {s: centres[s] for s in live if moved[s] > enough and left[s] > 0}
    if not centres:
        return np.empty((0, width))
    best = min(centres, key=lambda s: (cost[s], s))
    while left[best] > 0 and move({best: centres[best]})[best] > 1e-6 * enough:
        pass
    return np.array(sorted(centres[best].tolist()))
