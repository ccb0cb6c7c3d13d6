"""L-BFGS over a whole table: gradients are sums that tasks add up in a tree, the driver holds parameters only."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.session import scratch_path, spread

#: Parameters in a piece of a gradient, and tasks whose pieces meet in the first of two rounds of sums.
PIECE, FAN = 1 << 16, 64
#: Bytes of sums that come straight from the tasks to the driver; more meet in those two rounds.
DIRECT = 32 << 20
#: Corrections that stand for the curvature, and trials of a line search.
MEMORY, TRIALS = 10, 25
#: What a step must gain, and how far the slope must flatten (Wolfe).
GAIN, FLAT = 1e-4, 0.9


def summed(table: DataFrame, tasks: int, size: int, each: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of the ``size`` numbers that ``each`` makes of the task's batches: one job."""

    def own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = each(parts)
        pieces = range(0, size, PIECE)
        task = [TaskContext.get().partitionId() % FAN] * len(pieces)
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array(task, pa.int32()), pa.array([total[p : p + PIECE].tobytes() for p in pieces], pa.binary())], ["piece", "task", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in group.column("sums"))
        return pa.table({"piece": group.column("piece")[:1], "task": group.column("task")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "piece int, task int, sums binary"
    parts = table.mapInArrow(own, schema)
    if tasks * size * 8 > DIRECT:
        parts = parts.groupBy("piece", "task").applyInArrow(add, schema).groupBy("piece").applyInArrow(add, schema)
    found = np.zeros(size)
    for r in parts.collect():
        found[r.piece : r.piece + PIECE] += np.frombuffer(bytes(r.sums))
    return found


class SummedGradient:
    """Value and gradient of a sum over the rows of ``shards(cells)``: one job per call.

    ``each(parameters, x, y, w)`` gives the value and the gradient summed over the rows of one shard. The shards are written
    once as plain numbers.
    """

    def __init__(self, shards: DataFrame, width: int, each: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray]]):
        self.each, self.width, self.spark = each, width, shards.sparkSession
        plain = shards.select(F.flatten("cells.x").alias("x"), F.col("cells.y").alias("y"), F.col("cells.w").alias("w"))
        path = scratch_path(self.spark, "gradient-shards")
        spread(plain).write.parquet(path)
        self.table = self.spark.read.schema(plain.schema).parquet(path)
        self.tasks = self.table.rdd.getNumPartitions()
        self.rows = self.table.agg(F.sum(F.aggregate("w", F.lit(0.0), lambda a, b: a + b))).first()[0] or 0.0

    def __call__(self, at: np.ndarray) -> tuple[float, np.ndarray]:
        each, width, size = self.each, self.width, len(at)
        sent = self.spark.sparkContext.broadcast(at)

        def own(parts: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(size + 1)
            for b in parts:
                for i in range(b.num_rows):
                    x, y, w = (np.asarray(b.column(c)[i].values, float) for c in range(3))
                    value, gradient = each(sent.value, x.reshape(-1, width), y, w)
                    total[0] += value
                    total[1:] += gradient
            return total

        found = summed(self.table, self.tasks, size + 1, own)
        sent.unpersist()
        return float(found[0]), found[1:]


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, *, max_iter: int, tol: float) -> tuple[np.ndarray, list[float]]:
    """(place, values on the way) of a minimum of ``f``, which gives value and gradient.

    Two-loop recursion over the last MEMORY steps; a step is doubled or halved until it gains enough and the slope is flatter.
    Ends when no entry of the gradient exceeds ``tol``, the value stops falling, or after ``max_iter`` steps.
    """
    x = start.astype(float)
    value, slope = f(x)
    values, steps = [value], []
    for _ in range(max_iter):
        if np.abs(slope).max(initial=0) <= tol:
            break
        direction = -_applied(steps, slope)
        fall = float(direction @ slope)
        if fall >= 0:  # curvature that no longer fits
            steps, direction = [], -slope
            fall = float(direction @ slope)
        low, high, length = 0.0, None, 1.0 if steps else min(1.0, 1 / np.abs(slope).sum())
        best = None
        for _ in range(TRIALS):
            there = x + length * direction
            new, new_slope = f(there)
            if not np.isfinite(new) or new > value + GAIN * length * fall:
                high = length
            else:
                best = (there, new, new_slope)
                if new_slope @ direction >= FLAT * fall:
                    break
                low = length
            length = 2 * length if high is None else (low + high) / 2
        if best is None:
            break
        there, new, new_slope = best
        moved, turned = there - x, new_slope - slope
        if moved @ turned > 1e-12 * (turned @ turned):
            steps = [*steps, (moved, turned)][-MEMORY:]
        gained = value - new
        x, value, slope = there, new, new_slope
        values.append(value)
        if gained <= 1e-12 * max(1.0, abs(value)):
            break
    return x, values


def _applied(steps: list[tuple[np.ndarray, np.ndarray]], slope: np.ndarray) -> np.ndarray:
    """The inverse curvature that ``steps`` (move, change of slope) tell, applied to ``slope``."""
    out, factors = slope.copy(), []
    for s, y in reversed(steps):
        a = (s @ out) / (s @ y)
        factors.append(a)
        out -= a * y
    if steps:
        s, y = steps[-1]
        out *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(factors)):
        out += (a - (y @ out) / (s @ y)) * s
    return out


#: What a line search of :func:`orthant_steps` tries: times, growth of a step, least and largest step.
SEARCHES, GROWTH, SHORTEST, LONGEST = 20, 2.1, 1e-10, 1e10
#: Values whose largest must be near the last one for it to end.
RECENT = 20


def orthant_steps(size: int, *, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS steps from 0 that stay within an orthant: yields places, is sent value and gradient, returns the last place.

    These are the steps of Spark's linear support vector classifier (Andrew and Gao 2007, without the penalty): entries of a
    direction that climb are 0, and so are entries of a place that would change their sign.
    """
    x = np.zeros(size)
    value, slope = yield x
    first, values, steps, failed = value, [np.inf], [], False
    for turn in range(max_iter):
        if np.linalg.norm(slope) <= max(tol * abs(value), 1e-8) or abs(value - max(values)) <= tol * abs(first):
            break
        while True:
            there = None
            if not steps or not steps[-1][0] @ steps[-1][1] < 0:
                direction = -_applied(steps, slope)
                if np.isfinite(direction).all():
                    there = yield from _searched(x, value, slope, np.where(direction * slope < 0, direction, 0.0), turn)
            if there is not None or failed:
                break
            failed, steps = True, []
        if there is None:
            break
        failed = False
        place, new, new_slope = there
        steps = [*steps, (place - x, new_slope - slope)][-MEMORY:]
        x, value, slope = place, new, new_slope
        values = [*values, value][-RECENT:]
    return x


def _searched(x: np.ndarray, value: float, slope: np.ndarray, direction: np.ndarray, turn: int):
    """(place, value, gradient) along ``direction`` by the strong Wolfe conditions, None if there is none."""
    fall, orthant = direction @ slope, np.where(x != 0, np.sign(x), np.sign(-slope))
    shrink = 0.1 if turn < 1 else 0.5
    length = shrink * (0.5 / np.linalg.norm(slope) if turn < 1 else 1.0)  # that solver shrinks its first length unseen
    for _ in range(SEARCHES):
        if not SHORTEST <= length <= LONGEST:
            return None
        place = x + direction * length
        place = np.where(np.sign(place) == orthant, place, 0.0)
        new, new_slope = yield place
        along = new_slope @ direction
        if new > value + length * fall * GAIN:
            length *= shrink
        elif along < FLAT * fall:
            length *= GROWTH
        elif along > -FLAT * fall:
            length *= shrink
        else:
            return place, new, new_slope
    return None
