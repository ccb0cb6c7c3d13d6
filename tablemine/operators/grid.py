"""Neighbourhood filters on ordered series and on rasters in long form.

A series is (series, order, value); a raster is (grid, channel, y, x, value) with every cell present and coordinates
from 0. Filters are window functions. A long series or raster line is cut into chunks of ``CHUNK`` positions, each
with copies of the few cells around it, so one line never has to fit one task. Edges mirror (d c b a | a b c d | d c
b a) except where a filter counts the outside as 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablemine.domain import col
from tablemine.functions.ordering import cumulative

#: Positions of one line handled together.
CHUNK = 100_000

CELL = ("grid", "channel", "y", "x")


def _padded(df: DataFrame, place: str, size: Column, reach: int, mirror: bool) -> DataFrame:
    """Copies of the cells a window of ``reach`` may need: mirrored ones past the edges, and halo ones per chunk.

    Adds ``_p`` (position, may lie outside the line), ``_chunk`` and ``_own`` (the cell itself, not a copy). Cell i
    of a line of n shows at every position congruent to i or to -1 - i modulo 2n.
    """
    here = F.col(place).cast("long")
    if mirror:
        def shown(first: Column) -> Column:
            low = F.ceil((-F.lit(reach) - first) / (2 * size))
            high = F.floor((size + F.lit(reach - 1) - first) / (2 * size))
            return F.when(low <= high, F.transform(F.sequence(low, high), lambda k: first + 2 * size * k)).otherwise(
                F.array().cast("array<bigint>")
            )

        places = F.concat(shown(here), shown(-1 - here))
        df = df.withColumn("_p", F.explode(places)).withColumn("_inside", (F.col("_p") >= 0) & (F.col("_p") < size))
    else:
        df = df.withColumn("_p", here).withColumn("_inside", F.lit(True))
    top = F.greatest(F.floor((size - 1) / CHUNK), F.lit(0))
    clip = lambda e: F.greatest(F.least(F.floor(e / CHUNK), top), F.lit(0))
    near = F.sequence(clip(F.col("_p") - reach), clip(F.col("_p") + reach))
    spread = df.withColumn("_chunk", F.explode(near))
    return spread.withColumn("_own", F.col("_inside") & (F.col("_chunk") == clip(F.col("_p")))).drop("_inside")


def _over_line(
    df: DataFrame, line: Sequence[str], place: str, size: Column, reach: int, mirror: bool, results: Callable[[object], dict[str, Column]]
) -> DataFrame:
    """Add window results along a line. ``results`` maps the window (ordered, per line and chunk) to new columns."""
    padded = _padded(df, place, size, reach, mirror)
    window = W.partitionBy(*[col(c) for c in line], "_chunk").orderBy("_p")
    return padded.withColumns(results(window)).where("_own").drop("_p", "_chunk", "_own")


def gaussian_weights(sigma: float) -> list[float]:
    """Weights at offsets 0..r with r = int(4 sigma + 0.5), both sides summing to 1."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(radius + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [w / total for w in raw]


def _filter(kind: str, value: str, sigma: float, size: int) -> tuple[int, Callable[[object], Column]]:
    """How far a filter reaches, and its value over a window."""
    if kind == "gaussian":
        weights = gaussian_weights(sigma)

        def smooth(w) -> Column:
            total = F.lit(weights[0]) * col(value)
            for i, g in enumerate(weights[1:], 1):
                total = total + F.lit(g) * (F.lag(value, i).over(w) + F.lead(value, i).over(w))
            return total

        return len(weights) - 1, smooth
    before, after = size // 2, size - size // 2 - 1
    frame = {"max": F.max, "min": F.min, "mean": F.avg}
    if kind not in frame:
        raise ValueError(f"unknown filter {kind!r}; known: gaussian, max, min, mean")
    return max(before, after), lambda w: frame[kind](value).over(w.rowsBetween(-before, after))


def roll(
    df: DataFrame, *, series: str, order: str, value: str, kind: str = "gaussian", sigma: float = 2.0, size: int = 3, ties: Sequence[str] = ()
) -> DataFrame:
    """series, order, value, filtered: 1-D gaussian, max, min or mean along each series, one row for every row of ``df``.

    Rows of one order value stand in the order of the columns ``ties``, then of the value. A missing order is an error.
    """
    if not df.where(col(order).isNull()).isEmpty():
        raise ValueError(f"column {order!r} has rows without a place in their series")
    rows = df.select(col(series), col(order), col(value).cast("double").alias("_v"), F.struct(*[col(t) for t in ties], F.lit(0)).alias("_tie"))
    steps = cumulative(rows, order, by=[series], sums={"n": F.count(F.lit(1)), "v": F.max("_v")})
    place = [F.col("n_before").alias("_i"), F.col("n_total").alias("_size")]
    if steps.where("n > 1").isEmpty():
        run = steps.select(col(series), col(order), F.col("v"), *place)
    else:
        same = W.partitionBy(col(series), col(order)).orderBy("_tie", "_v")
        known = steps.select(col(series).alias("_s"), col(order).alias("_o"), *place)
        each = rows.withColumn("_k", F.row_number().over(same) - 1)
        each = each.join(known, col(series).eqNullSafe(F.col("_s")) & (col(order) == F.col("_o")))
        run = each.select(col(series), col(order), F.col("_v").alias("v"), (F.col("_i") + F.col("_k")).alias("_i"), "_size")
    reach, expression = _filter(kind, "v", sigma, size)
    out = _over_line(run, [series], "_i", F.col("_size"), reach, True, lambda w: {"filtered": expression(w)})
    return out.select(col(series), col(order), F.col("v").alias(value), "filtered")


def _sized(df: DataFrame) -> DataFrame:
    """Add the height and width of each grid, from one combined aggregate."""
    extent = df.groupBy("grid").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    return df.select(*CELL, F.col("value").cast("double").alias("value")).join(extent, "grid")


_ROW, _COLUMN = ("grid", "channel", "y"), ("grid", "channel", "x")


def _both_axes(df: DataFrame, kind: str, sigma: float, size: int) -> DataFrame:
    reach, expression = _filter(kind, "value", sigma, size)
    step = lambda w: {"value": expression(w)}
    down = _over_line(df, _COLUMN, "y", F.col("_h"), reach, True, step)
    return _over_line(down, _ROW, "x", F.col("_w"), reach, True, step)


def grid_filter(df: DataFrame, *, kind: str = "gaussian", sigma: float = 2.0, size: int = 3, percentile: float = 50) -> DataFrame:
    """2-D gaussian, mean, max, min (two passes along the axes), median, percentile, sobel or prewitt.

    Rank filters take the element at floor(size^2 * percentile / 100) of the sorted window. Sobel and prewitt give
    the length of the gradient and count the outside as 0.
    """
    cells = _sized(df)
    if kind in ("gaussian", "mean", "max", "min"):
        out = _both_axes(cells, kind, sigma, size)
    elif kind in ("median", "percentile"):
        before, after = size // 2, size - size // 2 - 1
        reach, frame = max(before, after), lambda w: w.rowsBetween(-before, after)
        rows = _over_line(cells, _ROW, "x", F.col("_w"), reach, True, lambda w: {"_line": F.collect_list("value").over(frame(w))})
        boxes = _over_line(rows, _COLUMN, "y", F.col("_h"), reach, True, lambda w: {"_box": F.collect_list("_line").over(frame(w))})
        rank = size * size // 2 if kind == "median" else min(int(size * size * percentile / 100), size * size - 1)
        out = boxes.withColumn("value", F.get(F.sort_array(F.flatten("_box")), F.lit(rank)))
    elif kind in ("sobel", "prewitt"):
        out = _gradient(cells, 2.0 if kind == "sobel" else 1.0)
    else:
        raise ValueError(f"unknown filter {kind!r}")
    return out.select(*CELL, "value")


def _around(value: str, w) -> tuple[Column, Column]:
    return F.coalesce(F.lag(value).over(w), F.lit(0.0)), F.coalesce(F.lead(value).over(w), F.lit(0.0))


def _gradient(cells: DataFrame, centre: float) -> DataFrame:
    def along_x(w):
        a, b = _around("value", w)
        return {"_d": b - a, "_s": a + F.lit(centre) * F.col("value") + b}

    def along_y(w):
        (da, db), (sa, sb) = _around("_d", w), _around("_s", w)
        return {"_gx": da + F.lit(centre) * F.col("_d") + db, "_gy": sb - sa}

    rows = _over_line(cells, _ROW, "x", F.col("_w"), 1, False, along_x)
    both = _over_line(rows, _COLUMN, "y", F.col("_h"), 1, False, along_y)
    return both.withColumn("value", F.hypot("_gx", "_gy"))


def _reached(cells: DataFrame, n: int) -> DataFrame:
    """``cells`` with ``_far``: the city-block distance to the nearest cell with ``_site``, or more than ``n`` if none is that near.

    Two passes, along rows and along columns. In each the distance is the least of the way to what lies before and what lies
    behind, which are running minima from both ends of the chunk, so neither work nor shuffles grow with ``n``.
    """
    out = cells.withColumn("_far", F.when(F.col("_site"), 0).otherwise(n + 1).cast("long"))
    for line, place, size in ((_ROW, "x", "_w"), (_COLUMN, "y", "_h")):
        padded = _padded(out, place, F.col(size), n, False)
        chunk = W.partitionBy(*[col(c) for c in line], "_chunk")
        upto = lambda order: chunk.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        before = F.min(F.col("_far") - F.col("_p")).over(upto(F.col("_p").asc())) + F.col("_p")
        behind = F.min(F.col("_far") + F.col("_p")).over(upto(F.col("_p").desc())) - F.col("_p")
        out = padded.withColumn("_near", F.least(before, behind)).where("_own").drop("_p", "_chunk", "_own", "_far").withColumnRenamed("_near", "_far")
    return out


def _morphed(cells: DataFrame, grows: bool, n: int) -> DataFrame:
    """``n`` steps of growing or shrinking with a cross: what lies within city-block distance ``n`` of a one, or of no zero and
    not of the outside. Shortest ways within a raster never leave it, so steps and distance agree."""
    if grows:
        return _reached(cells.withColumn("_site", F.col("value") != 0), n).withColumn("value", (F.col("_far") <= n).cast("double")).drop("_far", "_site")
    found = _reached(cells.withColumn("_site", F.col("value") == 0), n)
    outside = F.least(F.col("y") + 1, F.col("x") + 1, F.col("_h") - F.col("y"), F.col("_w") - F.col("x"))
    return found.withColumn("value", ((F.col("_far") > n) & (outside > n)).cast("double")).drop("_far", "_site")


def grid_morph(df: DataFrame, *, kind: str = "dilate", iterations: int = 1) -> DataFrame:
    """Binary dilate, erode, open, close with a cross-shaped neighbourhood (non-zero is 1, outside 0), as if
    repeated ``iterations`` times per step, by two passes along the axes; or gradient: maximum minus minimum of the 3 x 3 box."""
    cells = _sized(df)
    if kind == "gradient":
        high = _both_axes(cells, "max", 0, 3).select(*CELL, F.col("value").alias("_hi"))
        low = _both_axes(cells, "min", 0, 3).select(*CELL, F.col("value").alias("_lo"))
        return high.join(low, list(CELL)).select(*CELL, (F.col("_hi") - F.col("_lo")).alias("value"))
    steps = {"dilate": [True], "erode": [False], "open": [False, True], "close": [True, False]}
    if kind not in steps:
        raise ValueError(f"unknown morphology {kind!r}")
    out = cells.withColumn("value", (F.col("value") != 0).cast("double"))
    for grows in steps[kind]:
        out = _morphed(out, grows, iterations)
    return out.select(*CELL, "value")


def grid_measure(df: DataFrame) -> DataFrame:
    """grid, channel, sum, mean, variance (population), sd, min, max and the centre of mass (centre_y, centre_x)."""
    v = F.col("value").cast("double")
    total = F.sum(v)
    return df.groupBy("grid", "channel").agg(
        total.alias("sum"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("sd"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.when(total != 0, F.sum(v * F.col("y")) / total).alias("centre_y"),
        F.when(total != 0, F.sum(v * F.col("x")) / total).alias("centre_x"),
    )


def grid_shift(df: DataFrame, dy: int, dx: int) -> DataFrame:
    """Move by whole cells; what moves in from outside is 0. Cells are rewritten in place, with no join of cells."""
    cells = _sized(df)
    inside = lambda y, x: (y >= 0) & (y < F.col("_h")) & (x >= 0) & (x < F.col("_w"))
    to_y, to_x = F.col("y") + dy, F.col("x") + dx
    moved = F.when(inside(to_y, to_x), F.struct(to_y.alias("y"), to_x.alias("x"), F.col("value")))
    vacated = F.when(~inside(F.col("y") - dy, F.col("x") - dx), F.struct("y", "x", F.lit(0.0).alias("value")))
    out = cells.select("grid", "channel", F.explode(F.array_compact(F.array(moved, vacated))).alias("_c"))
    return out.select("grid", "channel", "_c.y", "_c.x", "_c.value")


def grid_zoom(df: DataFrame, factor: float) -> DataFrame:
    """Bilinear resampling: n cells become round(n * factor), corners stay corners.

    Every cell adds its weighted value to the target cells around it; one combined sum per target.
    """
    cells = _sized(df)

    def targets(place: str, size: str) -> Column:
        n = F.col(size).cast("double")
        out = F.greatest(F.rint(n * factor), F.lit(1.0))
        step = F.when(out > 1, (n - 1) / (out - 1)).otherwise(0.0)
        here = F.col(place).cast("double")
        low = F.when(step > 0, F.greatest(F.ceil((here - 1) / step), F.lit(0))).otherwise(0)
        high = F.when(step > 0, F.least(F.floor((here + 1) / step), out - 1)).otherwise(out - 1)
        spots = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
        weighted = F.transform(spots, lambda i: F.struct(i.alias("i"), (1 - F.abs(i * step - here)).alias("w")))
        return F.filter(weighted, lambda s: s["w"] > 0)

    spread = cells.withColumn("_ty", F.explode(targets("y", "_h"))).withColumn("_tx", F.explode(targets("x", "_w")))
    return spread.groupBy("grid", "channel", F.col("_ty.i").alias("y"), F.col("_tx.i").alias("x")).agg(
        F.sum(F.col("value") * F.col("_ty.w") * F.col("_tx.w")).alias("value")
    )


def grid_channel(df: DataFrame, c: int) -> DataFrame:
    """One channel of each grid, channel 0 where the grid has no such channel."""
    present = df.groupBy("grid").agg(F.max((F.col("channel") == c).cast("int")).alias("_has"))
    return df.join(present, "grid").where(F.col("channel") == F.when(F.col("_has") == 1, c).otherwise(0)).select(*CELL, "value")


def grid_rescale(df: DataFrame) -> DataFrame:
    """Each grid stretched to whole numbers 0..255; a flat grid is cut to whole numbers."""
    span = df.groupBy("grid").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    v, lo, hi = F.col("value").cast("double"), F.col("_lo"), F.col("_hi")
    value = F.when(hi > lo, F.floor(255.0 * (v - lo) / (hi - lo))).otherwise(F.floor(v))
    return df.join(span, "grid").select(*CELL, value.cast("double").alias("value"))
