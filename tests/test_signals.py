"""Series, rasters, images, charts, streams, scripts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemine.operators import grid
from tablemine.operators.charts import box, histogram, line, scatter
from tablemine.operators.grid import gaussian_weights, grid_channel, grid_filter, grid_measure, grid_morph, grid_rescale, grid_shift, grid_zoom, roll
from tablemine.operators.script import apply_script, script_batches
from tablemine.session import scratch_path
from tablemine.streaming.records import records_sink, records_stream


@pytest.fixture(params=[100_000, 4], ids=["one chunk", "many chunks"])
def chunks(request, monkeypatch):
    monkeypatch.setattr(grid, "CHUNK", request.param)


@pytest.fixture(scope="module")
def raster(spark):
    rng = np.random.default_rng(0)
    a = np.round(rng.random((11, 13)) * 100)
    y, x = np.indices(a.shape)
    pdf = pd.DataFrame({"grid": "g", "channel": 0, "y": y.ravel(), "x": x.ravel(), "value": a.ravel()})
    return spark.createDataFrame(pdf, "grid string, channel int, y int, x int, value double"), a


def dense(df):
    p = df.toPandas()
    out = np.full((p["y"].max() + 1, p["x"].max() + 1), np.nan)
    out[p["y"], p["x"]] = p["value"]
    return out


def boxes(a, size, pad="symmetric"):
    before, after = size // 2, size - size // 2 - 1
    p = np.pad(a, ((before, after), (before, after)), mode=pad)
    return np.lib.stride_tricks.sliding_window_view(p, (size, size)).reshape(*a.shape, -1)


@pytest.mark.parametrize("kind,size,want", [
    ("mean", 3, lambda b: b.mean(axis=-1)), ("max", 5, lambda b: b.max(axis=-1)), ("min", 4, lambda b: b.min(axis=-1)),
    ("median", 3, lambda b: np.median(b, axis=-1)), ("percentile", 3, lambda b: np.sort(b, axis=-1)[..., int(9 * 0.2)]),
])
def test_box_filters(raster, chunks, kind, size, want):
    df, a = raster
    assert dense(grid_filter(df, kind=kind, size=size, percentile=20)) == pytest.approx(want(boxes(a, size)))


def test_gaussian_wider_than_the_raster(raster, chunks):
    df, a = raster
    w = gaussian_weights(4.0)
    r = len(w) - 1
    kernel = np.array(w[:0:-1] + w)
    p = np.pad(a, r, mode="symmetric")
    rows = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), 0, p)
    assert dense(grid_filter(df, sigma=4.0)) == pytest.approx(np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), 1, rows))


@pytest.mark.parametrize("kind,c", [("sobel", 2), ("prewitt", 1)])
def test_gradients(raster, chunks, kind, c):
    df, a = raster
    b = boxes(a, 3, "constant").reshape(*a.shape, 3, 3)
    s, d = np.array([1, c, 1]), np.array([-1, 0, 1])
    want = np.hypot((b * np.outer(d, s)).sum(axis=(2, 3)), (b * np.outer(s, d)).sum(axis=(2, 3)))
    assert dense(grid_filter(df, kind=kind)) == pytest.approx(want)


@pytest.mark.parametrize("kind", ["dilate", "erode", "open", "close"])
@pytest.mark.parametrize("times, above", [(1, 40), (2, 40), (3, 8), (3, 92), (20, 97), (20, 0)])
def test_morphology(raster, chunks, kind, times, above):
    df, a = raster
    cross = np.array([1, 3, 4, 5, 7])
    grow = lambda m: boxes(m, 3, "constant")[..., cross].max(axis=-1)
    shrink = lambda m: boxes(m, 3, "constant")[..., cross].min(axis=-1)
    want = (a > above).astype(float)
    for s in {"dilate": [grow], "erode": [shrink], "open": [shrink, grow], "close": [grow, shrink]}[kind]:
        for _ in range(times):
            want = s(want)
    got = grid_morph(df.withColumn("value", (F.col("value") > above).cast("double")), kind=kind, iterations=times)
    assert (dense(got) == want).all()


def test_shuffles_do_not_grow_with_the_steps(raster):
    plans = [grid_morph(raster[0], kind="close", iterations=n)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for n in (1, 20)]
    assert plans[0] == plans[1]


def test_shift_zoom_rescale_measure(raster):
    df, a = raster
    want = np.zeros_like(a)
    want[3:, :-2] = a[:-3, 2:]
    assert (dense(grid_shift(df, 3, -2)) == want).all()
    half = dense(grid_zoom(df, 0.5))
    assert half.shape == (6, 6) and half[0, 0] == a[0, 0] and half[-1, -1] == pytest.approx(a[-1, -1])
    double = dense(grid_zoom(df, 2))
    assert double.shape == (22, 26)
    ys, xs = np.arange(22) * 10 / 21, np.arange(26) * 12 / 25
    rows = np.array([np.interp(ys, np.arange(11), a[:, j]) for j in range(13)]).T
    assert double == pytest.approx(np.array([np.interp(xs, np.arange(13), rows[i]) for i in range(22)]))
    scaled = dense(grid_rescale(df))
    assert scaled.min() == 0 and scaled.max() == 255 and (scaled == np.floor(scaled)).all()
    m = grid_measure(df).first()
    y, x = np.indices(a.shape)
    assert m.sum == a.sum() and m.variance == pytest.approx(a.var()) and m.centre_y == pytest.approx((a * y).sum() / a.sum())
    assert grid_channel(df, 2).count() == a.size


def test_roll_on_short_and_long_series(spark, chunks):
    pdf = pd.DataFrame({"s": ["a"] * 2 + ["b"] * 25, "t": [5, 9, *range(100, 125)], "v": np.arange(27.0) ** 1.5})
    got = roll(spark.createDataFrame(pdf), series="s", order="t", value="v", sigma=1.5).toPandas().sort_values(["s", "t"])
    w = gaussian_weights(1.5)
    r, kernel = len(w) - 1, np.array(w[:0:-1] + w)
    for _, part in got.groupby("s"):
        want = np.convolve(np.pad(part["v"].to_numpy(), r, mode="symmetric"), kernel, "valid")
        assert part["filtered"].to_numpy() == pytest.approx(want)


def test_chart_edges(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, None), (None, "a")], "v double, g string")
    assert [(r.bin, r["count"]) for r in histogram(df, "v").collect()] == [(0, 2)]
    assert {r.group for r in box(df, "v", group="g").collect()} == {"a", "Missing"}
    assert histogram(df.where("v is null"), "v").count() == 0 and box(df.where("v is null"), "v").count() == 0
    points = spark.range(50).select("id", (F.col("id") * 2).cast("double").alias("v"))
    assert scatter(points, "id", "v", n=20, key=["id"]).count() == 20
    rows = line(points, "v", n=10, key=["id"]).collect()
    assert len(rows) == 10 and sorted(r.x for r in rows)[0] == 2.0


def test_records_stream_lists(spark):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    spark.createDataFrame([('[{"x": 1}, {"x": 2}]',), ("[]",)], "value string").write.text(path)
    stream = records_stream(spark, path, "x int", lists=True)
    records_sink(stream, out, scratch_path(spark, "progress"), drain=True).awaitTermination()
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"x":1}', '{"x":2}']


def test_scripts(spark):
    df = spark.range(3)
    assert apply_script(None, df).out_data is df

    def failing(scope):
        raise RuntimeError("broken")

    result = apply_script(failing, df, state={"kept": 1})
    assert result.out_data is None and "broken" in result.error and result.state == {"kept": 1}
    assert script_batches(df, lambda p: p[p["id"] > 0], "id bigint").count() == 2
