"""Queries over series, rasters, images, streams and scripts."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.operators.grid import (
    gaussian_weights, grid_channel, grid_filter, grid_measure, grid_morph, grid_rescale, grid_shift, grid_zoom, roll,
)
from tablemine.operators.learners import Constant, DecisionTree
from tablemine.operators.script import apply_script, script_batches
from tablemine.plans.registry import query, rounded, table
from tablemine.session import scratch_path
from tablemine.sources.images import read_image_grid
from tablemine.streaming.records import AnomalyScorer, predict_stream, records_sink, records_stream

# --- series: the values of each event type in event order -------------------------------------------------------

_SERIES = """(SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)"""


def _mirror(offset: str) -> str:
    """Index of the mirrored position i + offset."""
    p = f"(a.i + {offset})"
    return f"(CASE WHEN {p} < 0 THEN -1 - {p} WHEN {p} >= a.n THEN 2 * a.n - 1 - {p} ELSE {p} END)"


def _roll_sql(agg: str, low: int, high: int) -> str:
    return f"""WITH s AS {_SERIES}
SELECT a.event_type, a.event_id, a.value, round({agg}, 6) + 0.0 AS filtered
FROM (SELECT *, unnest(range({low}, {high} + 1)) AS o FROM s) a JOIN s b ON b.event_type = a.event_type AND b.i = {_mirror('a.o')}
GROUP BY a.event_type, a.event_id, a.value"""


_W = gaussian_weights(2.0)
_GAUSS = "sum(b.value * list_extract([" + ", ".join(f"{w!r}::DOUBLE" for w in _W) + "], abs(a.o) + 1))"

for _kind, _agg, _low, _high in (
    ("gaussian", _GAUSS, -8, 8), ("max", "max(b.value)", -1, 1), ("min", "min(b.value)", -2, 1), ("mean", "avg(b.value)", -1, 1),
):
    @query(f"roll_{_kind}", _roll_sql(_agg, _low, _high))
    def _roll(spark, sf, kind=_kind, size=4 if _kind == "min" else 3):
        return rounded(roll(table(spark, sf, "events"), series="event_type", order="event_id", value="value", kind=kind, size=size))


# --- rasters: events per day and hour, one grid per event type, two channels ------------------------------------

_DAYS = """days AS (SELECT (min(epoch_us(ts)) // 86400000000)::BIGINT AS d0, (max(epoch_us(ts)) // 86400000000)::BIGINT AS d1 FROM events)"""
_CELLS = f"""{_DAYS},
frame AS (SELECT g.event_type AS grid, c AS channel, y::INT AS y, x::INT AS x FROM (SELECT DISTINCT event_type FROM events) g,
  (SELECT unnest(range(2))::INT AS c), (SELECT unnest(range(d1 - d0 + 1)) AS y FROM days), (SELECT unnest(range(24)) AS x)),
seen AS (SELECT event_type AS grid, ((epoch_us(ts) // 86400000000) - d0)::INT AS y, ((epoch_us(ts) // 3600000000) % 24)::INT AS x,
  count(*)::DOUBLE AS n, count(*) FILTER (WHERE value > 50)::DOUBLE AS big FROM events, days GROUP BY ALL),
cells AS (SELECT grid, channel, y, x, coalesce(CASE channel WHEN 0 THEN n ELSE big END, 0) AS value FROM frame LEFT JOIN seen USING (grid, y, x)),
ext AS (SELECT grid, max(y) + 1 AS h, max(x) + 1 AS w FROM cells GROUP BY grid)"""


def _grid(spark, sf):
    """Dense cells: the frame of days and hours is spread from one row per event type."""
    e = table(spark, sf, "events").select("event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    day = F.floor(F.col("us") / 86400000000)
    extent = e.agg(F.min(day).alias("d0"), F.max(day).alias("d1")).first()
    hour = F.floor(F.col("us") / 3600000000) % 24
    seen = e.groupBy(F.col("event_type").alias("grid"), (day - extent.d0).cast("int").alias("y"), hour.cast("int").alias("x")).agg(
        F.count("*").cast("double").alias("n"), F.count_if(F.col("value") > 50).cast("double").alias("big")
    )
    frame = e.select(F.col("event_type").alias("grid")).distinct()
    for name, size in (("y", extent.d1 - extent.d0), ("x", 23)):
        frame = frame.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(int(size)))))
    full = frame.join(seen, ["grid", "y", "x"], "left")
    values = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ("n", "big")])
    return full.select("grid", "y", "x", F.posexplode(values).alias("channel", "value"))


def _box(agg: str, low: int, high: int) -> str:
    """Aggregate over the mirrored box around each cell."""
    p = lambda c, s: f"(CASE WHEN a.{c} + a.o{c} < 0 THEN -1 - (a.{c} + a.o{c}) WHEN a.{c} + a.o{c} >= {s} THEN 2 * {s} - 1 - (a.{c} + a.o{c}) ELSE a.{c} + a.o{c} END)"
    return f"""WITH {_CELLS},
a AS (SELECT cells.*, h, w, oy, ox FROM cells JOIN ext USING (grid), (SELECT unnest(range({low}, {high} + 1)) AS oy), (SELECT unnest(range({low}, {high} + 1)) AS ox))
SELECT a.grid, a.channel, a.y, a.x, round({agg}, 6) + 0.0 AS value FROM a
JOIN cells b ON b.grid = a.grid AND b.channel = a.channel AND b.y = {p('y', 'h')} AND b.x = {p('x', 'w')}
GROUP BY a.grid, a.channel, a.y, a.x"""


_W1 = gaussian_weights(0.8)
_LIST = "[" + ", ".join(f"{w!r}::DOUBLE" for w in _W1) + "]"
_BOXES = {
    "grid_gaussian": (_box(f"sum(b.value * list_extract({_LIST}, abs(oy) + 1) * list_extract({_LIST}, abs(ox) + 1))", -3, 3), {"kind": "gaussian", "sigma": 0.8}),
    "grid_mean": (_box("avg(b.value)", -1, 1), {"kind": "mean"}),
    "grid_max": (_box("max(b.value)", -1, 1), {"kind": "max"}),
    "grid_min": (_box("min(b.value)", -1, 1), {"kind": "min"}),
    "grid_median": (_box("list_extract(list_sort(list(b.value)), 5)", -1, 1), {"kind": "median"}),
    "grid_percentile": (_box("list_extract(list_sort(list(b.value)), 8)", -1, 1), {"kind": "percentile", "percentile": 80}),
}
for _name, (_sql, _settings) in _BOXES.items():
    @query(_name, _sql)
    def _boxed(spark, sf, settings=_settings):
        return rounded(grid_filter(_grid(spark, sf), **settings))


def _gradient_sql(c: int) -> str:
    v = lambda dy, dx: f"coalesce(max(b.value) FILTER (WHERE oy = {dy} AND ox = {dx}), 0)"
    gx = f"({v(-1, 1)} - {v(-1, -1)} + {c} * ({v(0, 1)} - {v(0, -1)}) + {v(1, 1)} - {v(1, -1)})"
    gy = f"({v(1, -1)} - {v(-1, -1)} + {c} * ({v(1, 0)} - {v(-1, 0)}) + {v(1, 1)} - {v(-1, 1)})"
    return f"""WITH {_CELLS}, a AS (SELECT cells.*, oy, ox FROM cells, (SELECT unnest(range(-1, 2)) AS oy), (SELECT unnest(range(-1, 2)) AS ox))
SELECT a.grid, a.channel, a.y, a.x, round(sqrt({gx} * {gx} + {gy} * {gy}), 6) AS value FROM a
LEFT JOIN cells b ON b.grid = a.grid AND b.channel = a.channel AND b.y = a.y + oy AND b.x = a.x + ox GROUP BY a.grid, a.channel, a.y, a.x"""


for _name, _c in (("sobel", 2), ("prewitt", 1)):
    @query(f"grid_{_name}", _gradient_sql(_c))
    def _edges(spark, sf, kind=_name):
        return rounded(grid_filter(_grid(spark, sf), kind=kind))


def _busy(spark, sf):
    """Cells with at least two events."""
    return _grid(spark, sf).withColumn("value", (F.col("value") >= 2).cast("double"))


def _morph_sql(picks: list[str]) -> str:
    steps, last = [], "s0"
    for i, pick in enumerate(picks, 1):
        best = "max" if pick == "dilate" else "min"
        steps.append(f"""s{i} AS (SELECT a.grid, a.channel, a.y, a.x, {best}(coalesce(b.value, 0)) AS value FROM
(SELECT {last}.*, o.dy, o.dx FROM {last}, (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx)) a
LEFT JOIN {last} b ON b.grid = a.grid AND b.channel = a.channel AND b.y = a.y + a.dy AND b.x = a.x + a.dx GROUP BY a.grid, a.channel, a.y, a.x)""")
        last = f"s{i}"
    return f"WITH {_CELLS}, s0 AS (SELECT grid, channel, y, x, (value >= 2)::INT::DOUBLE AS value FROM cells), {', '.join(steps)} SELECT * FROM {last}"


for _name, _picks, _times in (
    ("dilate", ["dilate"] * 2, 2), ("erode", ["erode"], 1), ("open", ["erode", "dilate"], 1), ("close", ["dilate", "erode"], 1),
):
    @query(f"grid_{_name}", _morph_sql(_picks))
    def _morph(spark, sf, kind=_name, times=_times):
        return grid_morph(_busy(spark, sf), kind=kind, iterations=times)


@query("grid_morph_gradient", _box("max(b.value) - min(b.value)", -1, 1))
def _morph_gradient(spark, sf):
    return rounded(grid_morph(_grid(spark, sf), kind="gradient"))


@query("grid_measure", f"""WITH {_CELLS}
SELECT grid, channel, sum(value) AS sum, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS sd,
  min(value) AS min, max(value) AS max, round(sum(value * y) / sum(value), 6) AS centre_y, round(sum(value * x) / sum(value), 6) AS centre_x
FROM cells GROUP BY grid, channel""")
def _measure(spark, sf):
    return rounded(grid_measure(_grid(spark, sf)))


@query("grid_shift", f"""WITH {_CELLS}
SELECT a.grid, a.channel, a.y, a.x, coalesce(b.value, 0) AS value FROM cells a
LEFT JOIN cells b ON b.grid = a.grid AND b.channel = a.channel AND b.y = a.y - 2 AND b.x = a.x + 3""")
def _shift(spark, sf):
    return grid_shift(_grid(spark, sf), 2, -3)


@query("grid_zoom", f"""WITH {_CELLS},
o AS (SELECT grid, h, w, round_even(h * 0.5, 0) AS oh, round_even(w * 0.5, 0) AS ow FROM ext),
t AS (SELECT grid, channel, ty, tx, ty * (h - 1) / (oh - 1) AS sy, tx * (w - 1) / (ow - 1) AS sx FROM o, (SELECT unnest(range(2))::INT AS channel),
  (SELECT unnest(range(1000))::INT AS ty), (SELECT unnest(range(1000))::INT AS tx) WHERE ty < oh AND tx < ow)
SELECT t.grid, t.channel, ty AS y, tx AS x, round(sum(value * (1 - abs(sy - y)) * (1 - abs(sx - x))), 6) + 0.0 AS value
FROM t JOIN cells c ON c.grid = t.grid AND c.channel = t.channel AND abs(sy - y) < 1 AND abs(sx - x) < 1 GROUP BY t.grid, t.channel, ty, tx""")
def _zoom(spark, sf):
    return rounded(grid_zoom(_grid(spark, sf), 0.5))


@query("grid_channel", f"""WITH {_CELLS}
SELECT grid, channel, y, x, value FROM cells WHERE channel = CASE WHEN grid = 'click' THEN 0 ELSE 1 END""")
def _channel(spark, sf):
    return grid_channel(_grid(spark, sf).where("not (grid = 'click' and channel = 1)"), 1)


@query("grid_rescale", f"""WITH {_CELLS}, s AS (SELECT grid, min(value) AS lo, max(value) AS hi FROM cells GROUP BY grid)
SELECT grid, channel, y, x, floor(255 * (value - lo) / (hi - lo)) AS value FROM cells JOIN s USING (grid)""")
def _rescale(spark, sf):
    return grid_rescale(_grid(spark, sf))


# --- images: the raster of each event type drawn as PNG files, one per tile --------------------------------------

#: Rows and columns of a tile: what one task draws.
TILE = 64


def _png(rgb: np.ndarray) -> bytes:
    """Uncompressed-filter PNG of an (h, w, 3) array of bytes."""
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    lines = b"".join(b"\x00" + row.tobytes() for row in rgb)
    head = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@query("read_image_grid", f"""WITH {_CELLS}
SELECT grid, y, x, channel, least(CASE channel WHEN 2 THEN 7 ELSE value END, 255) AS value
FROM (SELECT * FROM cells UNION ALL SELECT grid, 2, y, x, 0 FROM cells WHERE channel = 0)""")
def _images(spark, sf):
    folder = scratch_path(spark, "images")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        top, left = (int(pdf[c].iloc[0]) * TILE for c in ("ty", "tx"))
        y, x = pdf["y"] - top, pdf["x"] - left
        rgb = np.full((y.max() + 1, x.max() + 1, 3), 7, dtype=np.uint8)
        rgb[y, x, pdf["channel"]] = pdf["value"].clip(upper=255).astype(np.uint8)
        name = f"{pdf['grid'].iloc[0]}@{top}@{left}"
        uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        system, path = fs.FileSystem.from_uri(uri.replace("file:///", "/") if uri.startswith("file:///") else uri.replace("file:", ""))
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}.png") as out:
            out.write(_png(rgb))
        return pd.DataFrame({"grid": [name]})

    tile = lambda c: F.floor(F.col(c) / TILE).cast("int").alias(f"t{c}")
    _grid(spark, sf).select("*", tile("y"), tile("x")).groupBy("grid", "ty", "tx").applyInPandas(draw, "grid string").count()
    cells = read_image_grid(spark, folder)
    named = lambda i: F.regexp_extract(F.url_decode("origin"), r"([^/]+)@(\d+)@(\d+)\.png$", i)
    return cells.select(named(1).alias("grid"), (F.col("y") + named(2).cast("int")).alias("y"), (F.col("x") + named(3).cast("int")).alias("x"), "channel", "value")


# --- streams: events written as JSON files and drained ----------------------------------------------------------

_EVENT = "event_id bigint, user_id bigint, event_type string, value double"


def _event_files(spark, sf) -> str:
    path = scratch_path(spark, "events")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    return path


def _drain(spark, stream, schema):
    """Run a stream to its end and read back the records it wrote."""
    path = scratch_path(spark, "out")
    records_sink(stream, path, scratch_path(spark, "progress"), drain=True).awaitTermination()
    return spark.read.schema(schema).json(path)


@query("stream_records_in", "SELECT event_id, user_id, event_type, value FROM events")
def _stream_in(spark, sf):
    return _drain(spark, records_stream(spark, _event_files(spark, sf), _EVENT, files_per_batch=2), _EVENT)


@query("stream_records_out", """
SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","big":' || (value > 50)::VARCHAR || '}' AS value FROM events""")
def _stream_out(spark, sf):
    stream = records_stream(spark, _event_files(spark, sf), _EVENT)
    out = stream.select("event_id", "event_type", (F.col("value") > 50).alias("big"))
    path = scratch_path(spark, "out")
    records_sink(out, path, scratch_path(spark, "progress"), drain=True).awaitTermination()
    return spark.read.text(path)


@query("stream_predict", """
SELECT event_id, (SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1) AS "Constant" FROM events""")
def _stream_predict(spark, sf):
    history = set_roles(
        table(spark, sf, "events").select("event_id", "event_type", "value"), discrete=["event_type"], target="event_type", metas=["event_id"])
    model = Constant().fit(history)
    stream = records_stream(spark, _event_files(spark, sf), "event_id bigint, value double")
    return _drain(spark, predict_stream(stream, [model]).select("event_id", "Constant"), "event_id bigint, Constant string")


@query("stream_predict_tree", """
SELECT event_id, CASE WHEN floor(value / 10) >= 5 THEN 'big' ELSE 'small' END AS "Tree" FROM events""")
def _stream_tree(spark, sf):
    """A tree that has learned a rule of the tens of a value, on the stream of these values."""
    tens = (F.floor(F.col("value") / 10) * 10).alias("tens")
    known = table(spark, sf, "events").select("event_id", tens).withColumn("size", F.when(F.col("tens") >= 50, "big").otherwise("small"))
    model = DecisionTree().fit(set_roles(known, discrete=["size"], target="size", metas=["event_id"]))
    stream = records_stream(spark, _event_files(spark, sf), "event_id bigint, value double").select("event_id", tens)
    return _drain(spark, predict_stream(stream, [model]).select("event_id", "Tree"), "event_id bigint, Tree string")


@query("stream_anomaly")
def _stream_anomaly(spark, sf):
    scorer = AnomalyScorer(table(spark, sf, "events"), ["value", "user_id"], key=["event_id"])
    stream = records_stream(spark, _event_files(spark, sf), _EVENT)
    return _drain(spark, scorer.flag(stream), _EVENT + ", score double, Outlier string")


# --- scripts ----------------------------------------------------------------------------------------------------


@query("script_transform", """
SELECT o_orderkey, o_totalprice * 2 AS twice, c_mktsegment, 'passed' AS how FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, 'blank' FROM customer""")
def _transform(spark, sf):
    def script(scope):
        joined = scope["in_data"].join(scope["in_extra"], F.col("o_custkey") == F.col("c_custkey"))
        scope["out_data"] = joined.select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"), "c_mktsegment")

    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    done = apply_script(script, o, c).out_data.withColumn("how", F.lit("passed"))
    blank = apply_script(None, c).out_data.select(F.col("c_custkey"), "c_acctbal", "c_mktsegment", F.lit("blank"))
    return done.union(blank)


@query("script_state", """
SELECT event_type, count(*) AS n, 3::BIGINT AS calls, round(sum(value), 4) AS total, true AS failed FROM events GROUP BY event_type""")
def _state(spark, sf):
    def script(scope):
        scope["calls"] = scope.get("calls", 0) + 1
        scope["out_data"] = scope["in_data"].groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))

    def broken(scope):
        raise ValueError("no")

    events, state, result = table(spark, sf, "events"), {}, None
    for _ in range(3):
        result = apply_script(script, events, state=state)
        state = result.state
    failed = apply_script(broken, events, state=state)
    return result.out_data.select(
        "event_type", "n", F.lit(failed.state["calls"]).cast("long").alias("calls"), "total",
        F.lit(failed.out_data is None and "ValueError" in failed.error).alias("failed"),
    )


@query("script_batches", """
SELECT event_id, value * 10 AS ten, upper(event_type) AS event_type FROM events WHERE value > 20""")
def _batches(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value", "event_type")

    def script(batch: pd.DataFrame) -> pd.DataFrame:
        big = batch[batch["value"] > 20]
        return pd.DataFrame({"event_id": big["event_id"], "ten": big["value"] * 10, "event_type": big["event_type"].str.upper()})

    return script_batches(events, script, "event_id bigint, ten double, event_type string")
