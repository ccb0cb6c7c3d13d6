"""Queries over statistics, imputation, scaling, encoding, binning and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.operators.charts import box, histogram, line, scatter
from tablemine.operators.prep import continuize, discretize, impute, normalize
from tablemine.operators.statistics import column_stats, dataset_profile, value_distribution
from tablemine.plans.registry import query, rounded, table

# Line items with gaps: the quantity 7 and the flag A are missing.
_GAPS = """(SELECT CASE WHEN l_quantity <> 7 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount,
  CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM lineitem)"""


def _gappy(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", "l_discount",
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus", "l_orderkey", "l_linenumber",
    )
    return set_roles(df, discrete=["l_returnflag", "l_linestatus"], metas=["l_orderkey", "l_linenumber"])


def _stat(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, count(*) - count({c}) AS missing FROM {_GAPS}"
    )


@query("column_stats", " UNION ALL ".join(_stat(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_orderkey", "l_linenumber")) + "".join(
    f" UNION ALL SELECT '{c}', NULL, NULL, NULL, NULL, count(*) - count({c}) FROM {_GAPS}" for c in ("l_returnflag", "l_linestatus")))
def _column_stats(spark, sf):
    return rounded(column_stats(_gappy(spark, sf)))


@query("value_distribution", f"""
SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS count FROM {_GAPS} WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM {_GAPS} GROUP BY l_linestatus""")
def _value_distribution(spark, sf):
    return value_distribution(_gappy(spark, sf))


@query("dataset_profile")
def _profile(spark, sf):
    t = set_roles(table(spark, sf, "customer"), discrete=["c_mktsegment"], target="c_mktsegment", metas=["c_custkey"])
    return dataset_profile(t, key=["c_custkey"])


_REST = "l_orderkey, l_linenumber"
_MODE = f"(SELECT l_returnflag FROM {_GAPS} WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _impute_sql(fill: str, flag: str = _MODE) -> str:
    return f"""SELECT round(coalesce(l_quantity, {fill}), 6) AS l_quantity, l_extendedprice, l_discount,
coalesce(l_returnflag, {flag}) AS l_returnflag, l_linestatus, {_REST} FROM {_GAPS}"""


for _name, _sql, _args in (
    ("impute_average", _impute_sql(f"(SELECT avg(l_quantity) FROM {_GAPS})"), {"method": "average"}),
    ("impute_default", _impute_sql("0"), {"method": "default"}),
    ("impute_median", _impute_sql(f"(SELECT quantile_cont(l_quantity, 0.5) FROM {_GAPS})"), {"method": "median"}),
    ("impute_constant", _impute_sql("-1", "'-1'"), {"method": "constant", "value": -1}),
    ("impute_drop", f"SELECT l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, {_REST} FROM {_GAPS} "
                    "WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL", {"method": "drop"}),
):
    @query(_name, _sql)
    def _impute(spark, sf, args=_args):
        return rounded(impute(_gappy(spark, sf), **args))


def _scale_sql(expr: str) -> str:
    cols = ", ".join("round(" + expr.format(x=c) + f", 6) + 0.0 AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount"))
    stats = ", ".join(
        f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s, min({c}) AS {c}_lo, max({c}) AS {c}_hi, "
        f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_q2, quantile_cont({c}, 0.75) AS {c}_q3"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    )
    return f"WITH s AS (SELECT {stats} FROM {_GAPS}) SELECT {cols}, {_REST} FROM {_GAPS}, s"


for _name, _expr in (
    ("standardize", "({x} - {x}_m) / {x}_s"), ("center", "({x} - {x}_m)"), ("scale", "{x} / {x}_s"),
    ("minmax", "({x} - {x}_lo) / ({x}_hi - {x}_lo)"), ("robust", "({x} - {x}_q2) / ({x}_q3 - {x}_q1)"),
):
    @query(f"normalize_{_name}", _scale_sql(_expr))
    def _normalize(spark, sf, method=_name):
        return rounded(normalize(_gappy(spark, sf).drop("l_returnflag", "l_linestatus"), method=method))


def _customers(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("c_mktsegment"))
    return set_roles(c, discrete=["c_mktsegment"], metas=["c_custkey"])


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_SEGS = "(SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS c_mktsegment FROM customer)"
_FLAGS = [f"CASE WHEN c_mktsegment IS NOT NULL THEN (c_mktsegment = '{v}')::INT::DOUBLE END AS \"c_mktsegment={v}\"" for v in _SEG]
_CODE = "(SELECT c_custkey, s.c_mktsegment, d.i FROM " + _SEGS + " s LEFT JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i " \
        "FROM (SELECT DISTINCT c_mktsegment FROM " + _SEGS + " WHERE c_mktsegment IS NOT NULL)) d USING (c_mktsegment))"

for _name, _treatment, _sql in (
    ("continuize_onehot", "one_hot", f"SELECT c_custkey, {', '.join(_FLAGS)} FROM {_SEGS}"),
    ("continuize_first_as_base", "first_as_base", f"SELECT c_custkey, {', '.join(_FLAGS[1:])} FROM {_SEGS}"),
    ("continuize_ordinal", "as_ordinal", f"SELECT c_custkey, i::DOUBLE AS c_mktsegment FROM {_CODE}"),
    ("continuize_normalized_ordinal", "as_normalized_ordinal", f"SELECT c_custkey, i / 4.0::DOUBLE AS c_mktsegment FROM {_CODE}"),
):
    @query(_name, _sql)
    def _continuize(spark, sf, treatment=_treatment):
        return continuize(_customers(spark, sf), treatment=treatment)


def _bins_sql(cuts: str) -> str:
    """Label the price of each order by cut points c1..c3 rounded for comparison."""
    return f"""WITH c AS ({cuts})
SELECT CASE WHEN o_totalprice < c1 THEN 0 WHEN o_totalprice < c2 THEN 1 WHEN o_totalprice < c3 THEN 2 ELSE 3 END AS bin,
count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders, c GROUP BY 1"""


def _bins(spark, sf, method):
    o = table(spark, sf, "orders").select("o_totalprice")
    both = o.select("o_totalprice", F.col("o_totalprice").alias("price"))
    t = discretize(set_roles(both, metas=["price"]), method=method, n_bins=4)
    labels = t.schema["o_totalprice"].metadata["values"]
    bin_ = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("o_totalprice")) - 1
    return t.groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"))


@query("discretize_equal_width", _bins_sql(
    "SELECT lo + (hi - lo) * 1 / 4 AS c1, lo + (hi - lo) * 2 / 4 AS c2, lo + (hi - lo) * 3 / 4 AS c3 FROM "
    "(SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)"))
def _equal_width(spark, sf):
    return _bins(spark, sf, "equal_width")


@query("discretize_equal_freq", _bins_sql(
    "SELECT quantile_cont(o_totalprice, 0.25) AS c1, quantile_cont(o_totalprice, 0.5) AS c2, quantile_cont(o_totalprice, 0.75) AS c3 FROM orders"))
def _equal_freq(spark, sf):
    return _bins(spark, sf, "equal_freq")


@query("discretize_entropy")
def _entropy(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice",
        F.when(F.col("l_extendedprice") * (1 - F.col("l_discount")) > 30000, "high").otherwise("low").alias("band"),
    )
    t = discretize(set_roles(li, discrete=["band"], target="band"), method="entropy")
    return t.groupBy("l_quantity", "l_extendedprice", "band").agg(F.count("*").alias("n"))


# --- chart data -------------------------------------------------------------------------------------------------


def _hist_sql(group: str) -> str:
    return f"""WITH e AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 10 AS w FROM events),
b AS (SELECT {group} AS "group", least(floor((value - lo) / w), 9)::INT AS bin, lo, w FROM events, e)
SELECT "group", bin, round(min(lo) + bin * min(w), 6) AS lo, round(min(lo) + bin * min(w) + min(w), 6) AS hi, count(*) AS count
FROM b GROUP BY "group", bin"""


@query("chart_histogram", _hist_sql("'all'"))
def _histogram(spark, sf):
    return rounded(histogram(table(spark, sf, "events"), "value"))


@query("chart_histogram_grouped", _hist_sql("event_type"))
def _histogram_grouped(spark, sf):
    return rounded(histogram(table(spark, sf, "events"), "value", group="event_type"))


def _box_sql(group: str) -> str:
    return f"""WITH d AS (SELECT {group} AS "group", value FROM events),
q AS (SELECT "group", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM d GROUP BY 1),
j AS (SELECT d."group", value, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM d JOIN q USING ("group"))
SELECT "group", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
min(value) FILTER (WHERE inside) AS whisker_low, max(value) FILTER (WHERE inside) AS whisker_high,
count(*) FILTER (WHERE NOT inside) AS outliers FROM j GROUP BY "group", q1, median, q3"""


@query("chart_box", _box_sql("'all'"))
def _box(spark, sf):
    return rounded(box(table(spark, sf, "events"), "value"))


@query("chart_box_grouped", _box_sql("CASE WHEN event_type <> 'click' THEN event_type ELSE 'Missing' END"))
def _box_grouped(spark, sf):
    e = table(spark, sf, "events").withColumn("event_type", F.when(F.col("event_type") != "click", F.col("event_type")))
    return rounded(box(e, "value", group="event_type"))


@query("chart_scatter", """
SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y, p_brand AS color FROM part ORDER BY md5('42|' || length(p_partkey::VARCHAR) || ':' || p_partkey) LIMIT 500""")
def _scatter(spark, sf):
    return scatter(table(spark, sf, "part"), "p_size", "p_retailprice", color="p_brand", n=500, key=["p_partkey"])


@query("chart_line", """
WITH r AS (SELECT event_type AS "group", event_id::DOUBLE AS x, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i,
  greatest(ceil(count(*) OVER (PARTITION BY event_type) / 200.0), 1) AS w FROM events)
SELECT "group", floor(i / w)::BIGINT AS bucket, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM r GROUP BY 1, 2""")
def _line(spark, sf):
    return rounded(line(table(spark, sf, "events"), "value", group="event_type", n=200, key=["event_id"]))
