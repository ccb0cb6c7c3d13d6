"""Queries over correlations and attribute scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.operators.correlation import correlation_matrix, correlations
from tablemine.operators.ranking import (
    anova, class_scores, contingency, rank, rank_scores, rrelieff, univariate_linear, variance,
)
from tablemine.plans.registry import query, rounded, table

_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_GAPS = """(SELECT CASE WHEN l_quantity <> 7 THEN l_quantity END AS l_quantity, l_extendedprice,
  CASE WHEN l_tax <> 0.03 THEN l_discount END AS l_discount, l_tax FROM lineitem)"""
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]]


def _gappy(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice",
        F.when(F.col("l_tax") != 0.03, F.col("l_discount")).alias("l_discount"), "l_tax",
    )


@query("corr_pearson", " UNION ALL ".join(
    f"SELECT '{a}' AS \"Feature A\", '{b}' AS \"Feature B\", round(corr({a}, {b}), 6) + 0.0 AS \"Correlation\", "
    f"round(abs(corr({a}, {b})), 6) + 0.0 AS \"Abs Correlation\" FROM {_GAPS} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS))
def _pearson(spark, sf):
    return rounded(correlations(_gappy(spark, sf), p_values=False))


@query("corr_pvalue")
def _pvalue(spark, sf):
    return rounded(correlations(_gappy(spark, sf)).select("Feature A", "Feature B", "Correlation", "p-value"))


def _ranks(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


_SPEARMAN = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr(ra, rb) AS r FROM (SELECT {_ranks(a)} AS ra, {_ranks(b)} AS rb FROM {_GAPS} "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in _PAIRS)


@query("corr_spearman", f"""
SELECT a AS "Feature A", b AS "Feature B", round(r, 6) + 0.0 AS "Correlation", round(abs(r), 6) + 0.0 AS "Abs Correlation" FROM ({_SPEARMAN})""")
def _spearman(spark, sf):
    return rounded(correlations(_gappy(spark, sf), method="spearman", p_values=False))


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS feature, " + ", ".join(
        "1.0::DOUBLE AS " + b if a == b else
        f"(SELECT round(corr({a}, {b}), 6) + 0.0 FROM {_GAPS} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS {b}" for b in _COLS) for a in _COLS))
def _matrix(spark, sf):
    return rounded(correlation_matrix(_gappy(spark, sf)))


# Line items with a derived class and a mix of discrete and continuous attributes.
_ATTRS = ("l_quantity", "l_extendedprice", "l_discount", "l_linestatus")
_BASE = """(SELECT l_quantity, l_extendedprice, l_discount, l_linestatus,
  CASE WHEN l_extendedprice * (1 - l_discount) > 40000 THEN 'high' WHEN l_extendedprice * (1 - l_discount) > 15000 THEN 'mid' ELSE 'low' END AS band,
  l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)"""


def _classed(spark, sf):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    df = table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_linestatus",
        F.when(revenue > 40000, "high").when(revenue > 15000, "mid").otherwise("low").alias("band"),
    )
    return set_roles(df, discrete=["l_linestatus", "band"], target="band")


def _bin(c: str) -> str:
    if c == "l_linestatus":
        return f"SELECT '{c}' AS feature, l_linestatus AS bin, band AS cls FROM {_BASE}"
    q = [f"(SELECT quantile_cont({c}, {p}) FROM lineitem)" for p in (0.25, 0.5, 0.75)]
    return (
        f"SELECT '{c}' AS feature, ({' + '.join(f'({c} >= x{i})::INT' for i in range(3))})::VARCHAR AS bin, band AS cls "
        f"FROM {_BASE}, (SELECT {', '.join(f'{e} AS x{i}' for i, e in enumerate(q))})"
    )


_CONT = f"""WITH l AS ({' UNION ALL '.join(_bin(c) for c in _ATTRS)}),
c AS (SELECT feature, bin, cls, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT feature, sum(n) AS total FROM c GROUP BY feature),
b AS (SELECT feature, bin, sum(n) AS nb FROM c GROUP BY ALL), k AS (SELECT feature, cls, sum(n) AS nc FROM c GROUP BY ALL),
hc AS (SELECT feature, -sum(nc / total * log2(nc / total)) AS h, 1 - sum((nc / total) ** 2) AS g FROM k JOIN t USING (feature) GROUP BY feature),
hb AS (SELECT feature, -sum(nb / total * log2(nb / total)) AS hb FROM b JOIN t USING (feature) GROUP BY feature),
cond AS (SELECT feature, -sum(n / total * log2(n / nb)) AS h1, sum(nb / total * (n / nb) ** 2) AS g1
  FROM c JOIN b USING (feature, bin) JOIN t USING (feature) GROUP BY feature),
chi AS (SELECT feature, sum((coalesce(n, 0) - nb * nc / total) ** 2 / (nb * nc / total)) AS chi2
  FROM b JOIN k USING (feature) JOIN t USING (feature) LEFT JOIN c USING (feature, bin, cls) GROUP BY feature),
s AS (SELECT feature, h - h1 AS ig, (h - h1) / hb AS gr, g - (1 - g1) AS gini, chi2
  FROM hc JOIN hb USING (feature) JOIN cond USING (feature) JOIN chi USING (feature))"""


def _class_scores(spark, sf, metric):
    df = _classed(spark, sf)
    return rounded(class_scores(contingency(df, "band", list(_ATTRS))).select("feature", metric))


for _key, _metric, _expr in (
    ("rank_infogain", "InfoGain", "ig"), ("rank_gainratio", "GainRatio", "gr"), ("rank_gini", "Gini", "gini"), ("rank_chi2", "Chi2", "chi2"),
):
    @query(_key, f"{_CONT} SELECT feature, round({_expr}, 6) + 0.0 AS \"{_metric}\" FROM s")
    def _scorer(spark, sf, metric=_metric):
        return _class_scores(spark, sf, metric)


def _anova_sql(c: str) -> str:
    x = "(l_linestatus = 'O')::INT" if c == "l_linestatus" else c
    return f"""SELECT '{c}' AS feature, (sum(n * (m - mean) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f
FROM (SELECT band, count(*) AS n, avg({x}) AS m, var_pop({x}) AS v FROM {_BASE} GROUP BY band), (SELECT avg({x}) AS mean FROM {_BASE})"""


_ANOVA = " UNION ALL ".join(_anova_sql(c) for c in _ATTRS)


@query("rank_anova", f'SELECT feature, round(f, 4) + 0.0 AS "ANOVA" FROM ({_ANOVA})')
def _anova(spark, sf):
    return rounded(anova(_classed(spark, sf), "band", list(_ATTRS)), 4)


@query("rank_univariate_linear", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(r * r / (1 - r * r) * (n - 2), 4) + 0.0 AS \"UnivariateLinearRegression\" FROM "
    f"(SELECT corr({c}, revenue) AS r, count(*) AS n FROM {_BASE})" for c in _ATTRS[:3]))
def _linear(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rounded(univariate_linear(df, "revenue", list(_ATTRS[:3])), 4)


@query("rank_rrelieff")
def _rrelieff(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double").alias("when"), F.sqrt("o_totalprice").alias("y"))
    df = set_roles(df, target="y", metas=["o_orderkey"])
    return rounded(rrelieff(df, "y", ["o_totalprice", "when"], key=["o_orderkey"]))


@query("rank_variance", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_pop({c}), 4) + 0.0 AS \"Variance\" FROM {_GAPS}" for c in _COLS))
def _variance(spark, sf):
    return rounded(variance(_gappy(spark, sf), list(_COLS)), 4)


@query("rank_scores", f"""{_CONT}, a AS ({_ANOVA})
SELECT feature AS "Feature", round(ig, 6) + 0.0 AS "InfoGain", round(gr, 6) + 0.0 AS "GainRatio", round(gini, 6) + 0.0 AS "Gini",
  round(f, 4) + 0.0 AS "ANOVA", round(chi2, 6) + 0.0 AS "Chi2" FROM s JOIN a USING (feature)""")
def _scores(spark, sf):
    return rounded(rank_scores(_classed(spark, sf)).withColumn("ANOVA", F.round("ANOVA", 4)))


_TOP = f"(SELECT feature FROM ({_CONT} SELECT feature, ig FROM s) ORDER BY ig DESC LIMIT 2)"


@query("rank_select_topk", "SELECT l_extendedprice, l_discount, "
       "CASE WHEN l_extendedprice * (1 - l_discount) > 40000 THEN 'high' WHEN l_extendedprice * (1 - l_discount) > 15000 THEN 'mid' ELSE 'low' END AS band, "
       f"(SELECT count(*) FROM {_TOP} WHERE feature IN ('l_extendedprice', 'l_discount')) AS agreed FROM lineitem")
def _topk(spark, sf):
    reduced, _ = rank(_classed(spark, sf), select_mode="top_k", n_selected=2)
    kept = {"l_extendedprice", "l_discount"} & set(reduced.columns)
    return reduced.withColumn("agreed", F.lit(len(kept)).cast("long"))


@query("rank_select_threshold", "SELECT l_extendedprice, "
       "CASE WHEN l_extendedprice * (1 - l_discount) > 40000 THEN 'high' WHEN l_extendedprice * (1 - l_discount) > 15000 THEN 'mid' ELSE 'low' END AS band FROM lineitem")
def _threshold(spark, sf):
    return rank(_classed(spark, sf), scoring_method="infogain", select_mode="threshold", threshold=0.5)[0]


@query("rank_select_all", f"SELECT l_quantity, l_extendedprice, l_discount, l_linestatus, band FROM {_BASE}")
def _all(spark, sf):
    return rank(_classed(spark, sf), select_mode="all")[0]
