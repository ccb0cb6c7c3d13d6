"""Queries over principal components and multidimensional scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.operators.projection import landmark_mds, pca
from tablemine.plans.registry import query, rounded, table


def _two(spark, sf):
    """Two linearly related attributes of similar scale."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 1000).alias("a"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1500 + F.col("l_quantity") / 10).alias("b"),
    )
    return set_roles(li, metas=["l_orderkey", "l_linenumber", "l_partkey"])


# Two columns: the first axis has the angle half of atan2(2 cov, var a - var b).
_AB = """(SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 1000 AS a,
  l_extendedprice * (1 - l_discount) / 1500 + l_quantity / 10 AS b FROM lineitem)"""


def _pca_sql(a: str, b: str) -> str:
    return f"""
WITH z AS (SELECT l_orderkey, l_linenumber, l_partkey, {a} AS a, {b} AS b FROM {_AB}, (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM {_AB})),
m AS (SELECT atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) / 2 AS t FROM z),
x AS (SELECT cos(t) AS c, sin(t) AS s FROM m)
SELECT l_orderkey, l_linenumber, l_partkey,
  round(CASE WHEN abs(c) >= abs(s) - 1e-12 THEN sign(c) ELSE sign(s) END * (a * c + b * s), 5) + 0.0 AS "PC1" FROM z, x"""


@query("pca", _pca_sql("a - ma", "b - mb"))
def _pca(spark, sf):
    scores, _ = pca(_two(spark, sf), n_components=2)
    return rounded(scores.select("l_orderkey", "l_linenumber", "l_partkey", "PC1"), 5)


@query("pca_normalized", _pca_sql("(a - ma) / sa", "(b - mb) / sb"))
def _pca_normalized(spark, sf):
    scores, _ = pca(_two(spark, sf), n_components=1, normalize=True)
    return rounded(scores.select("l_orderkey", "l_linenumber", "l_partkey", "PC1"), 5)


@query("pca_explained", f"""
SELECT 'PC1' AS component, round(((va + vb) / 2 + sqrt(((va - vb) / 2) ** 2 + c * c)) / (va + vb), 6) AS variance
FROM (SELECT var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM {_AB})""")
def _pca_explained(spark, sf):
    _, components = pca(_two(spark, sf), explained=0.8)
    return rounded(components.select("component", "variance"))


@query("landmark_mds")
def _mds(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)])
    return rounded(landmark_mds(set_roles(e, metas=["vec_id"]), key=["vec_id"]))
