"""Queries over outliers and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemine.domain import set_roles
from tablemine.operators.clusters import dbscan, kmeans
from tablemine.operators.outliers import outlier_scores, outliers
from tablemine.operators.prep import normalize
from tablemine.plans.registry import query, rounded, table


def _parts(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return set_roles(p, metas=["p_partkey"])


# Every pair of distinct points with its distance, then neighbours in order until their weights reach 20.
_LOF = """
WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y, count(*) AS w FROM part GROUP BY 1, 2),
pr AS (SELECT a.x, a.y, b.x AS nx, b.y AS ny, CASE WHEN a.x = b.x AND a.y = b.y THEN b.w - 1 ELSE b.w END AS w,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a, p b),
c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY x, y ORDER BY d, nx, ny ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM pr WHERE w > 0),
n AS (SELECT x, y, nx, ny, d, least(w, 20 - before) AS take FROM c WHERE before < 20),
k AS (SELECT x, y, max(d) AS kd FROM n GROUP BY x, y),
l AS (SELECT n.x, n.y, 20 / (sum(take * greatest(kd, d)) + 20 * 1e-10) AS lrd FROM n JOIN k ON nx = k.x AND ny = k.y GROUP BY n.x, n.y),
s AS (SELECT n.x, n.y, sum(take * l.lrd) / 20 AS m FROM n JOIN l ON nx = l.x AND ny = l.y GROUP BY n.x, n.y),
f AS (SELECT p_partkey, p_size, p_retailprice, m / lrd AS score FROM part JOIN s ON p_size = s.x AND p_retailprice = s.y
  JOIN l ON p_size = l.x AND p_retailprice = l.y)
"""
_CUT = "(SELECT quantile_cont(score, 0.9) FROM f)"


@query("outlier_flag", f"""{_LOF}
SELECT p_partkey, round(score, 6) AS score, CASE WHEN score > {_CUT} THEN 'yes' ELSE 'no' END AS "Outlier" FROM f""")
def _flag(spark, sf):
    return rounded(outlier_scores(_parts(spark, sf), method="lof", key=["p_partkey"]).select("p_partkey", "score", "Outlier"))


@query("outliers_lof", f"""{_LOF}
SELECT p_partkey, p_size, p_retailprice, CASE WHEN score > {_CUT} THEN 'outlier' ELSE 'inlier' END AS part FROM f""")
def _lof(spark, sf):
    inside, outside = outliers(_parts(spark, sf), method="lof", key=["p_partkey"])
    return inside.withColumn("part", F.lit("inlier")).unionByName(outside.withColumn("part", F.lit("outlier")))


@query("outliers_isolation_forest")
def _isolation(spark, sf):
    li = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day"))
    t = set_roles(li, metas=["o_orderkey"])
    inside, outside = outliers(t, method="isolation_forest", key=["o_orderkey"])
    return inside.withColumn("part", F.lit("inlier")).unionByName(outside.withColumn("part", F.lit("outlier")))


@query("outliers_covariance")
def _covariance(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    t = set_roles(li, metas=["l_orderkey"])
    inside, outside = outliers(t, method="covariance", key=["l_orderkey"])
    return inside.withColumn("part", F.lit("inlier")).unionByName(outside.withColumn("part", F.lit("outlier")))


@query("kmeans_annotated")
def _kmeans(spark, sf):
    t = normalize(_parts(spark, sf))
    annotated, _ = kmeans(t, k=3)
    return rounded(annotated)


@query("kmeans_centroids")
def _centroids(spark, sf):
    t = normalize(_parts(spark, sf))
    _, centroids = kmeans(t, k=3)
    return rounded(centroids)


# Distinct points; core = at least 5 rows within 12; clusters by a recursive walk over core points.
@query("dbscan", """
WITH RECURSIVE p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y, count(*) AS w, min(p_partkey) AS k FROM part GROUP BY 1, 2),
pr AS (SELECT a.k AS a, b.k AS b, b.w FROM p a, p b
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 3.0::DOUBLE),
core AS (SELECT a FROM pr GROUP BY a HAVING sum(w) >= 5),
e AS (SELECT a, b FROM pr SEMI JOIN core c1 ON pr.a = c1.a),
ee AS (SELECT a, b FROM e SEMI JOIN core ON e.b = core.a),
r AS (SELECT a AS origin, a AS here FROM core UNION SELECT r.origin, ee.b FROM r JOIN ee ON r.here = ee.a),
comp AS (SELECT here AS a, min(origin) AS c FROM r GROUP BY here),
num AS (SELECT c, row_number() OVER (ORDER BY c) AS number FROM (SELECT DISTINCT c FROM comp)),
named AS (SELECT a, number FROM comp JOIN num USING (c)),
border AS (SELECT pr.a, min(number) AS number FROM pr JOIN named ON pr.b = named.a
  WHERE pr.a NOT IN (SELECT a FROM core) GROUP BY pr.a),
final AS (SELECT * FROM named UNION ALL SELECT * FROM border)
SELECT p_partkey, CASE WHEN number IS NULL THEN 'Noise' ELSE 'C' || number END AS "Cluster"
FROM part JOIN p ON p_size = p.x AND p_retailprice = p.y LEFT JOIN final ON p.k = final.a""")
def _dbscan(spark, sf):
    return dbscan(_parts(spark, sf), eps=3.0, min_samples=5, key=["p_partkey"]).select("p_partkey", "Cluster")
