"""Queries over samples and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemine.operators.sampling import sample
from tablemine.plans.registry import query, table


def _both(pair, *columns):
    s, r = pair
    return s.select(*columns, F.lit("sample").alias("part")).unionByName(r.select(*columns, F.lit("remaining").alias("part")))


_CUST = "SELECT c_custkey, c_acctbal, c_mktsegment, md5('42|' || length(c_custkey::VARCHAR) || ':' || c_custkey) AS h, count(*) OVER () AS total FROM customer"
_ORD = "SELECT o_orderkey, o_orderpriority, md5('42|' || length(o_orderkey::VARCHAR) || ':' || o_orderkey) AS h, count(*) OVER () AS total FROM orders"


@query("sample_proportion", f"""
SELECT c_custkey, c_acctbal, CASE WHEN row_number() OVER (ORDER BY h) <= ceil(0.7 * total) THEN 'sample' ELSE 'remaining' END AS part
FROM ({_CUST})""")
def _proportion(spark, sf):
    return _both(sample(table(spark, sf, "customer"), pct=70, key=["c_custkey"]), "c_custkey", "c_acctbal")


@query("sample_fixed", f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY h) <= 1000 THEN 'sample' ELSE 'remaining' END AS part FROM ({_ORD})""")
def _fixed(spark, sf):
    return _both(sample(table(spark, sf, "orders"), kind="fixed", n=1000, key=["o_orderkey"]), "o_orderkey")


def _draw_sql(k: str) -> str:
    return f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY h) - 1 AS pos, total FROM ({_ORD})),
d AS (SELECT ('0x' || substr(md5('42|draw|' || j), 1, 12))::BIGINT % (SELECT count(*) FROM orders) AS pos, count(*) AS times
      FROM range({k}) AS g(j) GROUP BY 1),
w AS (SELECT o_orderkey, coalesce(times, 0) AS times FROM r LEFT JOIN d USING (pos))
SELECT o_orderkey, CASE WHEN times > 0 THEN 'sample' ELSE 'remaining' END AS part
FROM (SELECT o_orderkey, times, unnest(range(greatest(times, 1))) AS copy FROM w)"""


@query("sample_replacement", _draw_sql("2000"))
def _replacement(spark, sf):
    return _both(sample(table(spark, sf, "orders"), kind="fixed", n=2000, replacement=True, key=["o_orderkey"]), "o_orderkey")


@query("sample_bootstrap", _draw_sql("(SELECT count(*) FROM orders)"))
def _bootstrap(spark, sf):
    return _both(sample(table(spark, sf, "orders"), kind="bootstrap", key=["o_orderkey"]), "o_orderkey")


@query("sample_cv_fold", f"""
SELECT o_orderkey, CASE WHEN (row_number() OVER (ORDER BY h) - 1) % 10 = 2 THEN 'remaining' ELSE 'sample' END AS part FROM ({_ORD})""")
def _cv(spark, sf):
    return _both(sample(table(spark, sf, "orders"), kind="cv", folds=10, fold=3, key=["o_orderkey"]), "o_orderkey")


@query("sample_cv_stratified", f"""
SELECT o_orderkey, o_orderpriority,
  CASE WHEN (row_number() OVER (PARTITION BY o_orderpriority ORDER BY h) - 1) % 10 = 0 THEN 'remaining' ELSE 'sample' END AS part
FROM ({_ORD})""")
def _cv_stratified(spark, sf):
    pair = sample(table(spark, sf, "orders"), kind="cv", stratify="o_orderpriority", key=["o_orderkey"])
    return _both(pair, "o_orderkey", "o_orderpriority")


@query("sample_stratified", f"""
SELECT o_orderkey, o_orderpriority,
  CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY h) <= ceil(0.7 * count(*) OVER (PARTITION BY o_orderpriority))
       THEN 'sample' ELSE 'remaining' END AS part
FROM ({_ORD})""")
def _stratified(spark, sf):
    pair = sample(table(spark, sf, "orders"), pct=70, stratify="o_orderpriority", key=["o_orderkey"])
    return _both(pair, "o_orderkey", "o_orderpriority")
