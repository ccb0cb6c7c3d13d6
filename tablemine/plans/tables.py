"""Queries over sources, columns, rows, joins and stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemine.domain import CLASS, CONTINUOUS, DISCRETE, META, STRING, TIME, ColumnSpec, domain_of, set_roles
from tablemine.operators.combine import concatenate, merge
from tablemine.operators.rows import edit_domain, preview, select_columns, select_rows
from tablemine.plans.registry import query, table
from tablemine.session import scratch_path
from tablemine.sources.records import records_to_table, table_to_records
from tablemine.sources.tables import describe_domain, load_table, save_table, to_table, with_values


@query("load_table", """
SELECT 'file' AS how, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment
UNION ALL
SELECT 'name', c_mktsegment, count(*), round(sum(c_acctbal), 2) FROM customer GROUP BY c_mktsegment""")
def _load_table(spark, sf):
    by_file = load_table(spark, f"{sf}/customer.parquet")
    by_name = load_table(spark, "customer", dataset_dir=sf)
    sums = [
        df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
        .select(F.lit(how).alias("how"), "c_mktsegment", "n", "total")
        for how, df in (("file", by_file), ("name", by_name))
    ]
    return sums[0].unionByName(sums[1])


@query("save_table", """
SELECT f.fmt, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier,
(VALUES ('csv'), ('tsv'), ('tab'), ('json'), ('parquet'), ('orc')) AS f(fmt)""")
def _save_table(spark, sf):
    supplier = table(spark, sf, "supplier")
    out = None
    for fmt in ("csv", "tsv", "tab", "json", "parquet", "orc"):
        path = scratch_path(spark, "saved") + "." + fmt
        save_table(supplier, path)
        back = load_table(spark, path, supplier.schema).select(F.lit(fmt).alias("fmt"), *supplier.columns)
        out = back if out is None else out.unionByName(back)
    return out


@query("ingest_schema", """
SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS qty,
       CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag END AS flag,
       epoch_us(l_shipdate) / 1000000 AS ship_seconds, TRY_CAST(l_linestatus AS DOUBLE) AS status_number
FROM lineitem""")
def _ingest_schema(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("string").alias("qty"), F.col("l_returnflag").alias("flag"),
        F.col("l_shipdate").cast("string").alias("ship"), F.col("l_linestatus").alias("status_number"),
    )
    t = to_table(raw.withColumn("l_orderkey", F.col("l_orderkey").cast("string")), [
        ColumnSpec("l_orderkey", STRING, META), ColumnSpec("qty", CONTINUOUS),
        ColumnSpec("flag", DISCRETE, CLASS, ("A", "N")), ColumnSpec("ship", TIME), ColumnSpec("status_number", CONTINUOUS),
    ])
    return t.select(
        F.col("l_orderkey").cast("long").alias("l_orderkey"), "qty", "flag",
        (F.unix_micros("ship") / 1000000).alias("ship_seconds"), "status_number",
    )


@query("infer_schema", """
WITH u AS (UNPIVOT (SELECT o_orderstatus, o_orderpriority, o_orderkey::VARCHAR || 'x' AS tag FROM orders)
           ON o_orderstatus, o_orderpriority, tag INTO NAME name VALUE v),
d AS (SELECT name, count(DISTINCT v) AS k, string_agg(DISTINCT v, ',' ORDER BY v) AS vals FROM u GROUP BY name)
SELECT name, CASE WHEN k <= 20 THEN 'attribute' ELSE 'meta' END AS role,
       CASE WHEN k <= 20 THEN 'discrete' ELSE 'string' END AS var_type, CASE WHEN k <= 20 THEN vals ELSE '' END AS vals FROM d
UNION ALL VALUES ('o_totalprice', 'attribute', 'continuous', ''), ('o_orderdate', 'attribute', 'time', '')""")
def _infer_schema(spark, sf):
    raw = table(spark, sf, "orders").select(
        "o_orderstatus", "o_orderpriority", F.concat(F.col("o_orderkey").cast("string"), F.lit("x")).alias("tag"),
        "o_totalprice", "o_orderdate",
    )
    return describe_domain(to_table(raw)).select("name", "role", "var_type", F.concat_ws(",", "values").alias("vals"))


@query("describe_domain", """
SELECT 0 AS position, 'c_acctbal' AS name, 'attribute' AS role, 'continuous' AS var_type, '' AS vals
UNION ALL SELECT 1, 'c_mktsegment', 'class', 'discrete', string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer
UNION ALL SELECT 2, 'c_name', 'meta', 'string', ''""")
def _describe_domain(spark, sf):
    t = set_roles(table(spark, sf, "customer").select("c_acctbal", "c_mktsegment", "c_name"), discrete=["c_mktsegment"], target="c_mktsegment")
    return describe_domain(with_values(t)).select("position", "name", "role", "var_type", F.concat_ws(",", "values").alias("vals"))


@query("records_in", "SELECT event_id, value, event_type FROM events")
def _records_in(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", "event_type")
    batch = F.floor(F.col("event_id") / 20)
    messages = e.groupBy(batch.alias("b")).agg(F.to_json(F.collect_list(F.struct(*e.columns))).alias("value"))
    singles = messages.select("value").unionByName(spark.createDataFrame([("[]",)], "value string"))
    return records_to_table(singles, "event_id bigint, value double, event_type string")


@query("records_out", """
SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS record
FROM nation
UNION ALL
SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":' ||
  CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' FROM orders""")
def _records_out(spark, sf):
    n = table(spark, sf, "nation")
    out = table_to_records(n, column="record")
    keyed = out.select(F.get_json_object("record", "$.n_nationkey").cast("long").alias("n_nationkey"), "record")
    o = table(spark, sf, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"))
    orders = table_to_records(o, column="record")
    return keyed.unionByName(orders.select(F.get_json_object("record", "$.o_orderkey").cast("long").alias("n_nationkey"), "record"))


# --- columns and rows -------------------------------------------------------------------------------------------


@query("select_columns", """
SELECT c_acctbal, c_mktsegment, c_custkey, 'c_acctbal:attribute,c_mktsegment:class,c_custkey:meta' AS roles FROM customer""")
def _select_columns(spark, sf):
    c = set_roles(table(spark, sf, "customer"), discrete=["c_mktsegment"])
    t = select_columns(c, ["c_acctbal", "c_mktsegment", "c_custkey", "unknown"], "c_mktsegment", ["c_custkey"])
    roles = ",".join(f"{s.name}:{s.role}" for s in domain_of(t).columns)
    return t.withColumn("roles", F.lit(roles))


_PART = "p_partkey, p_brand, p_size, p_retailprice"
_GAPS = "(SELECT p_partkey, CASE WHEN p_size <> 7 THEN p_size END AS p_size, CASE WHEN p_brand <> 'Brand#13' THEN p_brand END AS p_brand, p_retailprice FROM part)"
_FILTERS = [
    {"column": "p_size", "op": ">", "value": 5}, {"column": "p_size", "op": "<=", "value": 40},
    {"column": "p_brand", "op": "!=", "value": "Brand#21"}, {"column": "nope", "op": "==", "value": 1},
    {"column": "p_size", "op": "~", "value": 1},
]


def _gappy_part(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") != 7, F.col("p_size")).alias("p_size"),
        F.when(F.col("p_brand") != "Brand#13", F.col("p_brand")).alias("p_brand"), "p_retailprice",
    )


_MATCH = "coalesce(p_size > 5, false) AND coalesce(p_size <= 40, false) AND p_brand IS DISTINCT FROM 'Brand#21'"


@query("select_rows_match", f"SELECT {_PART} FROM {_GAPS} WHERE {_MATCH}")
def _rows_match(spark, sf):
    return select_rows(_gappy_part(spark, sf), _FILTERS)[0]


@query("select_rows_unmatch", f"SELECT {_PART} FROM {_GAPS} WHERE NOT ({_MATCH})")
def _rows_unmatch(spark, sf):
    return select_rows(_gappy_part(spark, sf), _FILTERS)[1]


@query("select_rows_any", f"SELECT {_PART} FROM {_GAPS} WHERE p_size = 3 OR p_retailprice >= 1500 OR p_brand = 'Brand#32'")
def _rows_any(spark, sf):
    filters = [
        {"column": "p_size", "op": "==", "value": 3}, {"column": "p_retailprice", "op": ">=", "value": 1500},
        {"column": "p_brand", "op": "==", "value": "Brand#32"},
    ]
    return select_rows(_gappy_part(spark, sf), filters, mode="any")[0]


@query("select_rows_missing", f"SELECT {_PART} FROM {_GAPS} WHERE p_size IS NULL AND p_brand IS NOT NULL")
def _rows_missing(spark, sf):
    filters = [{"column": "p_size", "op": "is_missing"}, {"column": "p_brand", "op": "is_present"}]
    return select_rows(_gappy_part(spark, sf), filters)[0]


@query("edit_domain_rename", """
SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus, 'price' AS target FROM orders""")
def _rename(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    t = edit_domain(o, rename={"o_orderkey": "id", "o_totalprice": "price", "gone": "x"}, set_target="o_totalprice")
    return t.withColumn("target", F.lit(domain_of(t).class_var.name))


@query("edit_domain_retype", """
SELECT n_nationkey, TRY_CAST(n_name AS DOUBLE) AS n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, 'discrete' AS kind FROM nation
UNION ALL
SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS DOUBLE), CAST(p_size AS VARCHAR), 'discrete' FROM part""")
def _retype(spark, sf):
    n = table(spark, sf, "nation")
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("n_nationkey"), F.expr("substr(p_brand, 7)").alias("n_name"), F.col("p_size").alias("n_regionkey")
    )
    out = []
    for df in (n, p):
        t = edit_domain(df, retype={"n_name": "continuous", "n_regionkey": "discrete", "nope": "string"})
        out.append(t.withColumn("kind", F.lit(domain_of(t)["n_regionkey"].var_type)).withColumn("n_nationkey", F.col("n_nationkey").cast("long")))
    return out[0].unionByName(out[1])


@query("edit_domain_target", """
SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey, 'c_mktsegment:meta,c_nationkey:class' AS roles FROM customer""")
def _target(spark, sf):
    c = set_roles(table(spark, sf, "customer").drop("c_name"), discrete=["c_mktsegment"], target="c_mktsegment")
    t = edit_domain(c, set_target="c_nationkey")
    roles = ",".join(f"{s.name}:{s.role}" for s in sorted(domain_of(t).columns, key=lambda s: s.name) if s.role != "attribute")
    return t.withColumn("roles", F.lit(roles))


@query("preview_page", """
SELECT *, (SELECT count(*) FROM customer) AS total_rows, 5 AS total_cols FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20)""")
def _preview(spark, sf):
    return preview(table(spark, sf, "customer"), 10, 20, order_by=["c_custkey"])


# --- joins and stacking -----------------------------------------------------------------------------------------

_DOCS = "(SELECT doc_id, lang, n_chars, 1 AS quality FROM documents)"
_LABELS = "(SELECT doc_id + 50 AS doc_id, quality, toxic FROM labels)"


def _doc_sides(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.lit(1).alias("quality"))
    l = table(spark, sf, "labels").select((F.col("doc_id") + 50).alias("doc_id"), "quality", "toxic")
    return d, l


for _how, _sql_how in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL OUTER")):
    _key = {"inner": "d.doc_id", "left": "d.doc_id"}.get(_how, "coalesce(d.doc_id, l.doc_id)")

    @query(f"merge_{_how}", f"""
SELECT {_key} AS doc_id, d.lang, d.n_chars, d.quality, l.quality AS quality_extra, l.toxic
FROM {_DOCS} d {_sql_how} JOIN {_LABELS} l ON d.doc_id IS NOT DISTINCT FROM l.doc_id
UNION ALL
SELECT a.o_custkey, a.o_orderstatus, a.o_orderkey, NULL, NULL, CAST(b.c_custkey AS INTEGER)
FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey > 10 THEN o_custkey END AS o_custkey FROM orders) a
{_sql_how} JOIN (SELECT nullif(c_custkey, 11) AS c_custkey FROM customer) b ON a.o_custkey IS NOT DISTINCT FROM b.c_custkey""")
    def _merge(spark, sf, how=_how):
        d, l = _doc_sides(spark, sf)
        first = merge(d, l, key1="doc_id", how=how)
        o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_custkey") > 10, F.col("o_custkey")).alias("o_custkey"))
        c = table(spark, sf, "customer").select(F.expr("nullif(c_custkey, 11)").alias("c_custkey"))
        second = merge(o, c, key1="o_custkey", key2="c_custkey", how=how)
        nothing = F.lit(None).cast("int")
        return first.unionByName(second.select(
            F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("lang"), F.col("o_orderkey").alias("n_chars"),
            nothing.alias("quality"), nothing.alias("quality_extra"), F.col("c_custkey").cast("int").alias("toxic"),
        ))


def _parties(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    s = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("id"), "s_name")
    return c, s


@query("concat_union", """
SELECT c_custkey AS id, c_acctbal AS acctbal, c_mktsegment, NULL AS s_name FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""")
def _union(spark, sf):
    return concatenate(*_parties(spark, sf))


@query("concat_intersection", """
SELECT c_custkey AS id, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier""")
def _intersection(spark, sf):
    return concatenate(*_parties(spark, sf), mode="intersection")


@query("concat_source", """
SELECT c_custkey AS id, c_acctbal AS acctbal, 'Data' AS "Source" FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, 'Extra Data' FROM supplier""")
def _source(spark, sf):
    return concatenate(*_parties(spark, sf), mode="intersection", source_column=True)
