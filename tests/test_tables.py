"""Domain, sources, rows, joins, stacking, samples."""

import pytest
from pyspark.sql import functions as F

from tablemine.domain import CLASS, CONTINUOUS, DISCRETE, META, STRING, TIME, ColumnSpec, domain_of, set_roles
from tablemine.operators.combine import concatenate, merge
from tablemine.operators.rows import edit_domain, preview, select_columns, select_rows
from tablemine.operators.sampling import sample
from tablemine.session import scratch_path
from tablemine.sources.records import records_to_table, table_to_records
from tablemine.sources.tables import describe_domain, load_table, save_table, to_table


def roles(df):
    return {c.name: c.role for c in domain_of(df).columns}


@pytest.fixture
def mixed(spark):
    return spark.createDataFrame(
        [(1, "12", "a", 1.0), (2, "x", "b", float("nan")), (3, "", "z", None), (4, None, None, 4.0)], "id int, t string, d string, n double"
    )


def test_explicit_schema(mixed):
    t = to_table(mixed, [
        ColumnSpec("t", CONTINUOUS), ColumnSpec("d", DISCRETE, CLASS, ("a", "b")), ColumnSpec("n", CONTINUOUS), ColumnSpec("id", STRING, META),
    ])
    assert [tuple(r) for r in t.orderBy("id").collect()] == [
        (12.0, "a", 1.0, "1"), (None, "b", None, "2"), (None, None, None, "3"), (None, None, 4.0, "4")]
    assert roles(t) == {"t": "attribute", "d": "class", "n": "attribute", "id": "meta"}
    assert domain_of(t)["d"].values == ("a", "b")


def test_time_column(spark):
    t = to_table(spark.createDataFrame([("2020-01-02 03:04:05", 10.5), ("no", 0.0)], "a string, b double"), [ColumnSpec("a", TIME), ColumnSpec("b", TIME)])
    first, second = t.select(F.unix_micros("a"), F.unix_micros("b")).collect()
    assert tuple(first) == (1577934245000000, 10500000) and tuple(second) == (None, 0)


def test_text_attribute_is_refused(mixed):
    with pytest.raises(ValueError):
        to_table(mixed, [ColumnSpec("t", STRING)])
    with pytest.raises(TypeError):
        to_table(mixed.select(F.array("id").alias("a")), [ColumnSpec("a", CONTINUOUS)])


def test_inferred_schema(spark):
    df = spark.range(30).select(F.col("id"), F.concat(F.lit("v"), F.col("id")).alias("many"), F.concat(F.lit("v"), F.col("id") % 20).alias("few"))
    found = {r.name: (r.role, r.var_type) for r in describe_domain(to_table(df)).collect()}
    assert found == {"id": ("attribute", "continuous"), "many": ("meta", "string"), "few": ("attribute", "discrete")}


def test_roles_survive(read):
    c = set_roles(read("customer"), discrete=["c_mktsegment"], target="c_mktsegment", metas=["c_custkey"])
    want = roles(c)
    match, rest = select_rows(c, [{"column": "c_acctbal", "op": ">", "value": 0}])
    s, r = sample(c, pct=50, key=["c_custkey"])
    for t in (match, rest, s, r, merge(c, read("nation"), key1="c_nationkey", key2="n_nationkey"), concatenate(c, c)):
        assert roles(t) | want == roles(t)


@pytest.mark.parametrize("ext", ["csv", "tsv", "tab", "json", "parquet", "orc"])
def test_save_and_load(spark, read, ext):
    path = scratch_path(spark, "t") + "." + ext
    supplier = read("supplier")
    assert save_table(supplier, path) is supplier
    assert sorted(load_table(spark, path, supplier.schema).collect()) == sorted(supplier.collect())


def test_load_edge_cases(spark, sf):
    assert load_table(spark, "") is None
    assert load_table(spark, "region", dataset_dir=sf).count() == 5
    with pytest.raises(ValueError):
        load_table(spark, "region.xyz")


def test_records_round_trip(spark):
    rows = spark.createDataFrame([(1.0, 2.0, "A"), (3.0, 4.0, "B"), (5.0, 6.0, None)], "x double, y double, label string")
    records = table_to_records(rows)
    assert '"label":null' in records.collect()[2].value
    back = records_to_table(records, "x double, y double, label string")
    assert sorted(back.collect(), key=str) == sorted(rows.collect(), key=str)


def test_records_lists(spark):
    m = spark.createDataFrame([("[]",), ('[{"x": 1}, {"x": 2}]',)], "value string")
    assert [r.x for r in records_to_table(m, "x int").collect()] == [1, 2]
    with pytest.raises(Exception, match="not a list of records"):
        records_to_table(spark.createDataFrame([("7",)], "value string"), "x int").collect()


def test_missing_in_filters(mixed):
    def ids(op, value=None, column="n"):
        return sorted(r.id for r in select_rows(mixed.where("n is null or n = n"), [{"column": column, "op": op, "value": value}])[0].collect())

    assert ids("!=", "a", "d") == [2, 3, 4]
    assert ids("==", "a", "d") == [1]
    assert ids("is_missing", column="d") == [4]
    match, rest = select_rows(mixed, [])
    assert match.count() == 4 and rest.count() == 0


def test_select_columns_quirks(read):
    c = set_roles(read("customer"), discrete=["c_mktsegment"], target="c_mktsegment")
    assert roles(select_columns(c)) == roles(c)
    t = select_columns(c, ["c_acctbal", "c_nationkey", "nope"], metas=["c_nationkey"])
    assert roles(t) == {"c_acctbal": "attribute", "c_mktsegment": "class", "c_nationkey": "meta"}


def test_edit_domain_target_follows_rename(read):
    t = edit_domain(read("customer"), rename={"c_acctbal": "balance"}, retype={"balance": "discrete"}, set_target="c_acctbal")
    assert domain_of(t).class_var == ColumnSpec("balance", DISCRETE, CLASS)


def test_missing_keys_match(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(None, "p"), (2, "q")], "k int, v string")
    assert [tuple(r) for r in merge(a, b, key1="k").collect()] == [(None, "y", "p")]
    assert merge(a, b, key1="k", how="outer").columns == ["k", "v", "v_extra"]
    assert sorted(map(str, merge(a, b, key1="k", how="outer").select("k").collect())) == ["Row(k=1)", "Row(k=2)", "Row(k=None)"]
    assert merge(a, None, key1="k") is a and merge(a, b, key1="") is a


def test_concatenate_guards(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    assert concatenate(a, None) is a and concatenate(None, a) is a and concatenate(None, None) is None
    b = spark.createDataFrame([(2, 3.0)], "k int, w double")
    t = concatenate(a, b, source_column=True)
    assert [tuple(r) for r in t.orderBy("k").collect()] == [(1, "x", "Data", None), (2, None, "Extra Data", 3.0)]


def test_preview(read):
    page = preview(read("customer"), 10, 5, order_by=["c_custkey"])
    rows = page.collect()
    assert len(rows) == 10 and rows[0].total_rows == 150 and [r.c_custkey for r in rows] == list(range(rows[0].c_custkey, rows[0].c_custkey + 10))


@pytest.mark.parametrize("settings", [
    {"pct": 80}, {"kind": "fixed", "n": 0}, {"kind": "fixed", "n": 10}, {"kind": "fixed", "n": 999}, {"kind": "cv", "folds": 4, "fold": 2},
    {"kind": "cv", "folds": 4, "stratify": "c_mktsegment"}, {"pct": 33, "stratify": "c_mktsegment"}, {"kind": "fixed", "n": 50, "stratify": "c_mktsegment"},
])
def test_samples_split_the_table(read, settings):
    c = read("customer")
    s, r = sample(c, key=["c_custkey"], **settings)
    a, b = {x.c_custkey for x in s.collect()}, {x.c_custkey for x in r.collect()}
    assert not a & b and len(a) + len(b) == 150
    again, _ = sample(c.repartition(7), key=["c_custkey"], **settings)
    assert a == {x.c_custkey for x in again.collect()}
    if settings == {"pct": 80}:
        assert len(a) == 120
    if settings.get("kind") == "fixed":
        assert len(a) == min(settings["n"], 150)


def test_draws(read):
    c = read("customer")
    s, r = sample(c, kind="bootstrap", key=["c_custkey"])
    drawn = [x.c_custkey for x in s.collect()]
    assert len(drawn) == 150 and len(set(drawn)) < 150 and {x.c_custkey for x in r.collect()} == set(range(min(drawn), min(drawn))) | {
        x.c_custkey for x in c.collect()} - set(drawn)
