"""Loading and saving tables, explicit and inferred schemas."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemine.domain import (
    ATTRIBUTE, CONTINUOUS, DISCRETE, DISCRETE_CAP, META, STRING, TIME,
    ColumnSpec, col, default_type, discrete_values, domain_of, finite, restamp, stamp,
)

# File extensions and the Spark reader each one uses.
FORMATS = {
    ".parquet": ("parquet", {}),
    ".orc": ("orc", {}),
    ".json": ("json", {}),
    ".csv": ("csv", {"header": True}),
    ".tsv": ("csv", {"header": True, "sep": "\t"}),
    ".tab": ("csv", {"header": True, "sep": "\t"}),
}


def load_table(
    spark: SparkSession,
    path: str | None,
    schema: T.StructType | str | None = None,
    *,
    dataset_dir: str | None = None,
) -> DataFrame | None:
    """Read a table by file extension; a bare name is ``<dataset_dir>/<name>.parquet``; no path, no table.

    Delimited text without a ``schema`` is read twice to infer types; give the schema for large inputs.
    """
    if not path:
        return None
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        if dataset_dir is None:
            raise ValueError(f"unknown table format {ext or path!r}; known: {', '.join(sorted(FORMATS))}")
        path, ext = f"{dataset_dir.rstrip('/')}/{path}.parquet", ".parquet"
    fmt, options = FORMATS[ext]
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    return reader.load(path)


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write by extension and hand the table on. Failures raise."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unknown table format {ext!r}; known: {', '.join(sorted(FORMATS))}")
    fmt, options = FORMATS[ext]
    df.write.format(fmt).options(**options).mode(mode).save(path)
    return df


def to_table(df: DataFrame, schema: Iterable[ColumnSpec] | None = None, *, discrete_cap: int = DISCRETE_CAP) -> DataFrame:
    """Apply an explicit schema (cast, map, assign roles) or infer one.

    Explicit: numbers that do not parse, times that do not parse and values outside the declared list become NULL.
    Inferred: every column is an attribute, except text with more than ``discrete_cap`` distinct values, a meta.
    """
    if schema is None:
        return _inferred(df, discrete_cap)
    out = []
    for s in schema:
        if s.var_type == STRING and s.role != META:
            raise ValueError(f"text column {s.name!r} can only be a meta")
        c = col(s.name)
        data_type = df.schema[s.name].dataType
        default_type(data_type)
        if s.var_type == CONTINUOUS:
            value = _number(c, data_type)
        elif s.var_type == TIME:
            value = _time(c, data_type)
        elif s.var_type == DISCRETE:
            text = c.cast("string")
            value = F.when(text.isin(list(s.values)), text) if s.values else text
        else:
            value = c.cast("string")
        out.append(stamp(value, s))
    return df.select(*out)


def _number(c, data_type: T.DataType):
    if isinstance(data_type, T.StringType):
        return finite(c.try_cast("double"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    return finite(c)


def _time(c, data_type: T.DataType):
    if isinstance(data_type, T.StringType):
        return c.try_cast("timestamp")
    if isinstance(data_type, T.NumericType):
        return F.timestamp_micros((c.cast("double") * 1e6).cast("long"))
    return c.cast("timestamp")


def _inferred(df: DataFrame, discrete_cap: int) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    values: dict[str, list[str]] = {}
    if texts:
        # One sketch pass settles the clearly large columns; the exact count then shuffles a few values per task.
        rough = df.agg(*[F.approx_count_distinct(col(n), 0.02).alias(f"n{i}") for i, n in enumerate(texts)]).first()
        near = [n for i, n in enumerate(texts) if rough[f"n{i}"] <= 2 * discrete_cap]
        pairs = F.array(*[F.struct(F.lit(n).alias("c"), col(n).alias("v")) for n in near])
        found = df.select(F.inline(pairs)).where("v is not null").distinct().collect() if near else []
        for n in near:
            seen = sorted(r.v for r in found if r.c == n)
            if len(seen) <= discrete_cap:
                values[n] = seen
    specs = []
    for f in df.schema.fields:
        if f.name in values:
            specs.append(ColumnSpec(f.name, DISCRETE, ATTRIBUTE, tuple(values[f.name])))
        elif f.name in texts:
            specs.append(ColumnSpec(f.name, STRING, META))
        else:
            specs.append(ColumnSpec(f.name, default_type(f.dataType), ATTRIBUTE))
    numeric = {s.name for s in specs if s.var_type == CONTINUOUS}
    return df.select(*[stamp(finite(col(s.name)) if s.name in numeric else col(s.name), s) for s in specs])


def with_values(df: DataFrame) -> DataFrame:
    """Declare the ordered values of every discrete column that does not list them yet."""
    domain = domain_of(df)
    names = [c.name for c in domain.columns if c.var_type == DISCRETE]
    values = discrete_values(df, names)
    return restamp(df, [replace(c, values=tuple(values[c.name])) if c.name in values else c for c in domain.columns])


def describe_domain(df: DataFrame) -> DataFrame:
    """One row per column: position, name, role, var_type, values, decimals."""
    rows = [
        (i, c.name, c.role, c.var_type, list(c.values), c.decimals) for i, c in enumerate(domain_of(df).columns)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, name string, role string, var_type string, `values` array<string>, decimals int"
    )
