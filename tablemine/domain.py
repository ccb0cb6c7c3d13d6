"""Column roles and variable types, carried in the metadata of DataFrame fields.

A table is a plain DataFrame. Each field may carry ``{"role": ..., "var_type": ...}`` in its metadata:
role is attribute, class or meta; var_type is continuous, discrete, time or string. A discrete field lists its
ordered ``values``. Spark drops metadata on every computed expression, so operators that compute a column put it
back through :func:`stamp`.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRIBUTE, CLASS, META = "attribute", "class", "meta"
CONTINUOUS, DISCRETE, TIME, STRING = "continuous", "discrete", "time", "string"

#: A text column with at most this many distinct values is inferred as discrete.
DISCRETE_CAP = 20
#: Encoders and classifiers refuse a discrete column with more distinct values than this.
VALUES_GUARD = 1000


@dataclass(frozen=True)
class ColumnSpec:
    """Description of one column: its name, type, role and (if discrete) its ordered values."""

    name: str
    var_type: str
    role: str = ATTRIBUTE
    values: tuple[str, ...] = ()
    decimals: int | None = None

    def metadata(self) -> dict:
        out: dict = {"role": self.role, "var_type": self.var_type}
        if self.values:
            out["values"] = list(self.values)
        if self.decimals is not None:
            out["decimals"] = self.decimals
        return out


@dataclass(frozen=True)
class Domain:
    """Ordered column specs of a table, grouped by role."""

    columns: tuple[ColumnSpec, ...] = field(default_factory=tuple)

    def with_role(self, role: str) -> list[ColumnSpec]:
        return [c for c in self.columns if c.role == role]

    @property
    def attributes(self) -> list[ColumnSpec]:
        return self.with_role(ATTRIBUTE)

    @property
    def class_vars(self) -> list[ColumnSpec]:
        return self.with_role(CLASS)

    @property
    def metas(self) -> list[ColumnSpec]:
        return self.with_role(META)

    @property
    def class_var(self) -> ColumnSpec | None:
        found = self.class_vars
        return found[0] if len(found) == 1 else None

    def continuous(self) -> list[str]:
        return [c.name for c in self.attributes if c.var_type == CONTINUOUS]

    def discrete(self) -> list[str]:
        return [c.name for c in self.attributes if c.var_type == DISCRETE]

    def __getitem__(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    def __contains__(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)


def col(name: str) -> Column:
    """Reference a column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def stamp(expr: Column, spec: ColumnSpec) -> Column:
    """Name an expression and attach its role and type."""
    return expr.alias(spec.name, metadata=spec.metadata())


def default_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return DISCRETE
    if isinstance(data_type, T.NumericType):
        return CONTINUOUS
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    if isinstance(data_type, T.StringType):
        return STRING
    raise TypeError(f"columns of type {data_type.simpleString()} have no place in a table; flatten them first")


def spec_of(f: T.StructField) -> ColumnSpec:
    """Spec of a field: its metadata if stamped, else a default by Spark type (text becomes a meta)."""
    meta = f.metadata or {}
    if "role" in meta:
        return ColumnSpec(f.name, meta["var_type"], meta["role"], tuple(meta.get("values", ())), meta.get("decimals"))
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return ColumnSpec(f.name, STRING, META)
    var_type = default_type(f.dataType)
    return ColumnSpec(f.name, var_type, META if var_type == STRING else ATTRIBUTE)


def domain_of(df: DataFrame) -> Domain:
    return Domain(tuple(spec_of(f) for f in df.schema.fields))


def restamp(df: DataFrame, specs: Iterable[ColumnSpec]) -> DataFrame:
    """Select the columns of ``specs`` in that order with their metadata set."""
    return df.select(*[stamp(col(s.name), s) for s in specs])


def set_roles(
    df: DataFrame,
    *,
    target: str | None = None,
    metas: Iterable[str] = (),
    discrete: Iterable[str] = (),
    attributes: Iterable[str] | None = None,
) -> DataFrame:
    """Give roles to the columns of ``df``; ``attributes`` (if given) sends all other columns to the metas."""
    metas, discrete = set(metas), set(discrete)
    keep = None if attributes is None else set(attributes)
    out = []
    for s in domain_of(df).columns:
        if s.name in discrete:
            s = replace(s, var_type=DISCRETE, role=ATTRIBUTE)
        if s.name == target:
            s = replace(s, role=CLASS)
        elif s.name in metas or (keep is not None and s.name not in keep):
            s = replace(s, role=META)
        elif keep is not None and s.name in keep:
            s = replace(s, role=ATTRIBUTE)
        out.append(s)
    return restamp(df, out)


def discrete_values(df: DataFrame, names: Iterable[str], *, limit: int = VALUES_GUARD) -> dict[str, list[str]]:
    """Ordered values of discrete columns: the declared ones, else the sorted distinct ones.

    Undeclared values are found with one map-side combined aggregate per call; more than ``limit`` of them is an
    error, so what reaches the driver is bounded by columns x limit.
    """
    domain = domain_of(df)
    out = {n: list(domain[n].values) for n in names}
    unknown = [n for n, v in out.items() if not v]
    if unknown:
        pairs = df.select(
            F.explode(F.array(*[F.struct(F.lit(n).alias("c"), col(n).cast("string").alias("v")) for n in unknown])).alias("p")
        ).select("p.c", "p.v")
        rows = pairs.where("v is not null").distinct().limit(limit * len(unknown) + 1).collect()
        for r in rows:
            out[r.c].append(r.v)
        for n in unknown:
            if len(out[n]) > limit or len(rows) > limit * len(unknown):
                raise ValueError(f"discrete column {n!r} has more than {limit} distinct values")
            out[n].sort()
    return out


def finite(c: Column) -> Column:
    """Cast to double with NaN as NULL: missing values are NULL everywhere."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)
