"""Merging tables by a key and stacking tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.domain import DISCRETE, META, STRING, ColumnSpec, col, domain_of, restamp, stamp


def merge(
    left: DataFrame | None, right: DataFrame | None, *, key1: str, key2: str | None = None, how: str = "inner"
) -> DataFrame | None:
    """Equi-join on one pair of keys, keeping roles. Missing keys match each other.

    Keys of the same name become one column; other shared names get the suffix ``_extra`` on the right. An unknown
    ``how`` means inner; without a key or a side the left table is returned. The join strategy is Spark's: a hash or
    sort-merge join on the null-safe key, with adaptive splitting of hot keys.
    """
    if left is None or right is None or not key1:
        return left
    key2 = key2 or key1
    how = how if how in ("inner", "left", "right", "outer") else "inner"
    ldom, rdom = domain_of(left), domain_of(right)
    l = left.select(*[col(s.name).alias(f"_l{i}") for i, s in enumerate(ldom.columns)])
    r = right.select(*[col(s.name).alias(f"_r{i}") for i, s in enumerate(rdom.columns)])
    lpos = {s.name: i for i, s in enumerate(ldom.columns)}
    rpos = {s.name: i for i, s in enumerate(rdom.columns)}
    lkey, rkey = F.col(f"_l{lpos[key1]}"), F.col(f"_r{rpos[key2]}")
    joined = l.join(r, lkey.eqNullSafe(rkey), how)
    same = key1 == key2
    shared = ({s.name for s in ldom.columns} & {s.name for s in rdom.columns}) - ({key1} if same else set())
    out = []
    for s in ldom.columns:
        value = F.col(f"_l{lpos[s.name]}")
        if same and s.name == key1 and how in ("right", "outer"):
            value = F.coalesce(lkey, rkey)
        out.append(stamp(value, s))
    for s in rdom.columns:
        if same and s.name == key2:
            continue
        name = f"{s.name}_extra" if s.name in shared else s.name
        out.append(stamp(F.col(f"_r{rpos[s.name]}"), replace(s, name=name)))
    return joined.select(*out)


def concatenate(
    a: DataFrame | None, b: DataFrame | None, *, mode: str = "union", source_column: bool = False
) -> DataFrame | None:
    """Stack two tables: all columns with gaps as NULL, or the common columns only (in the order of the first).

    A union in Spark moves no rows. Roles come from the first table that has the column.
    """
    if a is None or b is None:
        return b if a is None else a
    if source_column:
        source = ColumnSpec("Source", DISCRETE, META, ("Data", "Extra Data"))
        a = a.select("*", stamp(F.lit("Data"), source))
        b = b.select("*", stamp(F.lit("Extra Data"), source))
    if mode == "intersection":
        common = [c for c in a.columns if c in set(b.columns)]
        a, b = a.select(*[col(c) for c in common]), b.select(*[col(c) for c in common])
    specs = list(domain_of(a).columns)
    known = {s.name for s in specs}
    specs += [s for s in domain_of(b).columns if s.name not in known]
    merged = []
    for s in specs:
        if s.name in a.columns and s.name in b.columns:
            other = domain_of(b)[s.name]
            if s.var_type == DISCRETE and other.values and s.values:
                s = replace(s, values=s.values + tuple(v for v in other.values if v not in s.values))
            elif s.var_type != other.var_type and STRING in (s.var_type, other.var_type):
                s = replace(s, var_type=STRING, role=META, values=())
        merged.append(s)
    return restamp(a.unionByName(b, allowMissingColumns=True), merged)
