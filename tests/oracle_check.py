"""Run registered queries beside their SQL in DuckDB and report differences.

    python tests/oracle_check.py [--sf DIR] [--only name,name] [--prefix p]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import tempfile
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def normal(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = [tuple(normal(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(data, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(con, sql, names, rows) -> str | None:
    """None if equal, else the first difference."""
    rel = con.sql(sql)
    want_names, want = table_of(rel.columns, rel.fetchall())
    got_names, got = table_of(names, rows)
    if want_names != got_names:
        return f"columns {got_names} != {want_names}"
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"spark {a}\n   sql {b}"
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--prefix", default="")
    args = ap.parse_args()
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="oracle-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, sql = e.queries(), e.oracle_sql()
    names = [n for n in args.only.split(",") if n] or [n for n in queries if n.startswith(args.prefix)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, args.sf)
            rows = [tuple(r) for r in df.collect()]
            secs = time.time() - t
            diff = compare(con, sql[n], df.columns, rows) if n in sql else "rows-only"
            t2 = time.time() - t - secs
        except Exception as ex:
            secs, t2, rows, diff = time.time() - t, 0, [], "ERROR " + "".join(traceback.format_exception_only(ex))[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        state = "ok" if diff is None else ("rows" if diff == "rows-only" else "BAD")
        bad += state == "BAD"
        print(f"{state:4} {n:32} {secs:6.2f}s sql {t2:5.2f}s rows {len(rows)}" + (f"\n   {diff}" if state == "BAD" else ""), flush=True)
    print("bad:", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
