"""What several operators share: words, scratch tables, small tables on large ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablemine.session import scratch_path

# A word is a run of other characters than these six.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows up to which a table is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Copies of every row of a larger table, so that a key with a third of all rows is that many tasks.
SALTS = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; NULL and empty texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], *, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join a table of one row per key; keys match NULL to NULL and are kept once, as ``df`` has them.

    Up to BROADCAST_ROWS rows, counted, are broadcast. A larger table is copied SALTS times and joined by key and salt, so
    a hot key is spread over many tasks; the copies grow with the small table only.
    """
    right = small.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    if (small.count() if rows is None else rows) <= BROADCAST_ROWS:
        out = df.join(F.broadcast(right), same, how)
    else:
        salted = right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int"))
        out = spread.join(salted, same & (F.col("_salt") == F.col("_salt_r")), how).drop("_salt", "_salt_r")
    return out.drop(*[f"_r_{k}" for k in keys])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def numbered(df: DataFrame, order: Sequence[Column], name: str, label: str = "numbered") -> DataFrame:
    """``df`` with the 1-based place of each row in the whole order; equal rows in any order.

    Rows go to ranges and are sorted there; the written table holds each row's place in its range, and only the sizes of the
    ranges, one row per task, meet in one window. No group is gathered, so a key with a third of the rows is many tasks.
    """
    at, task = fresh(df, "_at", "_task")
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = written(sorted_.withColumn(task, F.shiftright(F.col(at), 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))), label)
    sizes = rows.groupBy(task).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy(task).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col(task), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return attach(rows, starts, [task]).withColumn(name, F.col("_start") + F.col(at) + 1).drop(at, task, "_start")
