"""Mix sources to target weights: budgets cut the hash order of each source at a threshold found by histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablemine.llm.common import attach, written

#: Hexadecimal digits of the row hash that one histogram resolves: 4096 buckets per source.
DIGITS = 3
#: Hexadecimal digits of the row hash in all: 60 bits, so it is a positive long.
ALL_DIGITS = 15


def row_hash(key: Column, seed: int | str = 42) -> Column:
    """15 hexadecimal digits that depend on the seed and the key only."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("NULL")))), 1, ALL_DIGITS)


def targets(sizes: DataFrame, weights: Sequence[float], *, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` with weight and target: the budget ``share`` x all sizes dealt out by weight.

    Sources by code point, NULL last, take the weights in turn. No target is above ``most`` x its source's size; what is
    above goes to the others by weight. Sorted by size per weight the capped sources come first, so the level of the rest
    follows from running sums: no loop. One row per source, so one window over all of them.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1)
    one = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    whole = one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(whole))
    s = s.withColumn("_capped", F.coalesce(F.sum("cap").over(one.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.sum("weight").over(one.rowsBetween(0, W.unboundedFollowing)))
    settles = F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.col("_level"))
    level = F.first(settles, ignorenulls=True).over(whole)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return s.withColumn("target", target).select("source", "source_size", "weight", "target")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut): rows of a source with hash <= cut hold its budget as nearly as whole rows can; '' takes none.

    ``rows(source, h, size)``, ``budgets(source, budget)``. A histogram of sizes over the next DIGITS digits finds, for
    every source, the bucket in which its budget is used up; only that bucket goes on, with what is left of the budget.
    Five rounds resolve the whole hash, so the last bucket is one hash value (rows of equal ids stay together), taken if
    that brings the sum nearer. Nothing is sorted but buckets; each round reads one bucket in 4096 of the one before.
    """
    open_ = budgets.select("source", F.lit("").alias("p"), F.col("budget").alias("left"))
    at = rows
    for level in range(0, ALL_DIGITS, DIGITS):
        at = attach(at.drop("p", "left"), open_, ["source"], how="inner").where(F.col("h").startswith(F.col("p")))
        hist = at.groupBy("source", "p", "left", F.substring("h", level + 1, DIGITS).alias("b")).agg(F.sum("size").alias("n"))
        upto = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
        run = hist.withColumn("cum", F.sum("n").over(upto))
        last = W.partitionBy("source")
        ends = (F.col("cum") >= F.col("left")) | (F.col("b") == F.max("b").over(last))
        begun = run.withColumn("ends", ends).where(F.col("ends") & (F.col("cum") - F.col("n") < F.col("left")))
        edge = begun.withColumn("k", F.row_number().over(last.orderBy("b"))).where("k = 1")
        open_ = written(
            edge.select("source", F.concat("p", "b").alias("p"), (F.col("left") - (F.col("cum") - F.col("n"))).alias("left"), "n"), "mix-threshold"
        )
        last_round = open_
        open_ = open_.drop("n")
    takes = F.col("left") * 2 >= F.col("n")
    return last_round.select("source", F.col("p").alias("cut"), takes.alias("closed"))


def mix(df: DataFrame, weights: Sequence[float], *, size: Column, source: str = "source", key: str = "doc_id", share: float = 1.5,
        most: float = 2.0, seed: int | str = 42) -> DataFrame:
    """Every row of ``df`` with size, source_size, target (of its source) and copies: how often the mix takes it.

    Rows of a source with hash up to its threshold are taken floor(target / source_size) + 1 times, the others once less,
    so budgets are nested: a larger target only adds rows. NULL is a source of its own. A row of size 0 counts as any other, and
    so does a very long text, whose source is then off its target by up to half of it.
    Rows with one ``key`` are taken together. No row is dropped or sorted; an empty table gives an empty table. Columns
    of ``df`` that are named like the new ones are replaced.
    """
    new = ("size", "source_size", "target", "copies")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(row, F.col(f"`{source}`").alias("source"), row_hash(F.col(f"`{key}`"), seed).alias("h"), size.cast("long").alias("size"))
    slim = written(rows.select("source", "h", "size"), "mix-sizes")
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sums, weights, share=share, most=most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = written(goal.withColumn("whole", whole.cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goals")
    n = goal.count()
    cuts = thresholds(slim, goal.where("budget > 0"))
    plan = attach(goal, cuts, ["source"], rows=n).select("source", "source_size", "target", "whole", "cut", "closed")
    out = attach(rows, plan, ["source"], rows=n)
    inside = F.coalesce((F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & F.col("closed")), F.lit(False))
    out = out.withColumn("copies", (F.col("whole") + inside.cast("long")).cast("long"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in new], *new)


def taken(df: DataFrame, weights: Sequence[float], *, size: Column, source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken, with the columns of ``df``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_whole")
    packed = df.select(whole, F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("key"), size.cast("long").alias("size"))
    out = mix(packed, weights, size=F.col("size"), source="source", key="key", **how).where("copies > 0")
    many = out.select("_whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return many.select(*[F.col("_whole").getField(c).alias(c) for c in df.columns])
