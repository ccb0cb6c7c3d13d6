"""Chat logs to training text: snapshots that a longer logged conversation continues are dropped, the rest is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablemine.llm.common import written

#: Turn numbers in a block; a long conversation is as many tasks as it has blocks.
BLOCK_TURNS = 256

# The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _mark(c: Column) -> Column:
    """Text that tells NULL from every value."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def prefixes(df: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, c, position, n_turns, p1, p2): each turn's place and the rolling hash of all turns up to it.

    A turn's hash covers its place, role and text; the rolling hash of a prefix is the exclusive-or of its turns' (2 x 64 bits).
    Places and hashes are added up per block of turn numbers and then over blocks, so no conversation is gathered in one task.
    Turns logged twice in one conversation with the same number, role and text count once; equal numbers are ordered by role
    and text. NULL conversations are one conversation; NULL turn numbers come first; NULL and empty texts differ.
    """
    names = {"conv_id": conversation, "turn": turn, "role": role, "text": text}
    rows = df.select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()]).distinct()
    rows = rows.withColumn("c", _mark(F.col("conv_id"))).withColumn("b", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))).cast("long"))
    inside = W.partitionBy("c", "b").orderBy("turn", "role", "text")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    lower = W.partitionBy("c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    rows = written(rows.withColumn("i", F.row_number().over(inside)), "chat-turns")

    sizes = rows.groupBy("c", "b").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.select("c", "b", F.coalesce(F.sum("k").over(lower), F.lit(0)).alias("before"), F.sum("k").over(W.partitionBy("c")).alias("n_turns"))
    placed = rows.join(sizes, ["c", "b"]).withColumn("position", (F.col("i") + F.col("before")).cast("long")).drop("i", "before")
    own = lambda k: F.xxhash64(F.lit(k), F.col("position"), _mark(F.col("role")), _mark(F.col("text")))
    placed = placed.withColumn("h1", own(1)).withColumn("h2", own(2))
    sums = placed.groupBy("c", "b").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    sums = sums.select("c", "b", *[F.coalesce(F.bit_xor(f"x{k}").over(lower), F.lit(0)).alias(f"l{k}") for k in (1, 2)])
    rolled = placed.withColumn("r1", F.bit_xor("h1").over(upto)).withColumn("r2", F.bit_xor("h2").over(upto)).join(sums, ["c", "b"])
    return rolled.select(
        "conv_id", "turn", "role", "text", "c", "position", "n_turns", F.col("r1").bitwiseXOR(F.col("l1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("l2")).alias("p2")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(c): the conversations of :func:`prefixes` that no longer one begins with; of equal ones the smallest conversation.

    Prefixes are made distinct before the anti-join, so a first turn shared by a third of the log is one row.
    """
    whole = turns.where("position = n_turns").groupBy("position", "p1", "p2").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "c")).alias("m"))
    inner = turns.where("position < n_turns").select("position", "p1", "p2").distinct()
    return whole.join(inner, ["position", "p1", "p2"], "left_anti").select(F.col("m.c").alias("c"))


def render(role: Column, text: Column) -> Column:
    """One turn between its marks. Marks inside a role or text are made harmless; NULL is empty."""
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), clean(role), F.lit("\n"), clean(text), F.lit(CLOSE), F.lit("\n"))


def formatted(df: DataFrame, **names: str) -> DataFrame:
    """(conv_id, turn, position, n_turns, role, rendered): every turn of the maximal conversations, ready to be joined in order.

    Other columns of ``df`` are ignored, whatever their names; long texts are rendered whole; NULL roles and texts are rendered
    as empty ones but differ from them in the comparison; repeated rows count once; an empty log gives no row.
    """
    turns = written(prefixes(df, **names), "chat-prefixes")
    kept = turns.join(maximal(turns), "c", "left_semi")
    return kept.select("conv_id", "turn", "position", "n_turns", "role", render(F.col("role"), F.col("text")).alias("rendered"))
