"""Importance resampling towards a target: hashed n-gram buckets by a head-tail vocabulary, exact bucket totals, Gumbel draws."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablemine.llm.common import fresh, numbered, written
from tablemine.llm.vocabulary import counted, frequent, word_table

#: A word, or a pair of neighbours, is in the head if it makes up 1 / HEAD of all: so the head has at most HEAD entries.
HEAD = 1 << 15
#: Tail words a worker remembers; bounds its memory, never the result.
TAIL = 200_000

# Words are runs of 0-9, a-z and characters beyond ASCII, after A-Z are lower-cased.
LETTERS = word_table(lambda c: c.isdigit() or "a" <= c <= "z", lower=True)


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class HeadTail:
    """Buckets of all runs of one to ``longest`` words of a text.

    ``head`` has the CRC-32 state after each frequent word, ``pairs`` the bucket of each frequent pair. Any other word takes its
    CRC directly, any other pair goes on from its first word's state, a longer run from the state of the run before it. CRC-32 can
    be continued, so each way gives the very bucket of the joined bytes.
    """

    def __init__(self, head: list[bytes], pairs: list[bytes], longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.head = {w: zlib.crc32(w) for w in head}
        self.pairs = {tuple(p.split(b" ")): zlib.crc32(p) % buckets for p in pairs}
        self.tail: dict[bytes, int] = {}

    def state(self, word: bytes) -> int:
        """CRC state of a word outside the head."""
        found = self.tail.get(word)
        if found is None:
            if len(self.tail) >= TAIL:
                self.tail = {}
            found = self.tail[word] = zlib.crc32(word)
        return found

    def of(self, text: bytes) -> tuple[int, np.ndarray]:
        """(words, bucket of every feature): all single words, then all pairs, and so on."""
        w = words(text)
        head, tail = self.head.get, self.state
        states = np.fromiter((s if (s := head(x)) is not None else tail(x) for x in w), np.int64, len(w))
        out = [states % self.buckets]
        for k in range(1, min(self.longest, len(w))):
            ends = [b" " + x for x in w[k:]]
            if k == 1:
                known = self.pairs.get
                found = [(-1 if (b := known((a, x))) is None else b) for a, x in zip(w, w[1:])]
                if self.longest == 2:
                    out.append(np.fromiter((b if b >= 0 else zlib.crc32(x, s) % self.buckets for b, x, s in zip(found, ends, states.tolist())), np.int64, len(ends)))
                    break
            states = np.fromiter((zlib.crc32(x, s) for x, s in zip(ends, states.tolist())), np.int64, len(ends))
            out.append(states % self.buckets)
        return len(w), np.concatenate(out)


def features(df: DataFrame, head: list[bytes], frequent_pairs: list[bytes], longest: int, buckets: int, *, text: str, keep: list[Column]) -> DataFrame:
    """(columns of ``keep``, n_words, n_features, buckets): unsigned 16-bit numbers, 32-bit beyond 65,536 buckets."""
    spark = df.sparkSession
    rows = df.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("_text"))
    kept = rows.schema.names[:-1]
    shared = spark.sparkContext.broadcast((head, frequent_pairs))
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HeadTail(*shared.value, longest, buckets)
        for b in parts:
            found = [table.of(x.as_py()) for x in b.column("_text")]
            cols = [b.column(c) for c in kept]
            cols += [pa.array([n for n, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([x.astype(kind).tobytes() for _, x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "n_words", "n_features", "buckets"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(each, f"{own}{', ' if own else ''}n_words long, n_features long, buckets binary")


def totals(table: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how many features of ``table(buckets)`` lie in each bucket; tasks add up before the shuffle."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in parts:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["bucket", "n"])

    return table.select("buckets").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int, *, scale: int = 1000) -> DataFrame:
    """(bucket, gain) for every bucket: the floored, scaled logarithm of its smoothed share in the target over that in ``raw``."""
    sums = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    sums = sums.unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    sums = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(sums.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    every = W.partitionBy()  # one row per bucket
    all_s, all_t = F.sum(s).over(every), F.sum(t).over(every)
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return sums.select("bucket", F.floor(F.lit(float(scale)) * F.ln(ratio)).alias("gain"))


def weighed(table: DataFrame, gain: np.ndarray, *, name: str = "weight") -> DataFrame:
    """``table`` with the floored mean gain of its features in place of the buckets; 0 without features."""
    shared = table.sparkSession.sparkContext.broadcast(gain)
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    kept = [c for c in table.columns if c != "buckets"]

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in parts:
            sums = []
            for x in b.column("buckets"):
                at = np.frombuffer(x.as_py(), kind)
                sums.append(int(g[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(sums, pa.int64())], [*kept, name])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields if f.name != "buckets")
    return table.mapInArrow(each, f"{own}, {name} long")


def noise(key: Column, seed: int | str, scale: int = 1000) -> Column:
    """Floored, scaled Gumbel noise that depends on the seed and the key only."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("NULL"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(df: DataFrame, target: DataFrame, *, text: str = "text", key: str = "doc_id", longest: int = 1, buckets: int = 10_000, seed: int | str = 2024,
             least_words: int = 20, percent: int = 10, target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``df``; rank is NULL for rows that aren't drawn.

    Features are all runs of one to ``longest`` words; a row's weight is the mean log ratio of its buckets' shares in ``target`` and in
    ``df``, to which Gumbel noise is added, so the highest scores are a draw without replacement by importance. Of the rows with
    ``least_words`` words, floor(percent x rows / 100) are drawn; equal scores by key, NULL keys first, then in any order.

    The head of the vocabulary is counted exactly over both tables, as shares bound its size; it saves time and changes no bucket.
    Buckets are written once (two bytes a word) and read twice: for the totals and for the weights. NULL and empty texts have
    no features and weight 0; a NULL key is hashed as 'NULL'; repeated rows count and are drawn each for itself; an empty
    table gives no row, an empty target the gains of zero counts. Other columns are ignored.
    """
    both = df.select(F.col(f"`{text}`").alias("text")).unionByName(target.select(F.col(f"`{target_text}`").alias("text")))
    head = frequent(counted(both, words), HEAD, "resampling-words")
    head_pairs: list[bytes] = []
    if longest > 1:
        shared = df.sparkSession.sparkContext.broadcast(frozenset(head))

        def among_head(x: bytes) -> list[bytes]:  # a frequent pair has two frequent words
            known, w = shared.value, words(x)
            return [a + b" " + b for a, b in zip(w, w[1:]) if a in known and b in known]

        head_pairs = frequent(counted(both, among_head), HEAD, "resampling-pairs")
    rows = written(features(df, head, head_pairs, longest, buckets, text=text, keep=[F.col(f"`{key}`").alias("doc_id")]), "resampling-buckets")
    aims = features(target, head, head_pairs, longest, buckets, text=target_text, keep=[])
    gain = np.zeros(buckets, np.int64)
    for r in gains(totals(rows, buckets), totals(aims, buckets), buckets).collect():
        gain[r.bucket] = r.gain
    scored = weighed(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "resampling-scores")

    able = F.col("n_words") >= least_words
    # scores are whole numbers of a range that the buckets and the noise bound, so their table is small
    hist = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    down = W.orderBy(F.col("score").desc())
    draws = F.floor(F.sum("n").over(W.partitionBy()) * percent / 100)
    above = hist.select("score", draws.alias("k"), (F.sum("n").over(down) - F.col("n")).alias("above")).where("above < k")
    last = above.agg(F.min("score"), F.max("k")).first()
    if last[0] is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = able & (F.col("score") >= last[0])
    placed = numbered(scored.where(near), [F.col("score").desc(), F.col("doc_id").asc()], "_rank", "resampling-drawn")
    placed = placed.withColumn("rank", F.when(F.col("_rank") <= last[1], F.col("_rank"))).drop("_rank")
    return placed.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def drawn(df: DataFrame, target: DataFrame, *, key: str = "doc_id", **how) -> DataFrame:
    """The drawn rows of ``df`` with its columns: those whose key is drawn. Rows with one key are drawn together."""
    (name,) = fresh(df, "_drawn")
    keys = resample(df, target, key=key, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    return df.join(keys, F.col(f"`{key}`").eqNullSafe(F.col(name)), "left_semi")
