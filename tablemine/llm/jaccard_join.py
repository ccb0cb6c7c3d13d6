"""Exact Jaccard self-join of documents on word n-grams: rare-first prefixes, filters, one verification per pair."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemine.llm.common import BROADCAST_ROWS, fresh, written
from tablemine.llm.encoding import batches
from tablemine.llm.shingles import shingle_sets
from tablemine.operators.components import connected_components

#: Buckets of the frequency table, 4 bytes each: its size is the same for every corpus. Parts it is summed up in.
BUCKET_BITS, TABLE_PARTS = 22, 64
#: Rows and characters whose sets a worker builds at once.
BATCH_ROWS, BATCH_CHARS = 400, 1_500_000
#: Bins of a set's outline, which bounds how much two sets can share.
BINS = 64


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list]]:
    """(from, to, texts) of the batch a few at a time; memory that Arrow no longer uses goes back at once."""
    column = batch.column("text")
    for i in range(0, batch.num_rows, BATCH_ROWS):
        texts = column.slice(i, BATCH_ROWS).to_pylist()
        for a, b in batches(texts, BATCH_CHARS):
            yield i + a, i + b, texts[a:b]
        pa.default_memory_pool().release_unused()


def _name(s: np.ndarray) -> int:
    """64 bits that name a set."""
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def frequencies(rows: DataFrame, width: int) -> np.ndarray:
    """Documents per bucket of n-gram hashes, over all of ``rows(doc_id, text)``.

    Every task counts into the whole table and sends it in TABLE_PARTS compressed parts, which are summed in two rounds, so
    no task receives one part from each other task. What reaches the driver has a fixed size.
    """
    step = (1 << BUCKET_BITS) // TABLE_PARTS
    planes = lambda a: zlib.compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
    back = lambda z: np.ascontiguousarray(np.frombuffer(zlib.decompress(z), np.uint8).reshape(4, -1).T).view("<u4").ravel()

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(1 << BUCKET_BITS, np.uint32)
        for b in parts:
            for _, _, texts in _runs(b):
                sets = shingle_sets(texts, width)
                bucket, often = np.unique(_buckets(np.concatenate(sets)), return_counts=True)
                table[bucket] += often.astype(np.uint32)
        task = TaskContext.get().partitionId()
        out = [planes(table[k * step : (k + 1) * step]) for k in range(TABLE_PARTS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(TABLE_PARTS), pa.int32()), pa.array([task % 1024] * TABLE_PARTS, pa.int32()), pa.array(out, pa.binary())], ["part", "task", "counts"]
        )

    def total(group: pa.Table) -> pa.Table:
        table = np.zeros(step, np.uint64)
        for z in group.column("counts"):
            table += back(z.as_py())
        return pa.table({"part": group.column("part")[:1], "task": group.column("task")[:1], "counts": pa.array([planes(np.minimum(table, (1 << 32) - 1))], pa.binary())})

    schema = "part int, task int, counts binary"
    counted = rows.select("text").mapInArrow(count, schema)
    summed = counted.groupBy("part", "task").applyInArrow(total, schema).groupBy("part").applyInArrow(total, schema)
    found = {r.part: back(bytes(r.counts)) for r in summed.collect()}
    return np.concatenate([found.get(k, np.zeros(step, np.uint32)) for k in range(TABLE_PARTS)])


def prefixes(rows: DataFrame, width: int, threshold: Fraction, table: np.ndarray) -> DataFrame:
    """(doc_id, h, n, key, weight, prefix, outline) for each of ``rows(doc_id, h, text)``.

    The n-grams of a set are ordered by how often their bucket occurs, then by hash: one order for all documents. Two sets
    of likeness ``threshold`` must share one of their first n - ceil(threshold n) + 1. key names the set; weight is the mean
    frequency in the prefix; outline counts the set by BINS ranges of a second hash.
    """
    sent = rows.sparkSession.sparkContext.broadcast(table)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "h", "n", "key", "weight", "prefix", "outline"]

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for b in parts:
            for i, j, texts in _runs(b):
                out: list[list] = [[], [], [], [], []]
                for s in shingle_sets(texts, width):
                    n = len(s)
                    often = counts[_buckets(s)]
                    k = n - -(-n * threshold.numerator // threshold.denominator) + 1 if n else 0
                    first = np.lexsort((s, often))[:k]
                    bins = np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
                    for c, v in zip(out, (n, _name(s) if n else None, float(often[first].mean()) if n else 0.0, s[first].view(np.int64), bins.astype(np.int32))):
                        c.append(v)
                arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column(c).slice(i, j - i) for c in ("doc_id", "h")] + arrays, names)

    return rows.mapInArrow(each, f"doc_id {kind}, h long, n long, key long, weight double, prefix array<long>, outline array<int>")


def _ends(pairs: DataFrame) -> DataFrame:
    """(id): whatever stands in ``pairs(a, b)``."""
    return pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()


def _joined(links: DataFrame) -> DataFrame:
    """(id, cls): the smallest name within two links. Equal names are surely joined, which is all that a round needs: the
    members that a hub has found share one. Components proper are made once, at the end."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    near = both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("cls"))
    far = both.join(near.select(F.col("id").alias("other"), F.col("cls").alias("theirs")), "other")
    return written(far.groupBy("id").agg(F.least(F.min("theirs"), F.col("id")).alias("cls")), "jaccard-joined")


def _needed(n: Column, m: Column, t: Fraction) -> Column:
    """The least overlap of sets of sizes n and m at likeness t: ceil(t (n + m) / (1 + t)), in whole numbers."""
    p, q = t.numerator, t.denominator
    return F.ceil((n + m) * p / F.lit(float(p + q)) - 1e-9)


def _candidates(left: DataFrame, right: DataFrame, t: Fraction) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members of ``left`` and ``right`` that share an n-gram, differ in class, and pass the
    length filter and the positional filter: after a shared n-gram at places i and j, 1 + min(n - i, m - j) are left at most."""
    r = right.select("gram", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "at", "cls")])
    n, m = F.col("n"), F.col("n2")
    longest, shortest = F.greatest(n, m), F.least(n, m)
    fits = shortest * t.denominator >= longest * t.numerator
    room = 1 + F.least(n - F.col("at") - 1, m - F.col("at2") - 1)
    pairs = left.join(r, "gram").where((F.col("cls") != F.col("cls2")) & fits & (room >= _needed(n, m, t)))
    a, b = F.least("id", "id2"), F.greatest("id", "id2")
    return pairs.select(a.alias("a"), b.alias("b")).distinct()


def _verified(pairs: DataFrame, outlines: DataFrame, rows: DataFrame, first: DataFrame, width: int, t: Fraction) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are alike. Outlines drop most of the others; the rest is counted exactly.

    The sets are built anew from the texts of ``first(id, doc_id)``, one document for each set, and only where they are needed.
    """
    of = lambda x: outlines.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("outline").alias(f"o_{x}"))
    shared = F.aggregate(F.zip_with("o_a", "o_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    close = pairs.join(of("a"), "a").join(of("b"), "b").where(shared >= _needed(F.col("n_a"), F.col("n_b"), t))
    close = written(close.select("a", "b"), "jaccard-close")
    wanted = written(first.join(_ends(close), "id").select(F.col("doc_id").alias("wanted")).distinct(), "jaccard-wanted")
    if wanted.count() <= 10 * BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for _, _, texts in _runs(b):
                found = [s for s in shingle_sets(texts, width) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_name(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["id", "grams"]
                )

    full = texts.select("text").mapInArrow(sets, "id long, grams array<long>").dropDuplicates(["id"])
    both = close.join(full.select(F.col("id").alias("a"), F.col("grams").alias("g_a")), "a").join(full.select(F.col("id").alias("b"), F.col("grams").alias("g_b")), "b")
    common = F.size(F.array_intersect("g_a", "g_b"))
    union = F.size("g_a") + F.size("g_b") - common
    return both.where(common * t.denominator >= union * t.numerator).select("a", "b")


def links(df: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = 3, threshold: Fraction | str = Fraction(9, 10)) -> tuple[DataFrame, DataFrame]:
    """(documents, components): documents(doc_id, h, n, cls), components(cls, component).

    h is a hash of the text. Documents of equal sets are one class, named by the set. Classes are linked if |A & B| >= threshold x |A | B|, exactly.
    ``components`` has the classes with a link; a class that isn't there is alone.

    Classes that share a prefix n-gram are compared in rounds. In a round each n-gram has one hub, the member whose prefix is
    most common (of a text and its edited copies that is the text), compared with all members not yet joined to it; then
    members that found the same hub count as joined, and the next hub is drawn by hash. So thousands of near copies fall
    together after about as many comparisons as members. When few pairs are left, or a round didn't halve them, all remaining
    pairs of members not yet joined are compared: the result is whole, no bucket is capped, and no pair is compared twice.
    """
    t = Fraction(threshold)
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    table = frequencies(rows, width)
    docs = written(prefixes(rows, width, t, table), "jaccard-prefixes")
    unique = docs.where("n > 0").select(F.col("key").alias("id"), "n", "weight", "prefix", "outline").dropDuplicates(["id"])
    outlines = written(unique, "jaccard-classes")
    # most n-grams occur once: sizes and weights are joined to what is left of them
    spread = outlines.select("id", F.posexplode("prefix").alias("at", "gram"))
    shared = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram")
    members = written(spread.join(shared, "gram").join(outlines.select("id", "n", "weight"), "id"), "jaccard-members")
    first = written(docs.where("n > 0").groupBy(F.col("key").alias("id")).agg(F.min("doc_id").alias("doc_id")), "jaccard-first")
    found = tried = cls = None
    before, turn = float("inf"), 0
    while True:
        live = members.withColumn("cls", F.col("id")) if cls is None else members.join(cls, "id", "left").withColumn("cls", F.coalesce("cls", "id"))
        live = written(live, "jaccard-live")
        per = live.groupBy("gram", "cls").agg(F.count(F.lit(1)).alias("k")).groupBy("gram").agg(
            F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count(F.lit(1)).alias("classes"))
        open_ = per.where("classes > 1")
        left, size = open_.agg(F.sum((F.col("m") * F.col("m") - F.col("same")) / 2), F.sum("m")).first()
        if not left:
            break
        live = live.join(open_.select("gram"), "gram")
        everything = found is not None and (left <= 4 * size or 2 * left > before)
        before = left
        if everything:
            pairs = _candidates(live, live, t)
        else:
            rank = F.xxhash64("id", F.lit(turn)).cast("double") if turn else F.col("weight")
            hubs = live.groupBy("gram").agg(F.max(F.struct(rank, "id", "n", "at", "cls")).alias("h")).select("gram", "h.*")
            pairs = _candidates(hubs, live, t)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "jaccard-pairs")
        new = written(_verified(pairs, outlines, rows, first, width, t), "jaccard-links")
        found = new if found is None else found.unionAll(new)
        if everything:
            break
        cls = _joined(found)
        tried = pairs if tried is None else tried.unionAll(pairs)
        members, turn = live.drop("cls"), turn + 1
    if found is None:
        found = members.select(F.col("id").alias("a"), F.col("id").alias("b")).where(F.lit(False))
    components = connected_components(_ends(found), found)
    return docs.select("doc_id", "h", "n", F.col("key").alias("cls")), components.select(F.col("id").alias("cls"), "component")


def _grouped(df: DataFrame, **how) -> DataFrame:
    """(doc_id, h, n, component_id, first_h): the smallest key of each row's group, and the text hash of the row that bears it.

    NULL keys come after all others, equal keys by h. Rows without a set have neither.
    """
    docs, components = links(df, **how)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = docs.where("n > 0").groupBy("cls").agg(F.min(order).alias("first"))
    linked = first.join(components, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    # both sides are tables, so that a component with very many classes can be split
    linked = written(linked, "jaccard-named")
    least = written(linked.groupBy("component").agg(F.min("first").alias("least")), "jaccard-least")
    of_class = linked.join(least, "component").select("cls", F.col("least.doc_id").alias("component_id"), F.col("least.h").alias("first_h"))
    return docs.join(of_class, "cls", "left").select("doc_id", "h", "n", "component_id", "first_h")


def near_groups(df: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = 3, threshold: Fraction | str = Fraction(9, 10)) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: component_id is the smallest key reachable over links.

    Words are runs without ASCII blanks, A-Z lower-cased; a set is the distinct ``width``-word n-grams of a text, the whole
    text if it has fewer words; long texts are taken whole. Empty and NULL texts have no set and stay alone; repeated rows are
    in one group. A NULL key counts as larger than any other. Other columns are ignored.
    """
    out = _grouped(df, text=text, key=key, width=width, threshold=threshold)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, *, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The first row of each group of ``df`` with all its columns: the smallest key, NULL last, equal keys by a hash of the text.

    Rows are told apart by key and text, so a key may repeat or be NULL; of rows equal in both one stays, of texts
    without words each.
    """
    name, h, n = fresh(df, "_kept", "_hash", "_n")
    found = _grouped(df, text=text, key=key, **how)
    kept = found.where(F.col("first_h").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("first_h"))))
    kept = written(kept.groupBy(F.col("doc_id").alias(name), F.col("h").alias(h)).agg(F.count(F.lit(1)).alias(n)), "jaccard-kept")
    hashed = df.withColumn(f"{h}_", F.xxhash64(F.col(f"`{text}`")))
    out = hashed.join(kept.select(name, h), F.col(f"`{key}`").eqNullSafe(F.col(name)) & (F.col(f"{h}_") == F.col(h)), "left_semi")
    if not kept.where(F.col(n) > 1).isEmpty():
        out = out.dropDuplicates([key, f"{h}_"])
    return out.drop(f"{h}_")
