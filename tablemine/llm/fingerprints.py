"""Document fingerprints by consistent weighted sampling of words: equal places are as frequent as generalised Jaccard says."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablemine.llm.common import written
from tablemine.llm.shingles import ODD, stirred, word_hashes, words_in

#: Samples in a fingerprint: an estimate of likeness J is off by sqrt(J (1 - J) / SAMPLES) on average.
SAMPLES = 128
#: Characters handled at once in a worker; the tables of random numbers cover the distinct words of that much text.
BATCH_CHARS = 1_000_000
#: Words whose random numbers are made at once.
BLOCK_WORDS = 128


def draws(words: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, beta, ln c) for each word hash and sample: r and c from Gamma(2, 1), beta uniform; a function of the word alone.

    Blocks of words whose numbers stay in the processor's cache: several times as fast as all words at once.
    """
    lane = stirred(np.arange(1, samples + 1, dtype=np.uint64) * ODD[1])
    low, high, unit, half = np.uint64(0xFFFFFFFF), np.uint64(32), np.float32(2.0**-32), np.float32(0.5)
    r, beta, ln_c = (np.empty((len(words), samples), np.float32) for _ in range(3))
    most = np.float32(1 - 2.0**-24)
    for i in range(0, len(words), BLOCK_WORDS):
        base = words[i : i + BLOCK_WORDS, None] ^ lane

        def pair(k: int, base: np.ndarray = base) -> tuple[np.ndarray, np.ndarray]:
            u = stirred(base + np.uint64(k * int(ODD[0]) % (1 << 64)))
            return ((u >> high).astype(np.float32) + half) * unit, ((u & low).astype(np.float32) + half) * unit

        (a, b), (c, d) = pair(1), pair(2)
        at = slice(i, i + BLOCK_WORDS)
        np.log(a * b, out=r[at])
        np.negative(r[at], out=r[at])
        np.minimum(((stirred(base + np.uint64(3 * int(ODD[0]) % (1 << 64))) >> high).astype(np.float32) + half) * unit, most, out=beta[at])
        np.log(-np.log(c * d), out=ln_c[at])
    return r, beta, ln_c


def signatures(texts: Sequence[str | None], samples: int = SAMPLES) -> list[np.ndarray]:
    """16 bits per sample for each text; a text without words has none.

    A word found S times is hit at t = floor(ln S / r + beta), ln a = ln c - r (t - beta) - r; the word with the least a is
    the sample, together with t. For S = 1 that is t = 0, so those words need no more than a look in the table.
    """
    index, words, begin = words_in(texts)
    h = word_hashes(words)
    r, beta, ln_c = draws(h, samples)
    once = ln_c + r * (beta - 1)
    lane = np.arange(samples)
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if a == b:
            out.append(np.empty(0, np.uint16))
            continue
        w, n = np.unique(index[a:b], return_counts=True)
        many = n > 1
        best, word, t = np.full(samples, np.inf, np.float32), np.zeros(samples, np.int64), np.zeros(samples, np.int64)
        if not many.all():
            v = w[~many]
            x = once[v]
            at = x.argmin(0)
            best, word = x[at, lane], v[at]
        if many.any():
            v = w[many]
            place = np.floor(np.log(n[many]).astype(np.float32)[:, None] / r[v] + beta[v])
            x = ln_c[v] - r[v] * (place - beta[v] + 1)
            at = x.argmin(0)
            less = x[at, lane] < best
            word, t = np.where(less, v[at], word), np.where(less, place[at, lane].astype(np.int64), t)
        out.append((stirred(h[word] + stirred(t.astype(np.uint64) * ODD[1])) >> np.uint64(48)).astype(np.uint16))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places; texts without words are like each other and nothing else."""
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def spelled(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def fingerprint(df: DataFrame, *, text: str = "text", key: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``df``: hexadecimal, equal for equal texts, empty without words."""
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = b.column("text").to_pylist()
            for i, j in _runs(texts):
                out = [spelled(s) for s in signatures(texts[i:j], samples)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def similar(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints as :func:`fingerprint` writes them."""
    places = F.sequence(F.lit(0), F.greatest(F.length(a).cast("int") / 4 - 1, F.lit(0)).cast("int"))
    equal = F.size(F.filter(places, lambda i: F.substr(a, i * 4 + 1, F.lit(4)) == F.substr(b, i * 4 + 1, F.lit(4))))
    return F.when(F.length(a) != F.length(b), 0.0).when(F.length(a) == 0, 1.0).otherwise(equal / (F.length(a) / 4))


def _runs(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    from tablemine.llm.encoding import batches

    return batches(texts, BATCH_CHARS)


def chained(df: DataFrame, *, text: str = "text", key: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``df``.

    The next document is the one that follows by key, equal keys by a hash of the text, after the last the first; a single
    document follows itself. Rows are dealt out by ranges of the key and sorted within each; a task compares neighbours as they
    come and hands on its first and last row, so one row per range is joined to the next range's first. NULL texts are
    empty; NULL keys come first; other columns are ignored.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("h"))
    dealt = rows.repartitionByRange(max(1, df.rdd.getNumPartitions()), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    kind = rows.schema["doc_id"].dataType.simpleString()
    result = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def compared(texts: list[str], following: list[str]) -> tuple[list[tuple], list[np.ndarray]]:
        changed = [edited(a, b) for a, b in zip(texts, following)]
        found = signatures([*texts, *changed, *following[-1:]], samples)
        own, after, last = found[: len(texts)], found[len(texts) : 2 * len(texts)], found[2 * len(texts) :]
        return [
            (len(x), hashlib.sha256(y.encode()).digest(), f.astype(">u2").tobytes(), e.astype(">u2").tobytes(), likeness(f, e), likeness(f, g))
            for x, y, f, e, g in zip(texts, changed, own, after, [*own[1:], *last])
        ], own

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, key_type = TaskContext.get().partitionId(), None
        names = ["doc_id", *result, "edge", "place", "first", "last"]

        def batch(keys: list, rows: list[tuple], edge: int, first: str | None = None, last: str | None = None) -> pa.RecordBatch:
            n = len(keys)
            columns = [pa.array([r[k] for r in rows], types[k]) for k in range(len(result))]
            return pa.RecordBatch.from_arrays([
                pa.array(keys, key_type), *columns, pa.array([edge] * n, pa.int32()), pa.array([place] * n, pa.int32()),
                pa.array([first] * n, pa.string()), pa.array([last] * n, pa.string()),
            ], names)

        keys: list = []
        texts: list[str] = []
        first, size = None, 0
        for b in parts:
            key_type = b.schema.field("doc_id").type
            for k, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                first = x if first is None else first
                keys.append(k)
                texts.append(x)
                size += len(x)
                if size >= BATCH_CHARS and len(texts) > 1:
                    yield batch(keys[:-1], compared(texts[:-1], texts[1:])[0], 0)
                    keys, texts, size = keys[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield batch(keys[:-1], compared(texts[:-1], texts[1:])[0], 0)
        if texts:
            yield batch(keys[-1:], [(None,) * len(result)], 1, first, texts[-1])

    # bytes until the end: what is written on the way is half as large
    out = f"doc_id {kind}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    done = written(dealt.mapInArrow(each, f"{out}, edge int, place int, first string, last string"), "fingerprints")
    edges = done.where("edge = 1")
    after = edges.select("place", F.coalesce(F.lead("place").over(W.orderBy("place")), F.min("place").over(W.partitionBy())).alias("next"))
    heads = edges.select(F.col("place").alias("next"), F.col("first").alias("following"))
    open_ = edges.select("doc_id", "place", F.col("last").alias("text")).join(after, "place").join(heads, "next").select("doc_id", "text", "following")

    def close(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for k in range(b.num_rows):
                (row,), _ = compared([b.column("text")[k].as_py()], [b.column("following")[k].as_py()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(k, 1), *[pa.array([v], y) for v, y in zip(row, types)]], ["doc_id", *result])

    whole = done.where("edge = 0").select("doc_id", *result).unionByName(open_.mapInArrow(close, out))
    return whole.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
