"""Language model: a probabilistic suffix tree over words, grown from the counts of all training texts.

Symbols are words and the end of a text. A context is the last one or two words (``depth``; a text begins after an end). It
is kept if the next words of its training places are likelier under it, each place left out in turn, than under the context
one word shorter: a divergence test that noise fails. Kept or not, nothing is collected: blocks of texts send the n-grams
they hold to the tasks that own these n-grams and get the totals back, so the tree lives nowhere as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemine.llm.common import written
from tablemine.llm.shingles import ODD, stirred, word_hashes, words_in

#: Characters in a block, the unit that asks for totals; a longer text is a block of its own.
BLOCK_CHARS = 8_000_000
#: Bits of a word's key; how many more bits than the corpus has words the keys of longer n-grams have, so that at any size
#: one n-gram in 16,384 at most shares its key with another; and their least bits.
KEY_BITS, SPARE_BITS, LEAST_BITS = 48, 14, 48
#: Weight of the shorter context's distribution, in words, for contexts of 1, 2, ... words.
WEIGHTS = (500.0, 2.0, 2.0, 2.0)
#: Training places below which a context isn't looked at, and what its divergence (in nats, over all places) must exceed.
LEAST_COUNT, LEAST_GAIN = 2, 1.0

_END = np.uint64(0x5851F42D4C957F2D)


# --- packed arrays ----------------------------------------------------------------------------------------------------


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(values: np.ndarray) -> bytes:
    """First bytes of all values, second bytes, and so on: high bytes are alike and take little room once compressed."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first and the steps to the next ones."""
    return _packed(_planes(np.r_[keys[:1], np.diff(keys)].astype("<u8")))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(_unpacked(data), "<u8"), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts as bytes; those from 255 on follow in full."""
    return _packed(np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes())


def unpack_counts(data: bytes, size: int) -> np.ndarray:
    data = _unpacked(data)
    n = np.frombuffer(data, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<i8", offset=size)
    return n


def pack_gains(gain: np.ndarray) -> bytes:
    """Four bytes each, 24 bits of precision."""
    return _packed(_planes(np.asarray(gain).astype("<f4")))


def unpack_gains(data: bytes) -> np.ndarray:
    return _from_planes(_unpacked(data), "<f4").astype(float)


# --- one block --------------------------------------------------------------------------------------------------------


class Block:
    """The words of a block's texts as a stream with ends, and the keys of its n-grams."""

    def __init__(self, words: bytes, stream: bytes, lengths: bytes, held: bytes, depth: int, bits: int):
        self.depth, self.bits = depth, bits
        hashes = np.append(np.frombuffer(words, "<u8"), _END)
        self.symbols = hashes[_from_planes(_unpacked(stream), "<i4")]
        self.lengths = np.frombuffer(lengths, "<i4").astype(np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.held = np.frombuffer(held, np.uint8).astype(bool)
        self.train = ~np.repeat(self.held, self.lengths)
        self.place = np.arange(len(self.symbols)) - np.repeat(self.begin, self.lengths)

    def orders(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(order, keys, valid) for 1 to depth + 1: the n-gram that ends at each place, the end before a text included."""
        g = self.symbols
        valid = np.ones(len(g), bool)
        yield 1, g >> np.uint64(64 - KEY_BITS), valid
        for n in range(2, self.depth + 2):
            before = np.r_[_END, g[:-1]] if len(g) else g
            if n == 2:
                before = np.where(self.place == 0, _END, before)
            g = stirred(before * ODD[1] + self.symbols * ODD[0] + np.uint64(n))
            valid = self.place >= n - 2
            yield n, g >> np.uint64(64 - self.bits), valid

    def asked(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(order, distinct keys in order, how often each occurs in training texts)."""
        for n, keys, valid in self.orders():
            yield n, *_tally(keys[valid], self.train[valid])

    def evidence(self, totals: dict[int, np.ndarray], n_all: int, n_distinct: int) -> dict:
        """Probabilities of every place under the contexts of each length, and the same with the place itself left out.

        ``totals``: for each order, the training counts of the block's distinct keys.
        """
        own = self.train
        out: dict = {"levels": []}
        end = -1
        for n, keys, valid in self.orders():
            distinct, where = np.unique(keys[valid], return_inverse=True)
            c = np.zeros(len(keys))
            c[valid] = totals[n][where]
            at = np.full(len(keys), -1, np.int32)
            at[valid] = where
            del where
            if n == 1:
                end = int(np.searchsorted(distinct, _END >> np.uint64(64 - KEY_BITS)))
                out |= {"base": (c + 1) / (n_all + n_distinct + 1), "known": c > 0}
                shorter, shorter_less = out["base"], np.where(own, np.maximum(c, 1) / (n_all + n_distinct), out["base"])
            else:
                # the context of a place is the n-gram, one word shorter, that ends at the place before
                seen, context = np.r_[0.0, before[:-1]], np.r_[np.int32(-1), before_at[:-1]]
                if n == 2:
                    first = self.place == 0
                    seen[first], context[first] = totals[1][end], end
                k = WEIGHTS[n - 2]
                p = (c + k * shorter) / (seen + k)
                less = np.where(own, (np.maximum(c, 1) - 1 + k * shorter_less) / (np.maximum(seen, 1) - 1 + k), p)
                gain = np.where(own, np.log(less / shorter_less), 0.0).astype(np.float32)
                out["levels"].append((p, valid & (seen >= LEAST_COUNT), context, before_keys, gain))
                shorter, shorter_less = np.where(valid, p, shorter), np.where(valid, less, shorter_less)
            before, before_at, before_keys = c, at, distinct
        return out


def _tally(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.sort((keys << np.uint64(1)) | train.astype(np.uint64))
    k = both >> np.uint64(1)
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[start], np.add.reduceat((both & np.uint64(1)).astype(np.int64), start) if len(k) else np.empty(0, np.int64)


def _cut(keys: np.ndarray, part_bits: int, bits: int) -> np.ndarray:
    """Where each part's keys begin and end in sorted ``keys`` of ``bits`` bits."""
    edges = np.arange((1 << part_bits) + 1, dtype=np.uint64) << np.uint64(bits - part_bits)
    return np.searchsorted(keys, edges)


def _contexts(level: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(keys, gains) of the contexts of one length that the block asks about, in order of key."""
    _, usable, context, keys, gain = level
    size = len(keys)
    used = np.bincount(context[usable], minlength=size) > 0
    return keys[used], np.bincount(context[usable], gain[usable], size)[used]


# --- tables -----------------------------------------------------------------------------------------------------------


def blocks(df: DataFrame, held: Column, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per block of texts: keys and parts of its documents, its distinct words as hashes, its words as numbers."""
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        ids, texts, out, size, kind_of = [], [], [], 0, None

        def block() -> pa.RecordBatch:
            index, words, begin = words_in(texts)
            n = np.diff(begin)
            stream = np.full(len(index) + len(n), len(words), "<i4")
            stream[np.arange(len(index)) + np.repeat(np.arange(len(n)), n)] = index
            data = [word_hashes(words).astype("<u8").tobytes(), _packed(_planes(stream)), (n + 1).astype("<i4").tobytes(), np.array(out, np.uint8).tobytes()]
            columns = [pa.array([task << 32 | number], pa.int64()), pa.array([ids], pa.list_(kind_of)), *[pa.array([x], pa.binary()) for x in data]]
            columns.append(pa.array([len(stream)], pa.int64()))
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "words", "stream", "lengths", "held", "size"])

        for b in parts:
            kind_of = b.schema.field("doc_id").type
            for i, t, h in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("held").to_pylist()):
                ids.append(i)
                texts.append(t)
                out.append(h)
                size += len(t or "") + 1
                if size >= BLOCK_CHARS:
                    yield block()
                    ids, texts, out, size, number = [], [], [], 0, number + 1
        if ids:
            yield block()

    return rows.mapInArrow(each, f"block long, ids array<{kind}>, words binary, stream binary, lengths binary, held binary, size long")


def _opened(table: pa.Table | pa.RecordBatch, row: int, depth: int, bits: int) -> Block:
    return Block(*[table.column(c)[row].as_py() for c in ("words", "stream", "lengths", "held")], depth, bits)


_ANSWER = "block long, kind int, part int, data binary, n long, v long"


def _answers(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["block", "kind", "part", "data", "n", "v"])


def counted(held: DataFrame, depth: int, part_bits: int, bits: int) -> DataFrame:
    """Answers to every block: training counts of its n-grams, kind = order, n of them. The rows of block -1 hold the number of
    all (n) and of distinct (v) training words."""

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in range(b.num_rows):
                name = b.column("block")[r].as_py()
                for order, keys, n in _opened(b, r, depth, bits).asked():
                    at = _cut(keys, part_bits, KEY_BITS if order == 1 else bits)
                    rows = [(name, order, p, pack_keys(keys[i:j]), pack_counts(n[i:j])) for p, (i, j) in enumerate(zip(at[:-1], at[1:])) if j > i]
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], ["block", "kind", "part", "keys", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        out = []
        kinds = np.asarray(group.column("kind"))
        for order in np.unique(kinds).tolist():
            rows = np.flatnonzero(kinds == order)
            keys = [unpack_keys(group.column("keys")[int(r)].as_py()) for r in rows]
            counts = [unpack_counts(group.column("counts")[int(r)].as_py(), len(k)) for r, k in zip(rows, keys)]
            distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.int64)
            ends = np.cumsum([len(k) for k in keys])
            for r, i, j in zip(rows.tolist(), ends - [len(k) for k in keys], ends):
                out.append((group.column("block")[r].as_py(), order, group.column("part")[r].as_py(), pack_counts(total[where[i:j]]), int(j - i), 0))
            if order == 1:
                out.append((-1, 0, 0, b"", int(total.sum()), int((total > 0).sum())))
        return _answers(out)

    asked = held.mapInArrow(ask, "block long, kind int, part int, keys binary, counts binary")
    return asked.groupBy("part", "kind").applyInArrow(answer, _ANSWER)


def _totals(answers: pa.Table, order: int) -> np.ndarray:
    """The counts of one order, parts in order: those of the block's distinct keys."""
    rows = np.flatnonzero(np.asarray(answers.column("kind")) == order)
    rows = rows[np.argsort(np.asarray(answers.column("part"))[rows])]
    out = []
    for r in rows.tolist():
        data, size = answers.column("data")[r].as_py(), answers.column("n")[r].as_py()
        out.append(unpack_counts(data, size))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def score(df: DataFrame, held: Column, *, text: str = "text", key: str = "doc_id", depth: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``df``; scores are log10.

    The model learns from the rows where ``held`` is false or NULL. The base gives a word (c + 1) / (N + V + 1); each context
    mixes its own counts with the distribution of the shorter one, and a place is scored by its longest kept context. NULL
    and empty texts are the end alone; repeated rows count as often as they occur; other columns are ignored.
    """
    texts = written(blocks(df, held, text=text, key=key), "lm-blocks", compression="zstd")
    number, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    part_bits = max(3, int(number).bit_length())
    bits = min(64, max(LEAST_BITS, int(size).bit_length() + SPARE_BITS))
    found = written(counted(texts, depth, part_bits, bits), "lm-counts", compression="zstd")
    n_all, n_distinct = found.where("block < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    found = found.where("block >= 0")
    kind = texts.schema["ids"].dataType.elementType.simpleString()

    def seen(left: pa.Table, right: pa.Table) -> tuple[Block, dict]:
        block = _opened(left, 0, depth, bits)
        return block, block.evidence({n: _totals(right, n) for n in range(1, depth + 2)}, n_all, n_distinct)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        name, out = left.column("block")[0].as_py(), []
        for level, x in enumerate(seen(left, right)[1]["levels"], 1):
            keys, gains = _contexts(x)
            at = _cut(keys, part_bits, KEY_BITS if level == 1 else bits)
            out += [(name, level, p, pack_keys(keys[i:j]), pack_gains(gains[i:j])) for p, (i, j) in enumerate(zip(at[:-1], at[1:])) if j > i]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["block", "kind", "part", "keys", "gains"])

    def decide(group: pa.Table) -> pa.Table:
        keys = [unpack_keys(x.as_py()) for x in group.column("keys")]
        gains = np.concatenate([unpack_gains(x.as_py()) for x in group.column("gains")])
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        kept = np.bincount(where, gains, len(distinct)) > LEAST_GAIN
        ends = np.cumsum([len(k) for k in keys])
        level = group.column("kind")[0].as_py()
        return _answers([
            (group.column("block")[r].as_py(), 100 + level, group.column("part")[r].as_py(), np.packbits(kept[where[j - len(keys[r]) : j]]).tobytes(), len(keys[r]), 0)
            for r, j in enumerate(ends)
        ])

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        block, found = seen(left, right)
        p = found["base"]
        kinds, parts = np.asarray(right.column("kind")), np.asarray(right.column("part"))
        for level, x in enumerate(found["levels"], 1):
            keys, _ = _contexts(x)
            rows = np.flatnonzero(kinds == 100 + level)
            rows = rows[np.argsort(parts[rows])].tolist()
            bits = [np.unpackbits(np.frombuffer(right.column("data")[r].as_py(), np.uint8), count=right.column("n")[r].as_py()) for r in rows]
            kept = np.zeros(len(x[3]) + 1, bool)
            kept[np.searchsorted(x[3], keys)] = np.concatenate(bits) if bits else []
            p = np.where(x[1] & kept[x[2]], x[0], p)
        sums = lambda v: np.add.reduceat(v, block.begin)
        return pa.table({
            "doc_id": left.column("ids")[0].values, "held_out": block.held, "n_tokens": block.lengths, "n_known": sums(found["known"].astype(np.int64)),
            "base_score": sums(np.log10(found["base"])), "score": sums(np.log10(p)),
        })

    by_block = texts.groupBy("block")
    asked = by_block.cogroup(found.groupBy("block")).applyInArrow(ask, "block long, kind int, part int, keys binary, gains binary")
    kept = asked.groupBy("part", "kind").applyInArrow(decide, _ANSWER)
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = by_block.cogroup(found.unionByName(kept).groupBy("block")).applyInArrow(final, result)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")
