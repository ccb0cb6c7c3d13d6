"""Pack token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.llm.encoding import batches, pieces_of

#: Documents in a group on average; a group is packed in one task.
GROUP_DOCS = 2048


class Bins:
    """Bins of equal capacity, opened when needed; a tournament tree holds the most room below every node."""

    def __init__(self, capacity: int, most: int):
        self.capacity = capacity
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)
        self.used = 0

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, which then has that much less."""
        node, room = 1, self.room
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        found = node - self.leaves
        self.used = max(self.used, found + 1)
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> tuple[list[int], int]:
    """(bin of each size, bins used); equal sizes in the order given. Sizes are 1 to ``capacity``."""
    bins = Bins(capacity, len(sizes))
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.place(sizes[i])
    return out, bins.used


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones and the rest."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


def pack(df: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", end: int = 2, capacity: int = 4096, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): every piece and its place in a sequence.

    Documents go to groups by a hash of key and text: a group is a random sample of the table, so each packs as well as any
    other and they need nothing from each other. Encoded documents are cut every ``capacity`` ids; full pieces are a
    sequence of their own, the rest is packed largest first. Sequences are numbered group x 2^32 + bin, and pieces lie in
    them without gaps from 0. ids are unsigned 32-bit numbers, little-endian, the end id last. NULL and empty texts are the
    end id alone; repeated rows are packed as often as they occur; an empty table gives no piece. Other columns are ignored.
    """
    groups = max(1, -(-df.count() // group_docs))
    t, k = F.col(f"`{text}`"), F.col(f"`{key}`")
    rows = df.select(k.alias("doc_id"), t.alias("text"), F.pmod(F.xxhash64(k, t), F.lit(groups)).alias("g"))

    def one(group: pa.Table) -> pa.Table:
        encoder, tail = pieces_of(tokenizer), np.array([end], "<u4").tobytes()
        g, texts = group.column("g")[0].as_py(), group.column("text").to_pylist()
        whole = [x + tail for i, j in batches(texts) for x in encoder.encode(texts[i:j])]
        row, start, length = (np.array(c, np.int64) for c in zip(*[(r, s, n) for r, x in enumerate(whole) for s, n in cuts(len(x) // 4, capacity)]))
        rest = np.flatnonzero(length < capacity)
        full = np.flatnonzero(length == capacity)
        bins, used = first_fit_decreasing(length[rest].tolist(), capacity)
        sequence = np.empty(len(row), np.int64)
        sequence[rest], sequence[full] = bins, used + np.arange(len(full))
        order = np.argsort(sequence, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        opens = np.r_[True, np.diff(sequence[order]) > 0]
        offset = np.empty(len(row), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(opens, before, 0))
        ids = [whole[r][4 * s : 4 * (s + n)] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())]
        tokens = np.array([len(x) // 4 for x in whole], np.int64)
        return pa.table({
            "doc_id": group.column("doc_id").take(pa.array(row)), "start": start, "length": length, "ids": pa.array(ids, pa.binary()),
            "doc_tokens": tokens[row], "sequence_id": (g << 32) + sequence, "offset": offset,
        })

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.groupBy("g").applyInArrow(one, schema)
