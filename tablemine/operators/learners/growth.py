"""Decision trees grown from histograms, one pass over the table per level for all trees at once.

The table is written once as bins, one byte per attribute. Nodes of many rows wait in a queue: a pass sends every row down all
trees and counts (node, attribute, bin) histograms, which Spark adds up and turns into the best cut of each attribute. Nodes
of at most DEAL_ROWS rows are dealt to tasks, which finish whole subtrees. Both ways choose the same cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.session import scratch_path, spread

#: Most bins of an attribute; cuts lie half way between neighbouring quantiles.
BINS = 255
#: Rows of a node, copies by resampling included, up to which one task finishes its subtree.
DEAL_ROWS = 200_000
#: Bytes of histograms that a task counts in one pass; more open nodes are more passes.
HISTOGRAM_BYTES = 64 << 20

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Rule:
    """When a node is split and how. ``classes`` is 0 for numbers; ``features`` of all ``width`` are tried per node."""

    classes: int
    width: int
    features: int
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1

    @property
    def stats(self) -> int:
        """Numbers kept per node: class weights and rows, or the weighted sums of y, 1 and y squared, and rows."""
        return self.classes + 1 if self.classes else 4

    def merit(self, s: np.ndarray) -> np.ndarray:
        """What a split makes as large as it can: sums of squares over weight (Gini, variance)."""
        if self.classes:
            w = s[..., :-1]
            total, squares = w.sum(-1), (w * w).sum(-1)
        else:
            total, squares = s[..., 1], s[..., 0] * s[..., 0]
        return np.divide(squares, total, out=np.zeros_like(total), where=total > 0)

    def scores(self, left: np.ndarray, total: np.ndarray) -> np.ndarray:
        right = total - left
        ok = (left[..., -1] >= self.min_leaf) & (right[..., -1] >= self.min_leaf)
        return np.where(ok, self.merit(left) + self.merit(right), -np.inf)

    def open(self, total: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Whether nodes may be split: enough rows, not too deep, not of one class or value."""
        if self.classes:
            pure = total[:, :-1].max(1) >= total[:, :-1].sum(1)
        else:
            pure = total[:, 2] - self.merit(total) <= 1e-12 * total[:, 2]
        deep = depth >= self.max_depth if self.max_depth is not None else np.zeros(len(depth), bool)
        return (total[:, -1] >= self.min_split) & ~pure & ~deep

    def better(self, score: np.ndarray, total: np.ndarray) -> np.ndarray:
        base = self.merit(total)
        return score > base + 1e-10 * np.maximum(base, 1e-300)

    def chosen(self, hashes: np.ndarray) -> np.ndarray:
        """(nodes, attributes): those tried first, a function of the node's place in its tree alone."""
        if self.features >= self.width:
            return np.ones((len(hashes), self.width), bool)
        lane = _mixed(np.arange(1, self.width + 1, dtype=np.uint64) * _ODD[1])
        return _mixed(hashes[:, None] ^ lane).argsort(1, kind="stable").argsort(1) < self.features


def root_hash(seed: int, tree: int) -> np.uint64:
    return _mixed(np.array([seed % (1 << 32) * 1_000_003 + tree + 1], np.uint64))[0]


def child_hashes(h: np.ndarray) -> np.ndarray:
    """Left and right children of each node, one after the other."""
    both = np.stack([h + _ODD[0], h + _ODD[1]], 1)
    return _mixed(both).ravel()


@dataclass
class Tree:
    """Nodes by number, 0 the root: attribute (-1 in a leaf), last bin that goes left, left child (right is the next), stats."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    stats: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int32)
        rows = np.arange(len(bins))
        while len(rows):
            f = self.feature[at[rows]]
            inner = f >= 0
            rows, f = rows[inner], f[inner]
            here = at[rows]
            at[rows] = self.left[here] + (bins[rows, f] > self.bin[here])
        return at


class Paths:
    """Leaves of a tree of few inner nodes, for many rows: each attribute's bin stands for the outcomes of the nodes that ask it, and
    the outcomes of all together for the leaf. :meth:`Tree.leaf_of` for others."""

    MOST = 8

    def __init__(self, tree: Tree):
        inner = np.flatnonzero(tree.feature >= 0)
        self.tree, self.few = tree, len(inner) <= self.MOST
        if not self.few:
            return
        self.parts = []
        for f in np.unique(tree.feature[inner]):
            right = np.zeros(256, np.uint8)
            for bit, n in enumerate(inner):
                if tree.feature[n] == f:
                    right |= np.where(np.arange(256) > tree.bin[n], 1 << bit, 0).astype(np.uint8)
            self.parts.append((int(f), right))
        place = np.full(len(tree.feature), -1)
        place[inner] = np.arange(len(inner))
        self.leaf = np.zeros(1 << len(inner), np.int64)
        for code in range(len(self.leaf)):
            n = 0
            while tree.feature[n] >= 0:
                n = tree.left[n] + (code >> place[n] & 1)
            self.leaf[code] = n

    def values(self, bins: np.ndarray, value: np.ndarray) -> np.ndarray:
        """``value`` of the leaf that each row of ``bins`` reaches."""
        if not self.few:
            return value[self.tree.leaf_of(bins)]
        code = np.zeros(len(bins), np.uint8)
        for f, right in self.parts:
            code |= right[bins[:, f]]
        return value[self.leaf][code]


def stats_of(label: np.ndarray, weight: np.ndarray, times: np.ndarray, rule: Rule) -> np.ndarray:
    """Rows as node statistics. ``times`` is how often resampling took a row."""
    w = weight * times
    if not rule.classes:
        return np.stack([w * label, w, w * label * label, times], 1)
    out = np.zeros((len(label), rule.classes + 1))
    out[np.arange(len(label)), label.astype(np.int64)] = w
    out[:, -1] = times
    return out


def _best_cuts(bins: np.ndarray, stats: np.ndarray, slot: np.ndarray, total: np.ndarray, tried: np.ndarray, rule: Rule):
    """(score, attribute, bin) of the best cut of each slot among its attributes in ``tried``; first attribute, first bin on ties."""
    k, every = len(total), np.arange(len(total))
    best, feature, cut = np.full(k, -np.inf), np.full(k, -1, np.int32), np.zeros(k, np.int32)
    for j in range(rule.width):
        want = tried[:, j]
        take = np.flatnonzero(want[slot])
        if not len(take):
            continue
        s = slot[take]
        key = s * BINS + bins[take, j]
        if k * BINS <= 4 * len(take) + 4096:
            flat = np.stack([np.bincount(key, stats[take, c], k * BINS) for c in range(rule.stats)], 1)
            score = rule.scores(np.cumsum(flat.reshape(k, BINS, -1), 1)[:, :-1], total[:, None])
            at = score.argmax(1)
            value, place = score[every, at], at
        else:
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            ends = np.flatnonzero(np.r_[sorted_[1:] != sorted_[:-1], True])
            upto = np.cumsum(stats[take[order]], 0)[ends]
            group = sorted_[ends]
            of = group // BINS
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            before = np.where((first > 0)[:, None], upto[np.maximum(first - 1, 0)], 0.0)
            n = np.diff(np.r_[first, len(of)])
            score = rule.scores(upto - np.repeat(before, n, 0), total[of])
            top = np.maximum.reduceat(score, first)
            at = np.minimum.reduceat(np.where(score == np.repeat(top, n), np.arange(len(of)), len(of)), first)
            value, place = np.full(k, -np.inf), np.zeros(k, np.int64)
            value[of[first]], place[of[first]] = top, group[at] % BINS
        better = want & (value > best)
        best[better], feature[better], cut[better] = value[better], j, place[better]
    return best, feature, cut


def grow_rows(bins: np.ndarray, stats: np.ndarray, root: np.ndarray, hashes: np.ndarray, depths: np.ndarray, rule: Rule) -> list[Tree]:
    """The subtrees of several nodes from their rows, level by level for all of them; ``root`` is each row's node."""
    made = {k: [] for k in ("feature", "bin", "left", "stats", "root")}
    slot, of, base, roots = root.astype(np.int64), np.arange(len(hashes)), 0, len(hashes)
    while len(hashes):
        k = len(hashes)
        total = np.stack([np.bincount(slot, stats[:, c], k) for c in range(rule.stats)], 1)
        able = rule.open(total, depths)
        tried = rule.chosen(hashes) & able[:, None]
        score, feature, cut = _best_cuts(bins, stats, slot, total, tried, rule)
        split = able & rule.better(score, total)
        more = able & ~split
        if more.any() and rule.features < rule.width:  # no cut among the first attributes: look at the others
            score2, feature2, cut2 = _best_cuts(bins, stats, slot, total, ~tried & more[:, None], rule)
            again = more & rule.better(score2, total)
            feature[again], cut[again] = feature2[again], cut2[again]
            split |= again
        number = np.cumsum(split) - 1
        for name, v in (("feature", np.where(split, feature, -1)), ("bin", np.where(split, cut, 0)), ("left", np.where(split, base + k + 2 * number, -1)), ("stats", total), ("root", of)):
            made[name].append(v)
        base += k
        stay = split[slot]
        bins, stats, slot = bins[stay], stats[stay], slot[stay]
        slot = 2 * number[slot] + (bins[np.arange(len(slot)), feature[slot]] > cut[slot])
        hashes, depths, of = child_hashes(hashes[split]), np.repeat(depths[split] + 1, 2), np.repeat(of[split], 2)
    feature, cut, left, total, of = (np.concatenate(made[n]) for n in ("feature", "bin", "left", "stats", "root"))
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(roots + 1))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - begin[of[order]]
    out = []
    for a, b in zip(begin[:-1], begin[1:]):
        at = order[a:b]
        child = np.where(left[at] >= 0, place[left[at]], -1)
        out.append(Tree(feature[at].astype(np.int32), cut[at].astype(np.int32), child.astype(np.int32), total[at]))
    return out


# --- the table --------------------------------------------------------------------------------------------------------


@dataclass
class Binned:
    """The written table (id, label, weight, bins), the cuts of each attribute, its rows."""

    table: DataFrame
    cuts: list[np.ndarray]
    rows: int
    #: Whether ``id`` is the number of equal rows that a row stands for.
    counted: bool = False

    def combined(self) -> Binned:
        """Rows of equal bins, label and weight as one, for trees that do not resample."""
        alike = self.table.groupBy("label", "weight", "bins").agg(F.count(F.lit(1)).alias("id")).select("id", "label", "weight", "bins")
        path = scratch_path(self.table.sparkSession, "tree-counts")
        spread(alike).write.parquet(path)
        return Binned(self.table.sparkSession.read.schema(self.table.schema).parquet(path), self.cuts, self.rows, True)


def cut_points(df: DataFrame, width: int) -> list[np.ndarray]:
    """Cuts of each entry of ``features``: half way between neighbouring values among BINS approximate quantiles."""
    probs = F.lit([k / (BINS - 1) for k in range(BINS)])
    row = df.agg(*[F.percentile_approx(F.get("features", F.lit(j)), probs, 20 * BINS).alias(f"q{j}") for j in range(width)]).first() if width else []
    values = [np.unique(np.array(q or [0.0])) for q in row]
    return [v[:-1] + (v[1:] - v[:-1]) / 2 for v in values]


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of rows of attribute values: how many cuts lie below."""
    return np.stack([np.searchsorted(c, values[:, j], side="left") for j, c in enumerate(cuts)], 1).astype(np.uint8) if cuts else np.empty((len(values), 0), np.uint8)


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, w = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * w
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    start, end = column.offset, column.offset + len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[start : end + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]].reshape(-1, width)


def to_bins(df: DataFrame, width: int) -> Binned:
    """Write ``df(features, label[, weight])`` as bins. Rows without a label or a feature are left out."""
    known = df.where(F.col("label").isNotNull())
    cuts = cut_points(known, width)
    weight = F.col("weight") if "weight" in df.columns else F.lit(1.0)

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            values = np.asarray(b.column(3).flatten()).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _packed(binned(values, cuts))], ["id", "label", "weight", "bins"])

    rows = known.select(F.monotonically_increasing_id().alias("id"), F.col("label").cast("double").alias("label"), weight.alias("weight"), "features")
    schema = "id long, label double, weight double, bins binary"
    path = scratch_path(df.sparkSession, "tree-bins")
    spread(rows.mapInArrow(each, schema), "id").write.parquet(path)
    table = df.sparkSession.read.schema(schema).parquet(path)
    return Binned(table, cuts, table.count())


_POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800.0]))


def _times(ids: np.ndarray, seed: int, tree: int, resample: bool) -> np.ndarray:
    """How often a tree takes each row: Poisson with mean 1, a function of row and tree."""
    if not resample:
        return np.ones(len(ids))
    h = _mixed(_mixed(ids.astype(np.uint64) + root_hash(seed, tree)) + _ODD[1])
    return np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right").astype(np.float64)


@dataclass
class _Top:
    """A tree while it grows on the driver."""

    tree: int
    seed: int
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    stats: list = field(default_factory=lambda: [None])
    depth: list[int] = field(default_factory=lambda: [0])
    hash: list = field(default_factory=list)

    def __post_init__(self):
        self.hash = [root_hash(self.seed, self.tree)]

    def frozen(self) -> Tree:
        return Tree(np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.left, np.int32), np.empty(0))


#: A factor on the weight of each row, from its bins and label.
Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


def read_rows(b: pa.RecordBatch, width: int, weigh: Weigh | None = None):
    """(ids, labels, weights, bins) of a batch of the table."""
    ids, label, weight = (np.asarray(b.column(i)) for i in range(3))
    bins = _unpacked(b.column(3), width)
    return ids, label, weight if weigh is None else weight * weigh(bins, label), bins


def _histograms(data: Binned, tops: list[_Top], nodes: list[tuple[int, int]], rule: Rule, resample: bool, weigh: Weigh | None) -> dict[int, dict[int, tuple]]:
    """{slot: {attribute: (score, bin, left, total)}} for the (tree, node) pairs ``nodes``, from one pass over the table."""
    spark = data.table.sparkSession
    slots: dict[int, np.ndarray] = {}
    for i, (t, n) in enumerate(nodes):
        slots.setdefault(t, np.full(len(tops[t].feature), -1, np.int64))[n] = i
    sent = spark.sparkContext.broadcast({t: (tops[t].frozen(), s, tops[t].seed, tops[t].tree) for t, s in slots.items()})
    k, width, size, counted = len(nodes), rule.width, rule.stats, data.counted

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((width, size, k * BINS))
        for b in parts:
            ids, label, weight, bins = read_rows(b, width, weigh)
            for tree, slot_of, seed, number in sent.value.values():
                times = ids.astype(np.float64) if counted else _times(ids, seed, number, resample)
                slot = slot_of[tree.leaf_of(bins)]
                take = np.flatnonzero((slot >= 0) & (times > 0))
                stats = stats_of(label[take], weight[take], times[take], rule)
                for j in range(width):
                    key = slot[take] * BINS + bins[take, j]
                    for c in range(size):
                        table[j, c] += np.bincount(key, stats[:, c], k * BINS)
        rows = table[:, -1].reshape(width, k, BINS).sum(2)
        at = [(int(s), int(j)) for j, s in zip(*np.nonzero(rows))]
        found = [np.ascontiguousarray(table[j, :, s * BINS : (s + 1) * BINS]).tobytes() for s, j in at]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array(found, pa.binary())], ["slot", "feature", "counts"])

    def best(group: pa.Table) -> pa.Table:
        table = np.zeros((size, BINS))
        for x in group.column("counts"):
            table += np.frombuffer(x.as_py()).reshape(size, BINS)
        upto = np.cumsum(table.T, 0)
        score = rule.scores(upto[:-1], upto[-1])
        at = int(score.argmax())
        return pa.table({
            "slot": group.column("slot")[:1], "feature": group.column("feature")[:1], "score": pa.array([score[at]]), "bin": pa.array([at], pa.int32()),
            "left": pa.array([upto[at].tolist()]), "total": pa.array([upto[-1].tolist()]),
        })

    counted = data.table.mapInArrow(count, "slot int, feature int, counts binary")
    found = counted.groupBy("slot", "feature").applyInArrow(best, "slot int, feature int, score double, bin int, left array<double>, total array<double>")
    out: dict[int, dict[int, tuple]] = {}
    for r in found.collect():
        out.setdefault(r.slot, {})[r.feature] = (r.score, r.bin, np.array(r.left), np.array(r.total))
    return out


def _dealt(data: Binned, tops: list[_Top], nodes: list[tuple[int, int, int]], rule: Rule, resample: bool, weigh: Weigh | None) -> dict[tuple[int, int], Tree]:
    """The subtrees of the (tree, node, rows) ``nodes``, each grown by one task; small ones share a task."""
    spark = data.table.sparkSession
    groups: list[list[tuple[int, int]]] = [[]]
    filled = 0
    for t, n, rows in sorted(nodes, key=lambda x: -x[2]):
        if groups[-1] and filled + rows > DEAL_ROWS:
            groups.append([])
            filled = 0
        groups[-1].append((t, n))
        filled += rows
    place = {node: (g, i) for g, members in enumerate(groups) for i, node in enumerate(members)}
    maps: dict[int, np.ndarray] = {}
    for (t, n), (g, i) in place.items():
        maps.setdefault(t, np.full((len(tops[t].feature), 2), -1, np.int32))[n] = (g, i)
    sent = spark.sparkContext.broadcast({t: (tops[t].frozen(), m, tops[t].seed, tops[t].tree) for t, m in maps.items()})
    facts = spark.sparkContext.broadcast([[(tops[t].hash[n], tops[t].depth[n], t, n) for t, n in members] for members in groups])
    width, counted = rule.width, data.counted

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids, label, weight, bins = read_rows(b, width, weigh)
            for tree, where, seed, number in sent.value.values():
                times = ids.astype(np.float64) if counted else _times(ids, seed, number, resample)
                at = where[tree.leaf_of(bins)]
                take = np.flatnonzero((at[:, 0] >= 0) & (times > 0))
                if len(take):
                    columns = [pa.array(at[take, 0]), pa.array(at[take, 1]), pa.array(label[take]), pa.array(weight[take]), pa.array(times[take]), _packed(bins[take])]
                    yield pa.RecordBatch.from_arrays(columns, ["g", "i", "label", "weight", "times", "bins"])

    def finish(group: pa.Table) -> pa.Table:
        members = facts.value[group.column("g")[0].as_py()]
        bins = np.concatenate([_unpacked(c, width) for c in group.column("bins").chunks])
        label, weight, times, root = (np.asarray(group.column(c)) for c in ("label", "weight", "times", "i"))
        hashes, depths = np.array([m[0] for m in members], np.uint64), np.array([m[1] for m in members])
        found = grow_rows(bins, stats_of(label, weight, times, rule), root, hashes, depths, rule)
        return pa.table({
            "tree": pa.array([m[2] for m in members], pa.int32()), "node": pa.array([m[3] for m in members], pa.int32()),
            **{c: pa.array([getattr(x, c).tobytes() for x in found], pa.binary()) for c in ("feature", "bin", "left", "stats")},
        })

    sent_rows = data.table.mapInArrow(send, "g int, i int, label double, weight double, times double, bins binary")
    grown = sent_rows.groupBy("g").applyInArrow(finish, "tree int, node int, feature binary, bin binary, left binary, stats binary")
    as_int = lambda x: np.frombuffer(bytes(x), np.int32)
    return {(r.tree, r.node): Tree(as_int(r.feature), as_int(r.bin), as_int(r.left), np.frombuffer(bytes(r.stats)).reshape(-1, rule.stats)) for r in grown.collect()}


def grow(data: Binned, rule: Rule, *, trees: int = 1, seed: int = 42, resample: bool = False, weigh: Weigh | None = None, deal: int | None = None) -> list[Tree]:
    """``trees`` trees over the table; with ``resample`` each takes every row a Poisson number of times.

    Nodes of at most ``deal`` rows (DEAL_ROWS) are dealt to tasks; that changes the time and not the trees. The model, one
    entry per node, is gathered on the driver, as every use of it needs it whole.
    """
    deal = DEAL_ROWS if deal is None else deal
    tops = [_Top(t, seed) for t in range(trees)]
    chunk = max(1, HISTOGRAM_BYTES // max(1, rule.width * BINS * rule.stats * 8))
    big, small = ([(t, 0) for t in range(trees)], []) if data.rows > deal and rule.width else ([], [(t, 0, data.rows) for t in range(trees)])
    while big:
        ahead: list[tuple[int, int]] = []
        for i in range(0, len(big), chunk):
            part = big[i : i + chunk]
            found = _histograms(data, tops, part, rule, resample, weigh)
            for slot, (t, n) in enumerate(part):
                top, cuts = tops[t], found[slot]
                total = next(iter(cuts.values()))[3]
                top.stats[n] = total
                if not rule.open(total[None], np.array([top.depth[n]]))[0]:
                    continue
                first = rule.chosen(np.array([top.hash[n]], np.uint64))[0]
                for tried in (first, ~first):
                    j = max((j for j in cuts if tried[j]), key=lambda j: (cuts[j][0], -j), default=None)
                    if j is not None and rule.better(np.array([cuts[j][0]]), total[None])[0]:
                        break
                else:
                    continue
                _, bin_, left, _ = cuts[j]
                top.feature[n], top.bin[n], top.left[n] = j, bin_, len(top.feature)
                hashes = child_hashes(np.array([top.hash[n]], np.uint64))
                for side, s in enumerate((left, total - left)):
                    here = len(top.feature)
                    for column, v in ((top.feature, -1), (top.bin, 0), (top.left, -1), (top.stats, s), (top.depth, top.depth[n] + 1), (top.hash, hashes[side])):
                        column.append(v)
                    if not rule.open(s[None], np.array([top.depth[here]]))[0]:
                        continue
                    if s[-1] > deal:
                        ahead.append((t, here))
                    else:
                        small.append((t, here, int(s[-1])))
        big = ahead
    subtrees = _dealt(data, tops, small, rule, resample, weigh) if small and data.rows else {}
    return [_whole(top, {n: s for (t, n), s in subtrees.items() if t == top.tree}, rule) for top in tops]


def _whole(top: _Top, subtrees: dict[int, Tree], rule: Rule) -> Tree:
    """A driver's tree with its subtrees in place of the nodes that were dealt out."""
    feature, cut, left = ([np.array(x, np.int32)] for x in (top.feature, top.bin, top.left))
    zero = np.zeros(rule.stats)
    stats = [np.array([zero if s is None else s for s in top.stats])]
    size = len(top.feature)
    for n, s in sorted(subtrees.items()):
        shift = size - 1  # its root takes the place of the node, the others follow
        moved = np.where(s.left >= 0, s.left + shift, -1).astype(np.int32)
        feature[0][n], cut[0][n], left[0][n], stats[0][n] = s.feature[0], s.bin[0], moved[0], s.stats[0]
        feature.append(s.feature[1:])
        cut.append(s.bin[1:])
        left.append(moved[1:])
        stats.append(s.stats[1:])
        size += len(s.feature) - 1
    return Tree(np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(stats))
