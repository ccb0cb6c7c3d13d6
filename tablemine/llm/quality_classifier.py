"""Quality scores by a generalised additive model with pairwise interactions: lookup tables learnt by cyclic boosting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.llm.common import fresh, written
from tablemine.llm.encoding import batches
from tablemine.llm.shingles import stirred, words_in

#: What is measured on a text, in this order.
FEATURES = (
    "log_words", "word_length", "word_length_spread", "short_words", "bare_words", "distinct_words", "commonest_word", "repeated_neighbours", "repeated_windows",
    "capitals", "digits", "symbols", "marks", "stops", "line_ends", "repeated_lines", "wide_bytes", "longest_word",
)
#: Labelled rows a model is fitted on at most, chosen by a hash of the key.
SAMPLE_ROWS = 40_000
#: Characters that a worker measures at once.
BATCH_CHARS = 2_000_000

_CLASSES = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>@^~=+_{}[]\\/", b"!?\"'();:-", b".,", b"\n"), 1):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 7


def features(texts: Sequence[str | None]) -> np.ndarray:
    """One row of FEATURES per text; NULL and empty texts are all zero."""
    index, words, begin = words_in(texts)
    spelled = words.to_pylist()
    length = np.array([len(w) for w in spelled], np.float64)
    bare = np.array([not any(c.isalnum() for c in w) for w in spelled], np.float64)
    out = np.zeros((len(texts), len(FEATURES)))
    for r, (text, a, b) in enumerate(zip(texts, begin[:-1].tolist(), begin[1:].tolist())):
        n = b - a
        if not n:
            continue
        data, w = np.frombuffer(text.encode(), np.uint8), index[a:b]
        kinds = np.bincount(_CLASSES[data], minlength=8)
        size, plain = length[w], max(1, len(data))
        _, often = np.unique(w, return_counts=True)
        lines = [x for x in text.split("\n") if x]
        windows = stirred(stirred(w[:-2].astype(np.uint64) + np.uint64(1)) + stirred(w[1:-1].astype(np.uint64) * np.uint64(3)) + w[2:].astype(np.uint64)) if n > 2 else w[:0]
        out[r] = (
            np.log1p(n), size.mean(), size.std(), (size <= 3).mean(), bare[w].mean(), len(often) / n, often.max() / n,
            (w[1:] == w[:-1]).mean() if n > 1 else 0.0, 1 - len(np.unique(windows)) / max(1, len(windows)), kinds[1] / plain, kinds[2] / plain,
            kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, 1 - len(set(lines)) / max(1, len(lines)), kinds[7] / plain, np.log1p(size.max()),
        )
    return out


# --- the model --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Gam:
    """score = logistic(base + sum of one table entry per feature and per chosen pair of features)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """(gain, place) of the best single cut of bins with gradient and curvature sums ``g``, ``h``."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain = np.where((hl >= least) & (hr >= least), gain, -np.inf)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (-np.inf, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Leaf values, per bin, of a tree of ``depth`` over one feature's bins."""
    gain, at = _best_cut(g, h, ridge, least) if depth else (-np.inf, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.r_[_tree(g[:at], h[:at], depth - 1, ridge, least), _tree(g[at:], h[at:], depth - 1, ridge, least)]


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """(gain, leaf values) of the best tree over two features' bins that cuts one and then, on either side, the other."""
    best, table = -np.inf, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        _, at = _best_cut(gg.sum(1), hh.sum(1), ridge, 0.0)
        out, total = np.zeros_like(gg), 0.0
        for side in (slice(0, at), slice(at, None)):
            gs, hs = gg[side].sum(0), hh[side].sum(0)
            leaf = _tree(gs, hs, 1, ridge, least)
            total += float((leaf * gs).sum())
            out[side] = leaf
        if total > best:
            best, table = total, out.T if turned else out
    return best, table


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1, depth: int = 2,
        ridge: float = 2.0, least: float = 2.0) -> Gam:
    """Boost the logistic loss of ``y`` (0 or 1): every round visits each feature once with a shallow tree over its bins.

    Then the pairs of features whose tree reduces what is left most get a table of their own, boosted in the same way. With
    no rows, or one class only, the tables stay zero and the score is the smoothed share.
    """
    y = y.astype(float)
    share = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(width)]
    model = Gam(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    if not len(x) or y.min() == y.max():
        return model
    b = model.bins(x)
    size = [len(t) for t in model.tables]
    total = np.full(len(x), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, size[j]), np.bincount(b[:, j], h, size[j]), depth, ridge, least)
            model.tables[j][:] += step
            total += step[b[:, j]]
    at = lambda i, j: b[:, i] * size[j] + b[:, j]
    sums = lambda i, j, v: np.bincount(at(i, j), v, size[i] * size[j]).reshape(size[i], size[j])
    g, h = slopes()
    gains = sorted(((_pair_tree(sums(i, j, g), sums(i, j, h), ridge, least)[0], i, j) for i in range(width) for j in range(i) if min(size[i], size[j]) > 1), reverse=True)
    for _, i, j in gains[:pairs]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((size[i], size[j])))
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = rate * _pair_tree(sums(i, j, g), sums(i, j, h), ridge, least)[1]
            t += step
            total += step[b[:, i], b[:, j]]
    return model


# --- over tables ------------------------------------------------------------------------------------------------------


def measured(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, x): FEATURES of every row's whole text."""
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = b.column("text").to_pylist()
            for i, j in batches(texts, BATCH_CHARS):
                x = pa.array(list(features(texts[i:j])), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), x], ["doc_id", "x"])

    return rows.mapInArrow(each, f"doc_id {kind}, x array<double>")


def learnt(measures: DataFrame, labels: DataFrame, *, label: str = "quality", sample_rows: int = SAMPLE_ROWS, **how) -> Gam:
    """Fit on ``labels(doc_id, label)`` joined to ``measures``. Of more than ``sample_rows`` labels a share by hash is used, so
    what reaches the driver is bounded. Labels that are NULL or have no document say nothing."""
    known = labels.select("doc_id", F.col(label).alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    rows = measures.join(known, "doc_id").select("doc_id", "x", "y").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x[order], np.array(rows.column("y").to_pylist(), float)[order], **how)


def scored(measures: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, score): additions of table entries, a batch at a time."""
    kind = measures.schema["doc_id"].dataType.simpleString()

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    return measures.select("doc_id", "x").mapInArrow(each, f"doc_id {kind}, score double")


def learning_part(key: str = "doc_id"):
    """True for the rows whose labels may be learnt from; the others are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def classified(df: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", cut: float = 0.7, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``df``; labels of held-out rows are never read.

    The score looks at the text only, all of it however long. NULL and empty texts are measured as zeros and scored like any
    other; repeated rows get equal scores; other columns are ignored. Without labels to learn from every score is 0.5.
    """
    measures = written(measured(df, text=text, key=key), "quality-measures")
    model = learnt(measures, labels.where(learning_part()), label=label, **how)
    out = scored(measures, model)
    return out.select("doc_id", (~learning_part()).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(df: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", cut: float = 0.7, **how) -> DataFrame:
    """The rows of ``df`` with a score of at least ``cut``, with all its columns. Rows of one key are kept if any of them is.

    Without labels to learn from nothing is known against any row, so all rows are kept.
    """
    if labels.where(learning_part() & F.col(how.get("label", "quality")).isNotNull()).isEmpty():
        return df
    (name,) = fresh(df, "_good")
    good = classified(df, labels, text=text, key=key, cut=cut, **how).where("predicted = 1").select(F.col("doc_id").alias(name))
    return df.join(good, F.col(f"`{key}`").eqNullSafe(F.col(name)), "left_semi")
