"""The suffix tree against counts in dictionaries."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemine.llm import suffix_tree as st


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def brute(texts):
    out_of = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    tokens = {d: ["</s>", *[w.decode() for w in t.encode().lower().split()], "</s>"] for d, t in texts.items()}
    c = [Counter() for _ in range(4)]
    for d, w in tokens.items():
        if not out_of[d]:
            c[1].update(w[1:])
            c[2].update(zip(w, w[1:]))
            c[3].update(zip(w, w[1:], w[2:]))
    n, v = sum(c[1].values()), len(c[1])

    def steps(d):
        w, train = tokens[d], not out_of[d]
        for i in range(1, len(w)):
            p = (c[1][w[i]] + 1) / (n + v + 1)
            less = c[1][w[i]] / (n + v) if train else p
            states = [(p, (), 0, 0.0)]
            for size in (1, 2):
                if i < size:
                    break
                context = tuple(w[i - size : i])
                own, seen, k = c[size + 1][(*context, w[i])], c[size][context if size > 1 else context[0]], st.WEIGHTS[size - 1]
                q = (own + k * p) / (seen + k)
                q_less = (own - 1 + k * less) / (seen - 1 + k) if train else q
                states.append((q, context, seen, math.log(q_less / less) if train else 0.0))
                p, less = q, q_less
            yield states

    gain = Counter()
    for d in texts:
        for states in steps(d):
            for _, context, seen, g in states[1:]:
                if seen >= st.LEAST_COUNT:
                    gain[context] += g
    out = {}
    for d in texts:
        base = score = 0.0
        for states in steps(d):
            base += math.log10(states[0][0])
            kept = [p for p, context, seen, _ in states if not context or (seen >= st.LEAST_COUNT and gain[context] > st.LEAST_GAIN)]
            score += math.log10(kept[-1])
        out[d] = (out_of[d], len(tokens[d]) - 1, sum(c[1][w] > 0 for w in tokens[d][1:]), n, base, score)
    return out


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4]) and r.score == pytest.approx(w[5], rel=1e-4)


@pytest.mark.parametrize("size", [st.BLOCK_CHARS, 3000])
def test_scores(plain, texts, size, monkeypatch):
    monkeypatch.setattr(st, "BLOCK_CHARS", size)
    check(st.score(plain, held()).collect(), brute(texts))


def test_documents_beat_single_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = st.score(docs, held()).collect()
    check(got, brute({r.doc_id: r.text or "" for r in docs.collect()}))
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_next_words_sum_to_one(spark):
    """Every context's distribution over known words and one unknown adds up to 1."""
    train = ["a b c", "a b d", "a b c", "b c a"] * 3
    probe = ["a", "b", "c", "d", "zzz", None]
    rows = [(i, t, False) for i, t in enumerate(train)] + [(100 + i, f"a b {p or ''}", True) for i, p in enumerate(probe)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r.doc_id: r for r in st.score(df, F.col("held")).collect()}
    only_end = 10 ** got[105].score  # P(a) P(b) P(end)
    total = 0.0
    for i in range(5):
        r = got[100 + i]
        total += 10**r.score / _end_after(got, df, i, train, probe)
    begun = _begun(train)
    assert (total + only_end) / begun == pytest.approx(1.0, rel=1e-6)


def _tables(train):
    c = [Counter() for _ in range(4)]
    for t in train:
        w = ["</s>", *t.split(), "</s>"]
        c[1].update(w[1:])
        c[2].update(zip(w, w[1:]))
        c[3].update(zip(w, w[1:], w[2:]))
    return c


def _p(c, kept, context, s):
    n, v = sum(c[1].values()), len(c[1])
    p = (c[1][s] + 1) / (n + v + 1)
    best = p
    for size in (1, 2):
        if len(context) < size:
            break
        x = tuple(context[-size:])
        seen = c[size][x if size > 1 else x[0]]
        p = (c[size + 1][(*x, s)] + st.WEIGHTS[size - 1] * p) / (seen + st.WEIGHTS[size - 1])
        if x in kept:
            best = p
    return best


def _kept(train):
    c, gain = _tables(train), Counter()
    n, v = sum(c[1].values()), len(c[1])
    for t in train:
        w = ["</s>", *t.split(), "</s>"]
        for i in range(1, len(w)):
            p, less = (c[1][w[i]] + 1) / (n + v + 1), c[1][w[i]] / (n + v)
            for size in (1, 2):
                if i < size:
                    break
                x = tuple(w[i - size : i])
                own, seen, k = c[size + 1][(*x, w[i])], c[size][x if size > 1 else x[0]], st.WEIGHTS[size - 1]
                q, q_less = (own + k * p) / (seen + k), (own - 1 + k * less) / (seen - 1 + k)
                if seen >= st.LEAST_COUNT:
                    gain[x] += math.log(q_less / less)
                p, less = q, q_less
    return c, {x for x, g in gain.items() if g > st.LEAST_GAIN}


def _end_after(got, df, i, train, probe):
    c, kept = _kept(train)
    return _p(c, kept, ["</s>", "a", "b", probe[i]], "</s>")


def _begun(train):
    c, kept = _kept(train)
    return _p(c, kept, ["</s>"], "a") * _p(c, kept, ["</s>", "a"], "b")


def test_awkward_and_empty_tables(awkward, empty):
    got = st.score(awkward, held()).collect()
    assert len(got) == awkward.count() and all(r.score < 0 for r in got)
    assert st.score(empty, held()).count() == 0


def test_packed_arrays():
    rng = np.random.default_rng(0)
    for n in (0, 1, 10, 5000):
        keys = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        assert (st.unpack_keys(st.pack_keys(keys)) == keys).all()
        counts = rng.integers(0, 600, len(keys))
        assert (st.unpack_counts(st.pack_counts(counts), len(counts)) == counts).all()
