"""Fingerprints and the n-gram join against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from made_texts import prose

from tablemine.llm import fingerprints, jaccard_join, shingles


def words(text):
    return [w.decode() for w in text.encode().lower().split()]


def generalised(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    union = sum(max(a[k], b[k]) for k in a | b)
    return sum(min(a[k], b[k]) for k in a) / union if union else 1.0


def test_share_of_equal_samples_is_generalised_jaccard():
    rng = random.Random(1)
    texts = [prose(rng, 150) for _ in range(60)]
    changed = [fingerprints.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]
    found = fingerprints.signatures(texts + changed, 512)
    off = [fingerprints.likeness(found[i], found[60 + i]) - generalised(texts[i], changed[i]) for i in range(60)]
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.035
    assert (found[0] == fingerprints.signatures([texts[0]], 512)[0]).all()


def test_weights_count():
    a, b = "x " * 10 + "y " * 10, "x " * 10 + "y " * 5
    f, g = fingerprints.signatures([a, b], 4096)
    assert fingerprints.likeness(f, g) == pytest.approx(0.75, abs=0.03)


@pytest.mark.parametrize("parts", [1, 5])
def test_chain(plain, texts, parts):
    got = {r.doc_id: r for r in fingerprints.chained(plain.repartition(parts), samples=32).collect()}
    keys = sorted(texts)
    assert sorted(got) == keys
    own = dict(zip(keys, fingerprints.signatures([texts[k] for k in keys], 32)))
    for a, b in zip(keys, keys[1:] + keys[:1]):
        e = fingerprints.edited(texts[a], texts[b])
        f = fingerprints.signatures([e], 32)[0]
        assert (got[a].n_chars, got[a].edited_sha256) == (len(texts[a]), hashlib.sha256(e.encode()).hexdigest())
        assert (got[a].fingerprint, got[a].edited_fingerprint) == (fingerprints.spelled(own[a]), fingerprints.spelled(f))
        assert (got[a].near_edited, got[a].near_next) == (fingerprints.likeness(own[a], f), fingerprints.likeness(own[a], own[b]))


def test_chain_of_awkward_tables(awkward, empty):
    assert fingerprints.chained(awkward, samples=8).count() == awkward.count()
    assert fingerprints.chained(empty, samples=8).count() == 0
    (one,) = fingerprints.chained(awkward.where("doc_id = 0"), samples=8).collect()
    assert one.near_next == 1.0


def test_similar_in_columns(plain):
    from pyspark.sql import functions as F

    f = fingerprints.fingerprint(plain, samples=16)
    both = f.crossJoin(f.where("doc_id = 0").select(F.col("fingerprint").alias("other"))).select("fingerprint", "other", fingerprints.similar(F.col("fingerprint"), F.col("other")).alias("s"))
    for r in both.collect():
        a, b = (np.frombuffer(bytes.fromhex(x), ">u2") for x in (r.fingerprint, r.other))
        assert r.s == pytest.approx(fingerprints.likeness(a, b))


# --- n-gram join ---


def test_shingle_sets():
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (0, 1, 2, 3, 50)] + [None, " ", "A b", "a B", "a b c a b c a b c"]
    got = shingles.shingle_sets(texts, 3)
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}
    assert [len(s) for s in got] == [len(grams(words(t or ""))) for t in texts]
    assert (got[7] == got[8]).all() and all((np.diff(s.astype(object)) > 0).all() for s in got)


def brute(texts):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            n = len(sets[a] & sets[b]) if a < b else 0
            if n and 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_groups_of_awkward_rows(plain, awkward, empty, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_groups(plain).collect()} == brute(texts)
    assert jaccard_join.near_groups(awkward).count() == awkward.count()
    assert jaccard_join.near_groups(empty).count() == 0
    kept = jaccard_join.one_of_each(awkward).collect()
    assert len({r.doc_id for r in kept if r.doc_id is not None}) == len(kept) - sum(r.doc_id is None for r in kept)
    assert jaccard_join.one_of_each(awkward).columns == awkward.columns


def test_chains_of_near_copies(spark):
    """Copies with one to four edits each, many of them linked only by way of others, around originals that may be missing."""
    rng = random.Random(9)
    texts = {}
    for g in range(4):
        base = prose(rng, 90).split()
        for k in range(25):
            w = list(base)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["x1", "x2", "x3", "x4"])
            texts[len(texts)] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_groups(df).collect()} == brute(texts)


def test_one_of_each_with_null_and_repeated_keys(spark):
    a, b, c = (prose(random.Random(k), 60) for k in (1, 2, 3))
    rows = [(1, a), (None, a), (None, b), (None, b + " more"), (None, b), (5, a), (5, c), (5, c), (None, None), (7, None), (7, "")]
    out = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), width=3)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert {x for x in got if x[1] not in (b, b + " more")} == {(1, a), (5, c), (None, None), (7, None), (7, "")}
    assert sum(x[1] in (b, b + " more") for x in got) == 1 and len(got) == 6
