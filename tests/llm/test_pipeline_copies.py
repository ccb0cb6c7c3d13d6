"""The near-duplicate stage against five-word n-grams at 0.8."""

import random

import corpus_pipeline
from made_texts import prose


def grams(text, width):
    w = [x.decode() for x in text.encode().lower().split()]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def likeness(a, b, width):
    a, b = grams(a, width), grams(b, width)
    return len(a & b) / len(a | b) if a and b else 0.0


def first_of_each(texts):
    """Smallest ids of the groups linked at 0.8, in whole numbers."""
    sets, root = {d: grams(t, 5) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            n = len(sets[a] & sets[b]) if a < b else 0
            if n and 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in texts if find(d) == d}


def test_copies_between_eight_and_nine_tenths(spark, sf):
    rng = random.Random(11)
    texts = {}
    for _ in range(6):
        w = prose(rng, 200).split()
        replaced = [*w[:90], *(f"r{i}" for i in range(12)), *w[102:]]
        scattered = [f"s{i}" if i % 50 == 25 else x for i, x in enumerate(w)]
        for copy in (w, replaced, scattered, [*w, *(f"a{i}" for i in range(30))], w[:170], w[:150]):
            texts[len(texts)] = " ".join(copy)
    between = [likeness(texts[g], texts[g + k], 5) for g in range(0, len(texts), 6) for k in range(1, 5)]
    assert all(0.8 <= x < 0.9 for x in between)
    assert all(likeness(texts[g], texts[g + k], 3) < 0.9 for g in range(0, len(texts), 6) for k in (1, 3, 4))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, df, sf).collect()} == first_of_each(texts)


def test_documents_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, sf).collect()} == first_of_each(texts)
