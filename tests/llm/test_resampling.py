"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablemine.llm import resampling

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(of, features(x, longest)[1]))
    for x in target:
        t.update(map(of, features(x, longest)[1]))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    out = []
    for d, x in rows:
        k, f = features(x, longest)
        weight = sum(gain(of(a)) for a in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'NULL' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("longest, buckets, head, tail", [(1, 10_000, 1 << 15, 1 << 17), (2, 70_000, 1 << 15, 1 << 17), (2, 500, 40, 5), (3, 1000, 40, 5)])
def test_resample(awkward, plain, longest, buckets, head, tail, monkeypatch):
    monkeypatch.setattr(resampling, "HEAD", head)
    monkeypatch.setattr(resampling, "TAIL", tail)
    target = plain.where("doc_id % 9 = 0")
    want = brute([(r.doc_id, r.text) for r in awkward.collect()], [r.text for r in target.collect()], longest, buckets, least=5, percent=40)
    assert got(resampling.resample(awkward, target, longest=longest, buckets=buckets, least_words=5, percent=40)) == want
    assert sum(r[5] is not None for r in want) > 10


def test_no_rows_no_target(awkward, empty):
    assert got(resampling.resample(empty, awkward)) == []
    assert got(resampling.resample(awkward, empty)) == brute([(r.doc_id, r.text) for r in awkward.collect()], [])
    nothing = awkward.withColumn("text", F.lit(None).cast("string"))
    assert {r[2:4] for r in got(resampling.resample(nothing, awkward))} == {(0, 0)}


def test_drawn_keeps_columns_and_moves_towards_the_target(spark, sf, awkward):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    ranks = resampling.resample(docs, bench, percent=20)
    taken = resampling.drawn(docs, bench, percent=20)
    assert taken.columns == docs.columns and taken.count() == ranks.where("rank IS NOT NULL").count()
    by = {r.drawn: r.w for r in ranks.where("n_words >= 20").groupBy(F.col("rank").isNotNull().alias("drawn")).agg(F.avg("weight").alias("w")).collect()}
    assert by[True] > by[False]
    assert resampling.drawn(awkward, awkward, percent=50).columns == awkward.columns
