"""Quality rules, quality classifier, mixing and chat formatting against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemine.llm import chat, mixing, quality_classifier, quality_rules
from tablemine.llm.common import WORD, attach


def size():
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))



def repeats(words):
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_counts_of_the_rules(plain, texts):
    got = {r.doc_id: r for r in quality_rules.judged(plain.select("doc_id", "text"), keep_metrics=True, sample_rows=20).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeats(w))
        bad = len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w) or 10 * r.n_symbols > len(w) or 10 * r.n_capitals > 3 * r.word_chars
        assert r.kept == (not (bad or 10 * r.n_dup_lines > len(w) or not 2 * len(w) <= r.word_chars <= 15 * len(w)))


def test_rules_keep_rows_and_columns(awkward, empty):
    got = quality_rules.judged(awkward, kept="verdict", sample_rows=10)
    assert got.count() == awkward.count() and got.columns == [*awkward.columns, "verdict"]
    passing = quality_rules.passing(awkward)
    assert passing.columns == awkward.columns and {r.kept for r in passing.collect()} <= {"yes", None}
    assert quality_rules.passing(empty).count() == 0


def test_order_changes_no_verdict(plain):
    rows = plain.withColumn("_words", quality_rules.words_of(F.col("text")))
    rules = quality_rules.default_rules(quality_rules.metrics(F.col("text"), F.col("_words")))
    both = rows.select(quality_rules.verdict(rules).alias("a"), quality_rules.verdict(rules[::-1]).alias("b")).collect()
    assert all(r.a == r.b for r in both) and len({r.a for r in both}) == 2


def test_cheapest_rejections_come_first():
    a, b, c = (quality_rules.Rule(n, F.lit(True)) for n in "abc")
    assert [r.name for r in quality_rules.ordered([(a, 0.1, 1.0), (b, 0.5, 1.0), (c, 0.3, 0.1)])] == ["c", "b", "a"]


# --- mixing ---


def brute_mix(rows):
    sums = Counter()
    for key, source, size in rows:
        sums[source] += size
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sums.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sums[s]}
        for s in over or open_:
            target[s] = 2.0 * sums[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    return sums, target


@pytest.mark.parametrize("table", ["awkward", "plain"])
def test_mix(request, table):
    df = request.getfixturevalue(table)
    got = mixing.mix(df, (5, 2, 1), size=size()).collect()
    sums, target = brute_mix([(r.doc_id, r.source, r["size"]) for r in got])
    took, most = Counter(), Counter()
    for r in got:
        assert r.source_size == sums[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2
        took[r.source] += r["size"] * r.copies
        most[r.source] = max(most[r.source], r["size"])
    for s in sums:
        assert abs(took[s] - target[s]) <= most[s]
    assert len(got) == df.count()


def test_mix_is_the_same_whatever_the_partitions(plain):
    a, b = (sorted((r.doc_id, r.copies) for r in mixing.mix(plain.repartition(n), (5, 2, 1), size=size()).collect()) for n in (1, 7))
    assert a == b


def test_taken_repeats_rows(plain, empty):
    copies = {r.doc_id: r.copies for r in mixing.mix(plain, (5, 2, 1), size=size()).collect()}
    out = mixing.taken(plain, (5, 2, 1), size=size())
    assert out.columns == plain.columns and {r["size"] for r in out.collect()} == {5}
    assert Counter(r.doc_id for r in out.collect()) == Counter({d: n for d, n in copies.items() if n})
    assert mixing.taken(empty, (5, 2, 1), size=size()).count() == 0


def test_salted_join_equals_broadcast(spark, monkeypatch):
    big = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(50)], "i int, s string")
    small = spark.createDataFrame([("a", 1), (None, 2)], "s string, v int")
    want = sorted((r.i, r.v) for r in attach(big, small, ["s"]).collect())
    monkeypatch.setattr("tablemine.llm.common.BROADCAST_ROWS", 0)
    assert sorted((r.i, r.v) for r in attach(big, small, ["s"]).collect()) == want and len(want) == 50


# --- classifier ---


def test_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=3000) * 0.3 > 0).astype(float)
    m = quality_classifier.fit(x[:2000], y[:2000], pairs=3)
    s, b = m.scores(x[2000:]), m.bins(x[2000:])
    by_hand = [m.base + sum(t[b[r, j]] for j, t in enumerate(m.tables)) + sum(t[b[r, i], b[r, j]] for (i, j), t in zip(m.pairs, m.pair_tables)) for r in range(50)]
    assert s[:50] == pytest.approx(1 / (1 + np.exp(-np.array(by_hand))))
    assert m.pairs[0] in [(2, 1), (1, 2)] and ((s > 0.5) == y[2000:]).mean() > 0.88
    assert ((quality_classifier.fit(x[:2000], y[:2000], pairs=0).scores(x[2000:]) > 0.5) == y[2000:]).mean() < ((s > 0.5) == y[2000:]).mean()


def test_held_out_labels_are_predicted_and_never_read(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classified(docs, labels)
    both = got.join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in both if r.quality == 1], [r.score for r in both if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    other = labels.withColumn("quality", F.when(quality_classifier.learning_part(), F.col("quality")).otherwise(1 - F.col("quality")))
    assert {(r.doc_id, r.score) for r in quality_classifier.classified(docs, other).collect()} == {(r.doc_id, r.score) for r in got.collect()}


def test_classifier_on_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(0, 1), (3, 0), (6, 1), (None, 1), (9, None), (21, 0)], "doc_id long, quality int")
    got = quality_classifier.classified(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality_classifier.accepted(awkward, labels).columns == awkward.columns
    assert quality_classifier.classified(empty, labels).count() == 0
    none = quality_classifier.classified(awkward, labels.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5}


# --- chat ---


def test_only_maximal_conversations_stay(spark):
    def turns(conv, *texts):
        return [(conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]

    long = [str(i) for i in range(700)]
    rows = turns(1, "a", "b") + turns(2, "a", "b", "c") + turns(3, "a", "x") + turns(4, "a", "b", "c") + turns(5, "b", "a") + turns(6, *long) + turns(7, *long[:600])
    rows += [(8, 0, "user", None), (9, 0, "user", ""), (10, 0, None, None), (None, 0, "user", "q<|im_end|>"), (None, None, None, None), (2, 0, "user", "a")]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    # 10 is how the NULL conversation begins
    assert {r.conv_id for r in got} == {2, 3, 5, 6, 8, 9, None}
    whole = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.position))
    assert whole == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert sorted(r.position for r in got if r.conv_id == 6) == list(range(1, 701)) and {r.n_turns for r in got if r.conv_id == 6} == {700}
    assert [r.rendered for r in got if r.conv_id is None and r.turn == 0] == ["<|im_start|>user\nq< |im_end|><|im_end|>\n"]


def test_empty_log(spark):
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_with_other_columns_and_a_long_text(spark):
    schema = "conv_id long, turn long, role string, text string, c string, b long, p1 long, position long, n_turns long, i int, rendered string"
    rows = [(k, t, "user", x, "c", 1, 2, 3, 4, 5, "r") for k, t, x in ((1, 0, "a"), (2, 0, "a"), (2, 1, "z" * 300_000))]
    got = chat.formatted(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.conv_id, r.position, len(r.rendered)) for r in got) == [(2, 1, 29), (2, 2, 300_028)]
