"""Quality rules as a short-circuit cascade, ordered by rejections per cost. DataFrame expressions only."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemine.llm.common import fresh, words_of, written


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a document that the rule rejects; NULL counts as not rejected."""

    name: str
    fails: Column


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit("\x20\x09\x0a\x0b\x0c\x0d")) != "")
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text, its first place included.

    Windows are compared by their 64-bit hash. Only texts where some window repeats are sorted: equal windows become
    neighbours, their places are sorted again, and each place covers the words up to the next one, ``width`` at most.
    """

    def hashes(w: Column) -> Column:
        at = lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)])
        return F.slice(F.transform(w, at), F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))

    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twin(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            kept = F.transform(s, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
            return F.sort_array(F.filter(kept, lambda i: i.isNotNull()))

        return bound(ordered, twin)

    def covered(p: Column) -> Column:
        step = lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))
        return F.aggregate(F.transform(p, step), F.lit(0).cast("long"), lambda a, b: a + b)

    def total(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), bound(places(h), covered)).otherwise(F.lit(0).cast("long"))

    return bound(words, lambda w: bound(hashes(w), total))


def metrics(text: Column, words: Column) -> dict[str, Column]:
    """The counts that the rules below look at, each an expression of its own over the text or its words."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": word_chars(words),
        "n_symbols": count_of(text, r"[#*$%&|<>]"),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(words),
        "n_capitals": count_of(text, r"\p{Lu}"),
    }


def default_rules(m: dict[str, Column]) -> list[Rule]:
    """Too short; mostly repeated; symbols; capitals; repeated lines; words of odd length. ``m`` as :func:`metrics`."""
    n = m["n_words"]
    return [
        Rule("short", n < 50),
        Rule("repeats", 100 * m["n_repeat_words"] > 50 * n),
        Rule("symbols", 10 * m["n_symbols"] > n),
        Rule("capitals", 10 * m["n_capitals"] > 3 * m["word_chars"]),
        Rule("lines", 10 * m["n_dup_lines"] > n),
        Rule("odd_words", (m["word_chars"] < 2 * n) | (m["word_chars"] > 15 * n)),
    ]


def measured(df: DataFrame, rules: Sequence[Rule], *, sample_rows: int, key: Sequence[str]) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds for the sample), measured one rule at a time on about ``sample_rows`` rows.

    The sample follows a hash of ``key`` and is written once, so a rule's time holds no more than the rule and a scan.
    """
    n = df.count()
    share = min(1.0, sample_rows / max(n, 1))
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(1_000_000))
    sample = written(df.where(bucket < F.lit(int(share * 1_000_000))) if share < 1 else df, "rules-sample")
    sample.agg(F.count(F.lit(1))).collect()
    out = []
    for r in rules:
        start = time.perf_counter()
        got = sample.agg(F.avg(F.coalesce(r.fails, F.lit(False)).cast("double"))).first()[0]
        out.append((r, got or 0.0, time.perf_counter() - start))
    return out


def ordered(found: Sequence[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejections per second first; equals keep their order."""
    return [r for r, share, cost in sorted(found, key=lambda x: -(x[1] / max(x[2], 1e-9)))]


def verdict(rules: Sequence[Rule]) -> Column:
    """True if no rule fails. One CASE: what follows the first failing rule isn't computed for that row."""
    out = None
    for r in rules:
        failed = F.coalesce(r.fails, F.lit(False))
        out = F.when(failed, F.lit(False)) if out is None else out.when(failed, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(df: DataFrame, *, text: str = "text", key: Sequence[str] = ("doc_id",), rules: Callable[[dict[str, Column]], list[Rule]] = default_rules,
           sample_rows: int = 2000, keep_metrics: bool = False, kept: str = "kept") -> DataFrame:
    """Every row of ``df`` with a column named ``kept``: the verdict of all rules, cheapest rejections first.

    ``keep_metrics`` also adds the counts; the rules then read those instead of the text. NULL and empty texts have no
    words and fail the rule on length; so does every row if the text column is NULL. Long texts are judged whole. The order of the rules changes the
    time only, never the verdict. Extra columns stay; one named like an added one is replaced. No row is dropped.
    """
    (w,) = fresh(df, "_words")
    t = F.col(f"`{text}`")
    with_words = df.withColumn(w, words_of(t))
    lazy = metrics(t, F.col(w))
    order = ordered(measured(with_words, rules(lazy), sample_rows=sample_rows, key=key))
    if not keep_metrics:
        return with_words.withColumn(kept, verdict(order)).drop(w)
    full = with_words.withColumns(lazy).drop(w)
    by_name = {r.name: r for r in rules({n: F.col(n) for n in lazy})}
    return full.withColumn(kept, verdict([by_name[r.name] for r in order]))


def passing(df: DataFrame, **how) -> DataFrame:
    """The rows that pass every rule, with the columns of ``df``."""
    (name,) = fresh(df, "_kept")
    out = judged(df, kept=name, **how)
    return out.where(F.col(name)).select(*[F.col(f"`{c}`") for c in df.columns])
