"""A small table with every awkward case: NULLs, blanks, ties, repeats, long texts, columns that clash."""

import random

import pytest
from made_texts import prose
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("kept", T.StringType()), T.StructField("_words", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("row", T.StringType()), T.StructField("h", T.StringType()), T.StructField("k", T.LongType()),
])


def awkward_rows():
    rng = random.Random(7)
    base = prose(rng, 120)
    near = base.split(" ")
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    texts += [base, base, base + " one more", " ".join([*near[:60], "changed", *near[61:]]), base.upper()]
    texts += [None, "", "   \n\t ", "a", "a b", "A  B", "one two three", "\x0b\x0c|x|", "日本語 の テキスト", "é ́ x\x85y\xa0z", "no\x00nul", "<|endoftext|> a<|endoftext|>b"]
    texts += ["same same same " * 40, "line one two\n" * 30, "# $ % & " * 20, "SHOUT LOUD NOW " * 20, prose(rng, 12000), "x" * 70000]
    rows = [(i * 3, t, "en", f"s{i % 4}" if i % 5 else "hot", 1, 5, "yes", "w", i, "r", "h", 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain(spark):
    """The rows whose ids are there and differ."""
    rows = {r[0]: r for r in awkward_rows() if r[0] is not None}
    return spark.createDataFrame(list(rows.values()), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def texts(plain):
    return {r.doc_id: r.text or "" for r in plain.collect()}
