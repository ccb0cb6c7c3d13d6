"""From raw documents to packed token sequences in five stages.

    corpus_pipeline.run(spark, sf_dir)

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its result is written as Parquet and
read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablemine.llm import jaccard_join, mixing, packing, quality_classifier, quality_rules  # noqa: E402
from tablemine.llm.common import WORD, written  # noqa: E402


def follow_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule.

    Whole texts are judged, however long. NULL and empty texts go, as they have no words; repeated rows stay or go together;
    all columns are kept as they are, clashing names included; an empty table stays empty.
    """
    return quality_rules.passing(docs)


def follow_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    NULL and empty texts are scored like others; rows with one doc_id, NULL included, stay if one of them is accepted; without
    labels to learn from all documents stay; columns as they are; an empty table stays empty.
    """
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of copies and near copies: 0.8 of their five-word n-grams alike.

    NULL ids come last; documents that share an id are told apart by their texts. NULL and empty texts have no n-grams and
    are no copies of each other, but of rows equal in id and text one stays. Columns as they are; an empty table stays empty.
    """
    return jaccard_join.one_of_each(docs, width=5, threshold=Fraction(4, 5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them: not at all, once or twice.

    NULL is a source of its own. NULL and empty texts have no words and are taken like others; rows with one doc_id are taken
    together; columns as they are, repeated for repeated rows; an empty table stays empty.
    """
    return mixing.taken(docs, (5, 2, 1), size=F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the encoded documents and their places in sequences of at most 4096 ids.

    NULL and empty texts are the end id alone; long ones are cut; repeated rows are packed each; other columns are left out; an
    empty table gives no piece.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", follow_rules),
    ("quality classifier", follow_classifier),
    ("near duplicates", drop_copies),
    ("mix", mix),
    ("pack", pack),
]

#: A fitted classifier decides what stays, which SQL cannot express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
