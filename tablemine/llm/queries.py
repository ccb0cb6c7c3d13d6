"""The registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemine.llm import chat, conversation_trie, fingerprints, jaccard_join, mixing, packing, quality_classifier, quality_rules, records, resampling, secret_scan, sql, suffix_tree, token_counts
from tablemine.llm.common import WORD, documents
from tablemine.llm.registry import query


@query("op10_quality_rules", sql.QUALITY_RULES)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judged(documents(spark, sf_dir).select("doc_id", "text"), keep_metrics=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept")
    )


@query("op1_mix_sources", sql.MIX_SOURCES)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    got = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"), (5, 2, 1), size=size)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op7_token_records")
def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = records.records_folder(spark)
    records.write_records(documents(spark, sf_dir).select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    got = records.read_records(spark, folder)
    return got.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op9_pack")
def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return got.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op8_jaccard_join")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(documents(spark, sf_dir).select("doc_id", "text"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.chained(documents(spark, sf_dir).select("doc_id", "text"))


@query("op2_suffix_tree")
def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return suffix_tree.score(documents(spark, sf_dir), held)


@query("op3_chat_format", sql.CHAT_FORMAT)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op12_resample", sql.RESAMPLE)
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


@query("op11_conversation_trie", sql.CONVERSATION_TRIE)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op13_secret_scan")
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"),
    )
