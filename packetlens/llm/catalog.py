"""Registered queries of the operators for training text."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import workspace
from . import bpe, chat, decontaminate, jaccard, lm, middle, pii, quality, resharding, spelling, substrings, token_counts, toxicity
from .oracles import ORACLES, SAYING

__all__ = ["ORACLES", "QUERIES"]
Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def digest(text) -> Column:
    """Lowercase hex SHA-256 of a string in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def op1_chat(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAYING).alias("text"))
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    segments = chat.format_turns(rows.withColumn("content", chat.text_content(F.col("text"))))
    return chat.conversation_digests(segments)


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op3_resharding(spark: SparkSession, sf: str) -> DataFrame:
    """The documents in shards by source, rewritten to shards of equal bytes; all columns come from the files read back."""
    rule, path = resharding.Resharding(), workspace.fresh(spark, "shards")
    docs = read(spark, sf, "documents")
    docs.withColumn("shard", resharding.old_shard(F.col("source"), rule.shards)).write.partitionBy("shard").parquet(path)
    layout = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType())])
    resharding.rewrite(spark.read.schema(layout).parquet(path), F.col("shard"), path, rule)
    found = spark.read.schema(layout).parquet(path).select(
        "doc_id", resharding.size_of(F.col("text")).alias("size"), resharding.crc_of(F.col("text")).alias("text_crc32"), "shard",
        resharding.old_shard(F.col("source"), rule.shards).alias("old_shard"))
    return resharding.with_slots(workspace.written(found, "shard_rows"), rule).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.fit(docs))
    counts = [F.size(F.expr(f"filter(spans, x -> x.base and x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("row.doc_id", *counts, digest(pii.named("spans", True)).alias("base_sha256"), pii.named("spans", False).alias("spans"))


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    cuts = workspace.written(quality.cutoffs(docs, read(spark, sf, "labels")), "quality_cutoffs")
    return quality.judge(docs, cuts).select(
        "row.doc_id", *[f"measures.{m}" for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept")


def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.decode(bpe.encode(read(spark, sf, "documents").select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    ids = F.col("token_ids")
    return coded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), bpe.ids_digest(ids).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"))


def op7_repeats(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.drop_repeats(read(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", digest(F.col("kept_text")).alias("kept_sha256"))


def op8_masked_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return lm.score_by_words(docs, lm.fit(docs)).select(
        "doc_id", "n_words", F.round("log_likelihood", 6).alias("log_likelihood"), F.round("per_word", 9).alias("per_word"))


def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf, "documents"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf, "labels")))


def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    rule = middle.FillInMiddle()
    found = middle.fill_in_middle(read(spark, sf, "documents").select("doc_id", "text"), rule)
    return found.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(middle.restored(F.col("output"), F.col("form"), rule)).alias("restored_sha256"))


def op12_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    tokenizer = token_counts.Tokenizer.load(public_tokenizers.path("byte_bpe_50k.json"))
    found = token_counts.count_tokens(read(spark, sf, "documents"), tokenizer)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(read(spark, sf, "documents"), spelling.Spelling(drop_every=31)).select(
        "word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Query] = {
    "op1_chat": op1_chat,
    "op2_decontamination": op2_decontamination,
    "op3_resharding": op3_resharding,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_repeats": op7_repeats,
    "op8_masked_lm": op8_masked_lm,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_counts": op12_token_counts,
    "op13_spelling": op13_spelling,
}
