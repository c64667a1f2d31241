"""From raw documents to token ids: the stages of the text pipeline.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``docs``. Stages read what their predecessor kept, which is written in between.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.llm import bpe, decontaminate, jaccard, pii, quality
from packetlens.plans import workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Looser than op9's contract: copies with a changed word in fifty, or with a fifth of text added, are near copies here.
NEAR = jaccard.JaccardJoin(threshold=80, shingle=5, prefix=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram links connect, the one with the smallest doc_id stays; rows without id stay."""
    found = jaccard.near_duplicates(docs, NEAR)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text."""
    out = pii.redacted(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of each document."""
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.encode(docs.select("doc_id", "text"), vocabulary)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding", token_ids),
]

# neither the estimation of labelers, nor LSH, nor BPE can be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    docs = reduce(lambda kept, stage: workspace.written(stage[1](spark, kept, sf_dir), "pipeline_stage"), first, docs)
    return last(spark, docs, sf_dir)
