"""A cleaning pipeline over a corpus: quality rules, quality classifier, near duplicates, decontamination, BPE ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Rows that share a doc_id are taken as one document: they stay or go together in the stages
that judge by doc_id (near duplicates, decontamination), where rows without an id stay. An
empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm import bloom, decontam, jaccard, knn, rules, tokens
from dqspark.llm.common import table
from dqspark.session import scratch, share_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and whose compression ratios lie in their bands."""
    held = docs.select(F.struct("*").alias("_own"))
    return rules.judge(held, within="_own").where("kept").select("_own.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the nearest labelled ones call good; learns from the labels not held out."""
    model = knn.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held = docs.select(F.struct("*").alias("_own"))
    return knn.score(held, model, within="_own").where("predicted = 1").select("_own.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, similarity of 0.8) the document of least id."""
    groups = jaccard.near_duplicates(docs, jaccard.Similarity(words=5, num=80, den=100))
    return bloom.without(docs, groups.where("doc_id != component_id"), "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    hit = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return bloom.without(docs, hit, "doc_id")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding them gives the text back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = tokens.encode(docs, path, round_trip=True, keep=["doc_id"])
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte bpe", byte_bpe),
]

#: zstandard, the nearest-neighbour model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps lies as Parquet in the shared folder."""
    share_package(spark)
    docs = table(spark, sf_dir, "documents")
    base = scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
