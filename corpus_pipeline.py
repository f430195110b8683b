"""Corpus pipeline: toxic documents go, one of near copies stays, repeated passages and benchmark items go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Each begins with executors that have given back what the stage before it
left in their heaps.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from swellframe.llm import decontam, near_copies, packing, suffix_array, toxicity
from swellframe.llm.common import rested, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    rested(spark)
    return toxicity.not_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word Jaccard similarity 0.8, proposed by a search of SimHash fingerprints in vantage-point trees) the document with the smallest doc_id stays."""
    rested(spark)
    return near_copies.first_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are removed from the texts."""
    rested(spark)
    return suffix_array.without_repeated_strings(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    rested(spark)
    return decontam.without_contained(docs, _table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it."""
    rested(spark)
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack_sequences),
]
#: Stages 1, 2, 3 and 5 are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force (the toxic documents are those that
#: `toxicity.scores` predicts, whose accuracy on held-out rows is tested apart).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
