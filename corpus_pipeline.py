"""Corpus pipeline: quality rules, near-dedup, PII, source mixing, SentencePiece sampling.

Each stage works on all rows that its predecessor kept, is written as Parquet and read again as the next
one's input, so a lost executor costs no more than the stage at work. All but the last keep the columns of documents.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import bitsliced_simhash, disclosure_pii, gumbel_segmenter, line_frequency, raking
from orrery.llm.common import documents, prepared


def counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and so do lines above their host's limit."""
    return counted(line_frequency.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of texts whose 5-word shingles are 0.8 similar; SimHash finds the candidates."""
    return bitsliced_simhash.one_per_similar_group(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, terms that disclose it are generalised or removed."""
    return counted(disclosure_pii.sanitise(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to raked source, language and topic weights."""
    return raking.mixed_documents(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with ids."""
    return gumbel_segmenter.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("sentencepiece", segmentation)]
#: SQL has neither the hashes nor the sampler; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. Tables between them go under the shared checkpoint folder, each until the next is whole;
    the last one is what is returned, and stays."""
    prepared(spark)
    folder = os.path.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        at = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if i:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
