"""The corpus operators as queries over the tables of a folder, with production parameters."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bitsliced_simhash, chat_snapshots, disclosure_pii, family_langid, gumbel_segmenter, line_frequency, permutation_index, raking, rlz_dedup, token_counts
from .common import documents


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet"))
    return permutation_index.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op2_gumbel_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel_segmenter.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), with_text=True)


def op3_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raking.mix(documents(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("probability", "weight")})


def op4_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.collapse(spark.read.parquet(os.path.join(sf_dir, "conversations.parquet")))


def op5_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure_pii.spans(documents(spark, sf_dir))


def op6_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality(documents(spark, sf_dir))


def op7_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family_langid.identify(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced_simhash.near_duplicates(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.remove_repeats(documents(spark, sf_dir), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {f.__name__: f for f in (op1_permutation_index, op2_gumbel_segmentation, op3_raked_mixture, op4_chat_snapshots, op5_disclosure_pii, op6_line_frequency_quality, op7_hierarchical_langid, op8_token_counts, op9_simhash_near_dedup, op10_substring_dedup)}
ORACLES: dict[str, str] = {"op3_raked_mixture": raking.ORACLE, "op4_chat_snapshots": chat_snapshots.ORACLE, "op5_disclosure_pii": disclosure_pii.ORACLE, "op6_line_frequency_quality": line_frequency.ORACLE, "op10_substring_dedup": rlz_dedup.ORACLE}
