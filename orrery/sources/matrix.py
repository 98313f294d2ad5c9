"""The dense matrix store (S8-S10): Parquet with features, label and dense row index, partitioned by split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import MATRIX_SCHEMA


def write_matrix(df: DataFrame, path: str) -> None:
    """Rows with row_idx, features, label, split; one sorted shuffle, so a split's files follow the index."""
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in MATRIX_SCHEMA])
    rows.repartitionByRange("split", "row_idx").sortWithinPartitions("split", "row_idx").write.mode("overwrite").partitionBy("split").parquet(path)


def read_matrix(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The store, or one split of it (a partition filter: the other files are not opened)."""
    df = spark.read.schema(MATRIX_SCHEMA).parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def matrix_shape(df: DataFrame) -> DataFrame:
    """For each split rows, width, and whether all rows have that width."""
    size = F.size("features")
    return df.groupBy("split").agg(F.count("*").alias("n_rows"), F.max(size).alias("n_features"), (F.min(size) == F.max(size)).alias("is_regular"))


def stem(path: Column) -> Column:
    """A path without its last extension."""
    return F.regexp_replace(path, r"\.[^./]+$", "")


def store_path(path: Column, part: str, split: str, ext: str = "parquet") -> Column:
    """The place of a part ('X', 'y') of a split beside a source file: its stem, part and split joined by '_', and ext without its dot."""
    return F.concat(stem(path), F.lit(f"_{part}_{split}.{ext.lstrip('.')}"))
