"""Delimited and plain text sources (S1-S7, S16-S18). Spark plans the byte ranges; no row is lost at their edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import HEAD_ROWS, RAW_SCHEMA


def csv_header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names; reads one line."""
    return spark.read.csv(path, header=True, encoding=encoding, enforceSchema=False, samplingRatio=1e-9).columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, *, columns: Sequence[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """The named columns of a headed file, whatever their order and company in it.

    Bad rows become nulls (PERMISSIVE); undecodable bytes become the replacement character; a
    wanted column that the file lacks fails before any work. The parser reads only the columns selected."""
    header = csv_header(spark, path, encoding)
    wanted = list(columns or schema.names)
    if absent := [c for c in wanted if c not in header]:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    kinds = {f.name: f.dataType for f in schema}
    whole = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    return spark.read.csv(path, header=True, schema=whole, encoding=encoding, mode="PERMISSIVE").select(*wanted)


def parse_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Rows of a column of delimited lines."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return lines.select(F.from_csv(column, fields).alias("row")).select("row.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: one row for each line."""
    return spark.read.text(path)


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """S16."""
    return read_lines(spark, path).agg(F.count("*").alias("n_lines"))


def head_sample(df: DataFrame, n: int = HEAD_ROWS, order: str = "row_idx") -> DataFrame:
    """The first n rows by order; a top-n per partition, then one of those."""
    return df.orderBy(order).limit(n)


def offset_sample(df: DataFrame, skip: int, n: int, order: str = "row_idx") -> DataFrame:
    """N rows after the first skip ones; the first n if there are none so far on."""
    there = df.orderBy(order).offset(skip).limit(n)
    return there if not there.isEmpty() else head_sample(df, n, order)


def rows_by_partition(df: DataFrame) -> DataFrame:
    """Rows that each scan task read."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_rows"))


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, the same schema."""
    return df.sparkSession.createDataFrame([], df.schema)
