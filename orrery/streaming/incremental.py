"""Incremental variants: statistics and training over files as they arrive (bounded memory, one pass, restartable)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def stream_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet file or folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def running_stats(stream: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A1, A2, N8 as a streaming aggregate: n_rows, and min and max of the columns, by keys. State is one row a key."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, keys: Sequence[str] = ()) -> DataFrame:
    """Event-time counts by tumbling window; rows later than late are dropped with their window's state."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n_rows"))


def drained(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming aggregate over all that is there now; its result as a table."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def for_each_batch(stream: DataFrame, act: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Hands every micro-batch that is there now to act (train on it, write it): at least once, in order."""
    query = stream.writeStream.foreachBatch(lambda df, _: act(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
