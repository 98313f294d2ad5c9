"""Exact splits, samples and shuffles (W2-W4, W6, W7). Every draw is a function of the row index and a key, never of the partitioning."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import SEED, TEST_RATIO
from .indexing import batch_of, permute, prefix_starts, random_key

#: A prime over any batch or shard; keys of draws inside groups are (a * index + b) mod PRIME.
PRIME = 2_147_483_647
#: Multipliers stay under this, so the product with an index under 2**43 is exact.
MULTIPLIER = 1_000_003
#: Draws of a range in epoch_batches: some 2,000 ranges a shard.
RANGE = 1 << 20


def draw_key(index: Column, seed: int) -> Column:
    """A pseudo-random order of rows from their index and a seed; the same in any engine with 64-bit integers."""
    a = 1 + (seed * 7_919 + 104_729) % MULTIPLIER
    return F.pmod(F.pmod(index, F.lit(PRIME)) * F.lit(a) + F.lit(seed * 15_485_863 % PRIME), F.lit(PRIME))


def exact_split(df: DataFrame, n: int, *, ratio: float = TEST_RATIO, seed: int = SEED, key: tuple[int, int] | None = None, rounding: str = "floor", index: str = "row_idx") -> DataFrame:
    """Df with split: exactly floor (or ceil) of ratio * n rows are 'test'. A column expression: no shuffle."""
    a, b = key or random_key(n, seed)
    size = {"floor": floor, "ceil": ceil}[rounding](ratio * n)
    return df.withColumn("split", F.when(permute(F.col(index), n, a, b) < size, "test").otherwise("train"))


def batch_split(df: DataFrame, batch: Column, *, ratio: float = TEST_RATIO, seed: int = SEED, index: str = "row_idx") -> DataFrame:
    """As exact_split within each batch, so windows hold one batch."""
    by = Window.partitionBy("batch__")
    rank = F.row_number().over(by.orderBy(draw_key(F.col(index), seed), index))
    marked = df.withColumn("batch__", batch).withColumn("rank__", rank).withColumn("size__", F.count("*").over(by))
    return marked.withColumn("split", F.when(F.col("rank__") <= F.floor(F.col("size__") * ratio), "test").otherwise("train")).drop("batch__", "rank__", "size__")


def minibatch(df: DataFrame, shard: str, size: int, *, epoch: int = 0, seed: int = SEED, index: str = "row_idx") -> DataFrame:
    """Size rows of each shard without replacement, all of a smaller shard. Seeds mix epoch and shard, so they do not collide."""
    mixed = F.pmod(draw_key(F.col(index), seed + 31 * epoch) + F.col(shard) * 97_409, F.lit(PRIME))
    rank = F.row_number().over(Window.partitionBy(shard).orderBy(mixed, index))
    return df.withColumn("rank__", rank).where(F.col("rank__") <= size).drop("rank__")


def epoch_batches(df: DataFrame, shard: str, size: int, *, epoch: int = 0, seed: int = 12_345, index: str = "row_idx") -> DataFrame:
    """Df with batch: the rows of each shard shuffled (anew each epoch) and cut into batches.

    Rows are ranked within ranges of their draw and offset by the counts of the ranges before, so no window holds a shard."""
    drawn = df.withColumn("key__", draw_key(F.col(index), seed + epoch)).withColumn("range__", F.floor(F.col("key__") / RANGE))
    counts = drawn.groupBy(shard, "range__").agg(F.count("*").alias("n__"))
    starts = prefix_starts(counts, "range__", "n__", [shard]).select(shard, "range__", F.col("start").alias("start__"))
    own = F.row_number().over(Window.partitionBy(shard, "range__").orderBy("key__", index)) - 1
    placed = drawn.withColumn("own__", own).join(starts, [shard, "range__"])
    return placed.withColumn("batch", batch_of(F.col("own__") + F.col("start__"), size)).select(*df.columns, "batch")
