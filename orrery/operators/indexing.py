"""Dense row numbers, shards, permutations and batches (A4, W1, W5, W8-W12): arithmetic on the index wherever it can be."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.session import prepared


#: Keys of a stretch in two-level prefix sums.
STRETCH = 4096


def prefix_starts(sizes: DataFrame, key: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """sizes with start: the exclusive prefix sum of n in the order of the whole number key, for each by.

    Sums run within stretches of keys and over the totals of the stretches, so no window holds all keys."""
    rows = sizes.withColumn("stretch__", F.floor(F.col(key) / STRETCH))
    inside = Window.partitionBy(*by, "stretch__").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*by).orderBy("stretch__").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "stretch__").agg(F.sum(n).alias("total__"))
    before = totals.select(*by, "stretch__", F.coalesce(F.sum("total__").over(over), F.lit(0)).alias("before__"))
    own = rows.withColumn("own__", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return own.join(before, [*by, "stretch__"]).withColumn("start", F.col("own__") + F.col("before__")).drop("stretch__", "own__", "before__")


def chunk_offsets(df: DataFrame, chunk: Column) -> DataFrame:
    """A4: chunk, n_rows, start: exclusive prefix sums of the sizes of numbered chunks."""
    return prefix_starts(df.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n_rows")), "chunk", "n_rows")


def dense_index(df: DataFrame, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """A4: df with its rows numbered 0..N-1 by order, without a window over all rows.

    Rows are range-partitioned and frozen by a checkpoint; a task numbers its own rows, and the offsets, one row
    for each partition (which bounds the broadcast), are added. Rows that tie in order are told apart by a hash of the row, so that
    a value of many rows does not fill one partition."""
    prepared(df.sparkSession)
    tie = F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))])
    frozen = df.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).withColumn("id__", F.monotonically_increasing_id()).checkpoint()
    part, own = F.shiftright("id__", 33), F.col("id__").bitwiseAND(F.lit((1 << 33) - 1))
    starts = chunk_offsets(frozen, part).select(F.col("chunk").alias("chunk__"), F.col("start").alias("start__"))
    return frozen.join(F.broadcast(starts), part == F.col("chunk__")).withColumn(name, (own + F.col("start__")).cast("long")).drop("id__", "chunk__", "start__")


def shard_bounds(n: int, shards: int) -> list[tuple[int, int]]:
    """[lo, hi) of each shard; the first n mod shards are one row longer."""
    size, longer = divmod(n, shards)
    return [(s * size + min(s, longer), (s + 1) * size + min(s + 1, longer)) for s in range(shards)]


def shard_of(index: Column, n: int, shards: int) -> Column:
    """The shard of a row of 0..n-1, by arithmetic."""
    size, longer = divmod(n, shards)
    edge = longer * (size + 1)
    return F.when(index < edge, F.floor(index / (size + 1))).otherwise(longer + F.floor((index - edge) / max(size, 1))).cast("int")


def check_key(a: int, n: int) -> None:
    if n > 0 and gcd(a, n) != 1:
        raise ValueError(f"{a} and {n} have a common divisor, so the map is no permutation")


def permute(index: Column, n: int, a: int, b: int) -> Column:
    """(a * index + b) mod n, a permutation of 0..n-1. The product is exact for any n under 2**63."""
    check_key(a, n)
    a, b = a % n, b % n
    if a * n + b < 1 << 63:
        return F.pmod(index * F.lit(a) + F.lit(b), F.lit(n))
    return F.pmod(index.cast("decimal(19,0)") * F.lit(a).cast("decimal(18,0)") + F.lit(b), F.lit(n).cast("decimal(19,0)")).cast("long")


def unpermute(index: Column, n: int, a: int, b: int) -> Column:
    """The inverse of permute."""
    check_key(a, n)
    back = pow(a, -1, n) if n > 1 else 0
    return permute(index, n, back, -back * b) if n > 1 else index


def random_key(n: int, seed: int) -> tuple[int, int]:
    """A and b of a permutation, drawn from a seed on the driver."""
    import random

    rng = random.Random(seed)
    while gcd(a := rng.randrange(1, max(n, 2)), n) != 1:
        pass
    return a, rng.randrange(max(n, 1))


def batch_of(position: Column, size: int) -> Column:
    """W12."""
    return F.floor(position / size).cast("long")


def block_order(df: DataFrame, size: int, key: Column, index: str = "row_idx") -> DataFrame:
    """Block (of consecutive rows), rank of the block by key, from 1. Blocks are ranked, not rows, and without one window over them all."""
    blocks = df.select(F.floor(F.col(index) / size).alias("block")).distinct().withColumn("key__", key)
    return dense_index(blocks, ["key__", "block"], "rank__").select("block", (F.col("rank__") + 1).cast("int").alias("block_rank"))


#: Physical rows of a stretch in runs.
SPAN = 1 << 16


def runs(df: DataFrame, group: str, physical: str) -> DataFrame:
    """For each group the runs of consecutive physical rows: run (from 1), first, n_rows. What a reader would fetch in one piece.

    A run starts where the row before is not of the group and ends where the next is not, which are joins on single rows; starts and
    ends are numbered by stretches of physical rows, so no window holds a group."""
    rows = df.select(group, F.col(physical).alias("p__")).distinct()

    def edges(step: int, name: str) -> DataFrame:
        beside = rows.select(group, (F.col("p__") + step).alias("p__"))
        found = rows.join(beside, [group, "p__"], "left_anti").withColumn("span__", F.floor(F.col("p__") / SPAN))
        starts = prefix_starts(found.groupBy(group, "span__").agg(F.count("*").alias("n__")), "span__", "n__", [group]).select(group, "span__", F.col("start").alias("start__"))
        own = F.row_number().over(Window.partitionBy(group, "span__").orderBy("p__"))
        return found.withColumn("own__", own).join(starts, [group, "span__"]).select(group, (F.col("own__") + F.col("start__")).alias("run"), F.col("p__").alias(name))

    return edges(1, "first").join(edges(-1, "last__"), [group, "run"]).select(group, "run", "first", (F.col("last__") - F.col("first") + 1).alias("n_rows"))


def inverse_positions(df: DataFrame, group: str, logical: str, physical: str) -> DataFrame:
    """For each row of a group its place in physical order and in logical order, without a join."""
    place = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(c)) - 1
    return df.select("*", place(physical).alias("physical_pos"), place(logical).alias("logical_pos"))


def route(df: DataFrame, split: str = "split", index: str = "row_idx") -> DataFrame:
    """The place of each row within its split, in index order, from dense per-split numbering.

    Offsets are counted for ranges of consecutive rows, so no window holds a whole split."""
    span = F.floor(F.col(index) / (1 << 16))
    sizes = df.groupBy(split, span.alias("span__")).agg(F.count("*").alias("n__"))
    starts = prefix_starts(sizes, "span__", "n__", [split]).select(split, "span__", F.col("start").alias("start__"))
    own = F.row_number().over(Window.partitionBy(split, "span__").orderBy(index)) - 1
    placed = df.withColumn("span__", span).withColumn("own__", own).join(starts, [split, "span__"])
    return placed.withColumn("split_pos", F.col("own__") + F.col("start__")).drop("span__", "own__", "start__")
