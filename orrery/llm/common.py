"""Shared pieces of the corpus operators: bounded Arrow batches, word hashing, checkpoints.

Conventions that hold for every operator of this subpackage:

* only the columns an operator names are read, under private names, so extra columns
  with clashing names are harmless;
* a null ``doc_id`` is an identifier of its own that sorts before every other one and is
  given back as null; a null text is a text without words;
* an empty table gives an empty result with the same schema;
* Arrow batches are bounded by rows and by bytes, and a batch holds one text at least: a task's memory is a
  multiple of the batch bound or of the longest text, whichever is more.
"""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Stands for a null id inside the operators.
NULL_ID = -(2**63)
#: Where a session on one machine (tests, notebooks) names no checkpoint folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/orrery"
#: Slots of the broadcast filters: the bound of their rows.
SLOTS = 1 << 20
#: What ``[^\x20\x09-\x0D]+`` leaves out.
SPACES = "\\x20\\x09-\\x0D"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def prepared(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches and makes sure checkpoint() has a folder.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local master gets a local
    folder; on a cluster that would lose checkpoints with their executors, so there it is an error."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or LOCAL_CHECKPOINTS)
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def internal_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def external_id(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != F.lit(NULL_ID), column)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def content_of(text_col: str) -> Column:
    """64 bits that stand for a text; null is empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def slot(key: Column) -> Column:
    return F.pmod(key, F.lit(SLOTS)).cast("int")


def bits(key: Column, n: int) -> Column:
    """A number below n (a power of two) from bits of the key that its slot does not use."""
    return F.shiftrightunsigned(key, 40).bitwiseAND(F.lit(n - 1)).cast("int")


def bit_filter(keys: DataFrame, key: Column, limit: Column | None = None) -> DataFrame:
    """at__, mask__, limit__ (the greatest limit of the slot): which of 64 bits of each slot have a key."""
    marked = keys.select(slot(key).alias("at__"), F.call_function("shiftleft", F.lit(1).cast("long"), bits(key, 64)).alias("mask__"), (F.lit(0) if limit is None else limit).alias("limit__"))
    return marked.groupBy("at__").agg(F.bit_or("mask__").alias("mask__"), F.max("limit__").alias("limit__"))


def passing(rows: DataFrame, key: Column, filter: DataFrame, *, others: bool = False, keep: bool = False) -> DataFrame:
    """The rows whose key may be in the filter, or (others) all other rows; keep: with limit__."""
    joined = rows.join(F.broadcast(filter), slot(key) == F.col("at__"), "left" if others else "inner")
    inside = F.getbit("mask__", bits(key, 64)) == 1
    joined = joined.where(~F.coalesce(inside, F.lit(False))) if others else joined.where(inside)
    return joined.drop("at__", "mask__") if keep else joined.drop("at__", "mask__", "limit__")


def release_memory() -> None:
    """Gives freed memory back to the system. Spark keeps a Python worker for later tasks, which then hold what this one needed at most."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def hash_words(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(a: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    a = (a ^ (a >> np.uint64(30))) * _MIX2
    return a ^ (a >> np.uint64(27))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two sequences put one after the other, from the hashes of both."""
    return mixed(a * _MIX + b)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n entries of words, by doubling: log2(n) passes whatever n is."""
    if len(words) < n:
        return words[:0]
    out, have, power, size = None, 0, words, 1
    while True:
        if n & size:
            out = power if out is None else joined(out[: len(words) - have - size + 1], power[have : len(words) - size + 1])
            have += size
            if have == n:
                return out
        power = joined(power[: len(power) - size], power[size:])
        size *= 2


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)
