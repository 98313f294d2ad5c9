"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order, a short prefix of all pivots. Nearness is taken in units of what is usual for
the pivot (mean and deviation of its distances to the sample), else central pivots would be near to everything and their files long. Rows are dealt to blocks of a bounded number
of rows; in each block every pivot has an inverted file of the rows that list it, with the place where they do. A
query reads the files of its own pivots only, which gives the footrule distance of the orders (a pivot that one order lacks counts as
just behind its end) to the rows that share one; the least footrules of the block are reranked by the exact
Euclidean distance. Equal vectors of a block are one entry with many ids.

With 512 pivots and orders of 16 a query reads 16 files with 16 / 512 of the block's rows each: half a posting a row, and
nothing of rows that share no pivot. Each row is shuffled once, and each block is indexed once: a task gets the
rows of a block first and then its queries, as a stream of batches, so that it holds one block whatever the number of queries.
The stated queries go to every block, and each block answers with its nearest.

The pivots come from a bounded sample; every row is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import prepared

#: Rows of a block.
BLOCK_ROWS = 8_192


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array<float> if it is one, else array<double>) of rows with an id and a finite vector that is not zero."""
    narrow = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(vector_col) if narrow else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.where(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


class Pivots:
    """At most n pivots spread over a sample, and what distances are usual for each."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        self.at = spread_out(sample, n)
        d = self.distances(sample)
        self.mean, self.dev = (d.mean(0), np.maximum(d.std(0), 1e-12)) if len(sample) else (np.zeros(0), np.zeros(0))

    def __len__(self) -> int:
        return len(self.at)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (self.at**2).sum(1) - 2 * (x @ self.at.T), 0))


def choose_pivots(rows: DataFrame, pivots: int, sample: int) -> Pivots:
    """Pivots spread over a sample of at most sample rows (those of least hash), of its commonest dimension."""
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(sample).collect()
    sizes = [len(r["v"]) for r in drawn]
    size = max(sorted(set(sizes)), key=sizes.count) if sizes else 0
    distinct = dict.fromkeys(tuple(r["v"]) for r in drawn if len(r["v"]) == size)
    return Pivots(np.array([*distinct], np.float64).reshape(len(distinct), size), pivots)


def spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, none much nearer to another than is usual, so a dense group does not take most of them.

    Rows are taken in turn if they keep half the median distance; should those be too few, then the farthest ones left."""
    if len(x) <= n:
        return x
    some = x[:: max(1, len(x) // 256)]
    gap = 0.5 * np.median(np.sqrt(np.maximum(((some[:, None] - some[None]) ** 2).sum(-1), 0)))
    near = np.full(len(x), np.inf)
    taken: list[int] = []

    def take(i: int) -> None:
        taken.append(i)
        np.minimum(near, np.sqrt(((x - x[i]) ** 2).sum(1)), out=near)

    for i in range(len(x)):
        if len(taken) < n and near[i] >= gap:
            take(i)
    while len(taken) < n:
        take(int(near.argmax()))
    return x[taken]


def orders(x: np.ndarray, pivots: Pivots, length: int) -> np.ndarray:
    """The length nearest pivots of each row of x, nearest first, ties to the smaller pivot."""
    return np.argsort((pivots.distances(x) - pivots.mean) / pivots.dev, axis=1, kind="stable")[:, :length].astype(np.int32)


class InvertedFiles:
    """For each pivot the entries that list it and the places where they do."""

    def __init__(self, order: np.ndarray, pivots: int) -> None:
        self.n, self.length = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.entry = (by // self.length).astype(np.int32)
        self.place = (by % self.length).astype(np.int32)
        self.first = np.searchsorted(flat[by], np.arange(pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of one order to all entries, less a constant."""
        behind = self.length  # places count from 0, so this is just behind the end
        parts = [slice(self.first[p], self.first[p + 1]) for p in order]
        entry = np.concatenate([self.entry[s] for s in parts])
        place = np.concatenate([self.place[s] for s in parts])
        own = np.repeat(np.arange(self.length, dtype=np.int32), [s.stop - s.start for s in parts])
        return np.bincount(entry, np.abs(own - place) - (behind - own) - (behind - place), minlength=self.n)


class Block:
    """The index of a block's rows; ids ascend."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: Pivots, length: int) -> None:
        _, at, inverse = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
        self.by = np.argsort(inverse, kind="stable")
        self.begin = np.searchsorted(inverse[self.by], np.arange(len(at) + 1))
        self.ids, self.entries, self.pivots, self.length = ids, x[at], pivots, length
        self.files = InvertedFiles(orders(self.entries, pivots, length), len(pivots))

    def search(self, qids: np.ndarray, q: np.ndarray, rerank: int, k: int) -> dict[str, list]:
        """The k nearest found for each query."""
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        begin, ids, by = self.begin, self.ids, self.by
        for qid, vector, order in zip(qids.tolist(), q, orders(q, self.pivots, self.length)):
            far = self.files.footrule(order)
            near = np.argpartition(far, rerank - 1)[:rerank] if rerank < len(far) else np.arange(len(far))
            score = np.sqrt(((self.entries[near] - vector) ** 2).sum(1))
            if len(score) > k + 1:  # of each entry the k + 1 least ids are enough, the query's own among them
                worst = np.partition(score, k)[k]
                near, score = near[score <= worst], score[score <= worst]
            found = [(s, i) for e, s in zip(near.tolist(), score.tolist()) for i in ids[by[begin[e] : min(begin[e + 1], begin[e] + k + 1)]].tolist() if i != qid]
            for s, i in sorted(found)[:k]:
                out["query_id"].append(qid)
                out["vec_id"].append(i)
                out["score"].append(s)
        return out


def arrays(batches: list[pa.RecordBatch], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending and each once (its least vector), and vectors of batches (vec_id, v)."""
    ids = np.concatenate([b.column(0).to_numpy() for b in batches])
    x = np.concatenate([b.column(1).flatten().to_numpy() for b in batches]).astype(np.float64).reshape(len(ids), size) + 0.0  # no -0.0, so equal vectors have equal bytes
    by = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[by], x[by]
    first = np.append(True, ids[1:] != ids[:-1])
    return ids[first], np.ascontiguousarray(x[first])


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 10, pivots: int = 512, length: int = 16, rerank: int = 3_400, pivot_sample: int = 2_048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest vectors found for each query, nearest first, ties to the smaller vec_id.

    Args:
        length: pivots of an order; a row is posted in that many files, a query reads that many.
        rerank: entries of each block of BLOCK_ROWS rows whose exact distance is measured.
        pivot_sample: rows that the driver sees to choose pivots.

    A query is no neighbour of itself, nor of rows with its id. Rows without an id, or with a null, zero, empty or
    not finite vector, take no part; nor do vectors of another dimension than the pivots, which have no distance to the others. Repeated
    ids count once (their least vector). Fewer candidates than k: all of them. Empty tables give an empty result."""
    spark = prepared(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    chosen = choose_pivots(rows, pivots, pivot_sample)
    length, size = min(length, max(len(chosen), 1)), chosen.at.shape[1]
    asked = usable(queries, id_col, vector_col)
    rows, asked = (x.where(F.size("v") == F.lit(size)) for x in (rows, asked))
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    left = rows.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches):
        held: list[pa.RecordBatch] = []
        at, index = -1, None
        for batch in batches:
            what = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(what, prepend=-1))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(what)]):
                block, kind = divmod(int(what[a]), 2)
                part = pa.RecordBatch.from_arrays([c.slice(a, z - a) for c in batch.columns[2:]], names=["vec_id", "v"])
                if block != at:
                    at, index, held = block, None, []
                if kind == 0:
                    held.append(part)
                    continue
                if index is None and held:
                    index, held = Block(*arrays(held, size), chosen, length), []
                if index is not None:
                    yield pa.RecordBatch.from_pydict(index.search(*arrays([part], size), rerank, k), schema=schema)

    dealt = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", "kind", "vec_id")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
