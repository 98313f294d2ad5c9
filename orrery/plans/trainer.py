"""Distributed training and scoring.

A step over a large batch is one Spark job: every task reduces its rows to one (gradient, loss, count) message inside an Arrow kernel, messages
are summed element by element with a partial aggregate, and the driver, which owns the parameters,
updates them. What reaches the driver is as long as the parameter vector, whatever the data or the cluster.
Batches that one task would work on anyway are taken q_super at a time (W10): one job, whose task gets the superbatch in the order of
its batches as a stream and makes an update after each, so it holds one batch.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.indexing import batch_of, dense_index, permute, random_key, shard_bounds
from ..operators.splitting import draw_key, minibatch
from ..operators.stats import NoValidRows
from .experiment import TrainConfig
from .network import Network
from .optimiser import Schedule, Sgd, scaled_lr
from .session import drop_folder, work_folder
from .stopping import EarlyStop

#: Rows of a file of a batch: the tasks of a step.
BATCH_FILE_ROWS = 1 << 16


def matrix_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Features (rows by width, float64) and labels of a batch of (features, label)."""
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)
    return x, batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)


@dataclass
class Message:
    """Sums over rows."""

    gradient: np.ndarray
    sse: float
    dead: float
    n: int
    io_time: float = 0.0
    compute_time: float = 0.0
    tasks: int = 0


def reduced(df: DataFrame, network: Network, theta: np.ndarray) -> Message:
    """The message over all rows of df (features, label)."""
    size = network.size

    def body(batches):
        total, n, spent, began = np.zeros(size + 2), 0, 0.0, time.monotonic()
        for batch in batches:
            if batch.num_rows:
                start = time.monotonic()
                x, y = matrix_of(batch, network.n_in)
                gradient, sse, dead = network.sums(theta, x, y)
                total += np.concatenate([gradient, [sse, dead]])
                n += batch.num_rows
                spent += time.monotonic() - start
        rest = [n, time.monotonic() - began - spent, spent, 1]
        yield pa.RecordBatch.from_pydict({"v": pa.array([np.concatenate([total, rest])], pa.list_(pa.float64()))})

    parts = df.select("features", "label").mapInArrow(body, "v array<double>")
    sums = parts.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    v = np.zeros(size + 6)
    for r in sums:
        v[r["i"]] = r["x"]
    return Message(v[:size], float(v[size]), float(v[size + 1]), round(v[size + 2]), float(v[size + 3]), float(v[size + 4]), round(v[size + 5]))


def batches(index: Column, n: int, config: TrainConfig, epoch: int) -> Column:
    """The batch of each row of 0..n-1 in an epoch, by arithmetic on the index; batches are numbered from 0.

    'affine' (W9, W12): batch * workers rows in a row of one permutation of all rows, drawn anew each epoch;
    'block' (W8): in each of workers shards, blocks of batch consecutive rows in an order drawn anew each epoch, one of each shard a step;
    'local' (W7): in each of workers shards, its rows permuted (alike in every epoch) and cut into batches, one of each shard a step."""
    if config.shuffle == "affine":
        a, b = config.key or random_key(n, config.seed + epoch)
        return batch_of(permute(index, n, a, b), config.batch * config.workers)
    if config.shuffle not in ("block", "local"):
        raise ValueError(f"unknown shuffle {config.shuffle!r}; known: affine, block, local")
    out = F.lit(None).cast("long")
    for w, (lo, hi) in enumerate(shard_bounds(n, config.workers)):
        if hi == lo:
            continue
        place = index - F.lit(lo)
        if config.shuffle == "local":
            a, b = random_key(hi - lo, w + 12_345)
            own = batch_of(permute(place, hi - lo, a, b), config.batch)
        else:
            blocks = -(-(hi - lo) // config.batch)
            a, b = random_key(blocks, config.seed + 100 * epoch + w)
            own = permute(batch_of(place, config.batch), blocks, a, b)
        out = F.when((index >= lo) & (index < hi), own).otherwise(out)
    return out


def super_steps(df: DataFrame, network: Network, theta: np.ndarray, optimiser: Sgd, lr: float, decay: float) -> list[dict]:
    """An update after each batch of df (batch, row_idx, features, label), in the order of batches, in one task: k, n, sse, penalty, norm
    of each, and after the last theta and velocity."""
    velocity, momentum, clip = optimiser.velocity, optimiser.momentum, optimiser.clip

    def body(parts):
        at, own = theta, Sgd(momentum, clip, velocity)
        k, sums, n = None, np.zeros(network.size + 2), 0

        def step():
            nonlocal at, sums, n
            loss, slope = network.penalty(at, decay)
            gradient = sums[:-2] / n + slope
            row = {"k": k, "n": n, "sse": sums[-2], "penalty": loss, "norm": float(np.linalg.norm(gradient))}
            at = own.step(at, gradient, lr)
            sums, n = np.zeros(network.size + 2), 0
            return row

        rows = []
        for part in parts:
            which = part.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else []
            for a, z in zip(cuts, [*cuts[1:], len(which)]):
                if k is not None and which[a] != k:
                    rows.append(step())
                k = int(which[a])
                x, y = matrix_of(part.slice(a, z - a).select([1, 2]), network.n_in)
                gradient, sse, dead = network.sums(at, x, y)
                sums, n = sums + np.concatenate([gradient, [sse, dead]]), n + len(y)
        if k is not None:
            rows.append(step())
            none = [None] * (len(rows) - 1)
            columns = {c: [r[c] for r in rows] for c in rows[0]}
            yield pa.RecordBatch.from_pydict({**columns, "theta": [*none, at], "velocity": [*none, own.velocity]}, schema=pa.schema([("k", pa.int64()), ("n", pa.int64()), *[(c, pa.float64()) for c in ("sse", "penalty", "norm")], *[(c, pa.list_(pa.float64())) for c in ("theta", "velocity")]]))

    ordered = df.select("batch", "features", "label", "row_idx").repartition(1).sortWithinPartitions("batch", "row_idx").select("batch", "features", "label")
    steps = ordered.mapInArrow(body, "k long, n long, sse double, penalty double, norm double, theta array<double>, velocity array<double>").collect()
    return sorted((r.asDict() for r in steps), key=lambda r: r["k"])


def scored(df: DataFrame, network: Network, theta: np.ndarray, name: str = "prediction") -> DataFrame:
    """M4 over any frame with features and row_idx: row_idx, label, prediction; an Arrow kernel, no shuffle."""

    def body(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = matrix_of(batch.select([1, 2]), network.n_in)
                yield pa.RecordBatch.from_pydict({"row_idx": batch.column(0), "label": y, name: network.forward(theta, x)})

    return df.select(F.col("row_idx").cast("long"), "features", F.col("label").cast("float")).mapInArrow(body, f"row_idx long, label double, {name} double")


def rmse(df: DataFrame, network: Network, theta: np.ndarray) -> float:
    """NaN over no rows."""
    row = scored(df, network, theta).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), F.lit(2.0)))).first()
    return math.nan if row[0] is None else math.sqrt(row[0])


@dataclass
class Trainer:
    """fit() in one of the modes

    * 'full_batch': one update each epoch from all rows; stops on training loss, tested before the update;
    * 'sampled': one update each epoch from a sample of `batch` rows of each of `workers` shards;
    * 'minibatch': one update for each global batch of batch * workers rows, dealt as config.shuffle says (batches).
    """

    network: Network
    config: TrainConfig = field(default_factory=TrainConfig)
    theta: np.ndarray | None = None
    history: list[dict] = field(default_factory=list)
    steps: list[dict] = field(default_factory=list)
    stop_reason: str = ""
    stop: EarlyStop = field(default_factory=EarlyStop)
    times: dict[str, float] = field(default_factory=dict)

    def get_params(self) -> np.ndarray:
        return self.theta.copy()

    def set_params(self, theta: np.ndarray) -> None:
        self.network.unpack(theta)
        self.theta = np.array(theta, np.float64)

    def fit(self, train: DataFrame, test: DataFrame | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> "Trainer":
        """train and test: row_idx, features, label. transform is applied to both first (U1). For batches of one size row_idx should be dense (operators.indexing.dense_index); else it is numbered anew."""
        epochs = {"full_batch": self._full_batch, "sampled": self._sampled, "minibatch": self._minibatch}
        c = self.config
        if c.mode not in epochs:
            raise ValueError(f"unknown mode {c.mode!r}; known: {', '.join(epochs)}")
        train, test = [d.transform(transform) if transform and d is not None else d for d in (train, test)]
        if self.theta is None:
            self.theta = self.network.init(c.seed, c.init)
        train = train.select("row_idx", "features", "label").persist(StorageLevel.MEMORY_AND_DISK)
        n, last = train.agg(F.count("*"), F.max("row_idx")).first()
        if not n:
            raise NoValidRows("no rows to train on")
        if c.mode == "minibatch" and last != n - 1:
            train = dense_index(train.withColumnRenamed("row_idx", "row__"), ["row__"]).drop("row__").select("row_idx", "features", "label")
        schedule = Schedule(c.lr, scaled_lr(c.lr, c.workers, c.lr_scaling), c.epochs, c.warmup, c.schedule, c.step_size, c.gamma)
        self.stop = EarlyStop(c.patience, c.tolerance if c.mode == "full_batch" else c.min_delta)
        optimiser = Sgd(c.momentum, c.clip)
        self.stop_reason = "epochs"
        try:
            for epoch in range(1, c.epochs + 1):
                began, lr = time.monotonic(), schedule.at(epoch)
                self.times = {"io_time_sum": 0.0, "compute_time_sum": 0.0, "comm_time_sum": 0.0}
                loss, norm, update = epochs[c.mode](train, n, epoch, lr, optimiser)
                if c.mode == "full_batch":  # tested before the update, which is then not made
                    ended = self.stop.update(epoch, loss)
                    if not ended:
                        update()
                    error = rmse(test, self.network, self.theta) if test is not None else math.nan
                else:
                    error = rmse(test, self.network, self.theta) if test is not None else math.nan
                    ended = self.stop.update(epoch, loss if test is None else error)
                self.history.append({"epoch": epoch, "loss": loss, "test_rmse": error, "lr": lr, "time": time.monotonic() - began, "grad_norm": norm, **self.times})
                if ended:
                    self.stop_reason = "no improvement"
                    break
        finally:
            train.unpersist()
        return self

    def _reduced(self, df: DataFrame) -> Message:
        """reduced, with its times added to the epoch's (A10). What a job takes beside its tasks' mean is communication."""
        began = time.monotonic()
        m = reduced(df, self.network, self.theta)
        self.times["io_time_sum"] += m.io_time
        self.times["compute_time_sum"] += m.compute_time
        self.times["comm_time_sum"] += max(0.0, time.monotonic() - began - (m.io_time + m.compute_time) / max(m.tasks, 1))
        return m

    def _mean(self, m: Message) -> tuple[float, np.ndarray]:
        loss, own = self.network.penalty(self.theta, self.config.weight_decay)
        return 0.5 * m.sse / m.n + loss, m.gradient / m.n + own

    def _apply(self, gradient: np.ndarray, lr: float, optimiser: Sgd) -> None:
        self.theta = optimiser.step(self.theta, gradient, lr)

    def _full_batch(self, train: DataFrame, n: int, epoch: int, lr: float, optimiser: Sgd):
        loss, gradient = self._mean(self._reduced(train))
        return loss, float(np.linalg.norm(gradient)), lambda: self._apply(gradient, lr, optimiser)

    def _sampled(self, train: DataFrame, n: int, epoch: int, lr: float, optimiser: Sgd):
        sharded = train.withColumn("shard", F.pmod(draw_key(F.col("row_idx"), self.config.seed), F.lit(self.config.workers)))
        drawn = minibatch(sharded, "shard", self.config.batch, epoch=epoch, seed=self.config.seed)
        loss, gradient = self._mean(self._reduced(drawn))
        self._apply(gradient, lr, optimiser)
        return loss, float(np.linalg.norm(gradient)), None

    def _minibatch(self, train: DataFrame, n: int, epoch: int, lr: float, optimiser: Sgd):
        """One shuffle an epoch writes a folder for each superbatch (or, of large batches, for each batch); a job reads its own folder only."""
        c, size = self.config, self.config.batch * self.config.workers
        at_once = c.q_super if size <= BATCH_FILE_ROWS else 1
        dealt = train.withColumn("batch", batches(F.col("row_idx"), n, c, epoch)).withColumn("super", F.floor(F.col("batch") / at_once))
        steps = -(-n // size) if c.shuffle == "affine" else max(-(-(hi - lo) // c.batch) for lo, hi in shard_bounds(n, c.workers))
        files = max(1, -(-size * at_once // BATCH_FILE_ROWS))
        spark, path = train.sparkSession, work_folder(train.sparkSession, f"epoch-{epoch}")
        total, seen, first = 0.0, 0, math.nan

        def done(k: int, sse: float, rows: int, penalty: float, norm: float) -> None:
            nonlocal total, seen, first
            first = norm if math.isnan(first) else first
            total, seen = total + 0.5 * sse + penalty * rows, seen + rows
            if k % c.log_every == 0:
                self.steps.append({"k": k, "train_rmse": math.sqrt(sse / rows), "lr": lr})

        try:
            if steps > at_once:
                dealt.repartition("super", F.pmod("row_idx", F.lit(files))).write.partitionBy("super").parquet(path)
                schema = dealt.drop("super").schema
                parts = (spark.read.schema(schema).parquet(f"{path}/super={i}") for i in range(-(-steps // at_once)))
            else:
                parts = iter([dealt])
            for i, part in enumerate(parts):
                if at_once > 1:
                    began = time.monotonic()
                    rows = super_steps(part, self.network, self.theta, optimiser, lr, c.weight_decay)
                    self.times["compute_time_sum"] += time.monotonic() - began
                    for r in rows:
                        done(r["k"], r["sse"], r["n"], r["penalty"], r["norm"])
                    self.theta, optimiser.velocity = (np.array(rows[-1][x]) for x in ("theta", "velocity"))
                else:
                    m = self._reduced(part)
                    _, gradient = self._mean(m)
                    done(i, m.sse, m.n, self.network.penalty(self.theta, c.weight_decay)[0], float(np.linalg.norm(gradient)))
                    self._apply(gradient, lr, optimiser)
        finally:
            drop_folder(spark, path)
        return total / max(seen, 1), first, None
