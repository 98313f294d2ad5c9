"""Experiment grids."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class TrainConfig:
    """The settings of a training run.

    shuffle is that of mode 'minibatch': 'affine', 'block' or 'local' (plans.trainer.batches); key fixes the multiplier and shift of the
    affine permutation, which else are drawn anew each epoch. q_super batches are read at once."""

    mode: str = "minibatch"
    activation: str = "leaky_relu"
    hidden: int = 64
    batch: int = 32_768
    q_super: int = 30
    workers: int = 1
    epochs: int = 10
    lr: float = 1e-3
    lr_scaling: str = "sqrt"
    schedule: str = "cosine"
    warmup: int = 5
    step_size: int = 10
    gamma: float = 0.5
    momentum: float = 0.9
    weight_decay: float = 1e-5
    clip: float | None = 1.0
    patience: int = 3
    min_delta: float = 1e-6
    tolerance: float = 1e-9
    shuffle: str = "affine"
    key: tuple[int, int] | None = None
    init: str = "auto"
    seed: int = 2025
    log_every: int = 10


def grid(spark: SparkSession, choices: Mapping[str, Sequence]) -> DataFrame:
    """The product of the choices; the driver names a handful of values, Spark multiplies them."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in choices.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out


def super_batches(batch: Column, rows: int = 1_000_000, most: int = 128) -> Column:
    """Rows over batch, whole, from 1 to most."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(rows) / batch))).cast("int")


def run_name(columns: Sequence[str], first: str = "mpi_processes") -> Column:
    """Key-value pairs joined by '__', first before the rest, the rest by name."""
    order = [c for c in columns if c == first] + sorted(c for c in columns if c != first)
    return F.concat_ws("__", *[F.concat(F.lit(f"{c}-"), F.col(c).cast("string")) for c in order])


def pending(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs that have no successful result yet."""
    return runs.join(results.where("success").select("name"), "name", "left_anti")


def tally(results: DataFrame) -> DataFrame:
    """X5."""
    return results.agg(F.count("*").alias("n_runs"), F.count_if("success").alias("n_success"), F.sum("time").alias("total_time"))


def run_all(runs: DataFrame, results: DataFrame, run: Callable[[dict], float], limit_s: float = 3600.0) -> DataFrame:
    """Each pending run once, in order of name; a failure or an overlong run is a result, not an end. name, success, time, value, error.

    A run over limit_s has its Spark jobs cancelled, which ends it."""
    spark, out = runs.sparkSession, []
    context = spark.sparkContext
    for config in sorted((r.asDict() for r in pending(runs, results).collect()), key=lambda c: c["name"]):
        began, group = time.monotonic(), f"run-{uuid.uuid4().hex}"
        context.setJobGroup(group, config["name"], interruptOnCancel=True)
        over = threading.Event()

        def end(group: str = group, over: threading.Event = over) -> None:
            over.set()
            while over.is_set():  # a run that starts another job is cancelled again
                context.cancelJobGroup(group)
                time.sleep(0.2)

        timer = threading.Timer(limit_s, end)
        timer.daemon = True
        timer.start()
        try:
            value, error = float(run(config)), ""
        except Exception as e:  # noqa: BLE001 a run may fail in any way
            value, error = None, f"{type(e).__name__}: {e}"
        finally:
            timer.cancel()
            late = over.is_set()
            over.clear()
            context.setLocalProperty("spark.jobGroup.id", None)
        took = time.monotonic() - began
        if late or took > limit_s:
            value, error = None, "over the time limit"
        out.append((config["name"], not error, took, value, error))
    return spark.createDataFrame(out, "name string, success boolean, time double, value double, error string")
