"""Parameter updates and learning-rate schedules."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def clipped(gradient: np.ndarray, most: float | None) -> np.ndarray:
    """M7: the gradient, scaled down to a norm of at most most."""
    norm = float(np.linalg.norm(gradient))
    return gradient * (most / norm) if most and norm > most else gradient


@dataclass
class Sgd:
    """M6-M8: clip, then heavy-ball momentum; momentum 0 is plain descent."""

    momentum: float = 0.0
    clip: float | None = None
    velocity: np.ndarray | None = field(default=None, repr=False)

    def step(self, theta: np.ndarray, gradient: np.ndarray, lr: float) -> np.ndarray:
        g = clipped(gradient, self.clip)
        self.velocity = g if self.velocity is None or not self.momentum else self.momentum * self.velocity + g
        return theta - lr * self.velocity


def scaled_lr(lr: float, workers: int, how: str = "sqrt") -> float:
    """M9: peak rate for a number of logical workers (a setting, not the cluster's size)."""
    factors = {"none": 1.0, "linear": float(workers), "sqrt": math.sqrt(workers)}
    if how not in factors:
        raise ValueError(f"unknown scaling {how!r}; known: {', '.join(factors)}")
    return lr * factors[how]


@dataclass(frozen=True)
class Schedule:
    """Linear warm-up from lr to peak, then constant, step or cosine (down to lr, as a floor).

    step halves (gamma) every step_size epochs, counted from the end of warm-up or, with step_from_start, from the first epoch."""

    lr: float
    peak: float
    epochs: int
    warmup: int = 0
    kind: str = "cosine"
    step_size: int = 10
    gamma: float = 0.5
    step_from_start: bool = False

    def __post_init__(self) -> None:
        if self.kind not in ("constant", "step", "cosine"):
            raise ValueError(f"unknown schedule {self.kind!r}; known: constant, step, cosine")

    def at(self, epoch: int) -> float:
        """Rate of an epoch, from 1."""
        if epoch <= self.warmup:
            return self.lr + (self.peak - self.lr) * epoch / self.warmup
        if self.kind == "constant":
            return self.peak
        if self.kind == "step":
            return self.peak * self.gamma ** ((epoch if self.step_from_start else epoch - self.warmup) // self.step_size)
        done = (epoch - self.warmup) / max(1, self.epochs - self.warmup)
        return self.lr + 0.5 * (self.peak - self.lr) * (1 + math.cos(math.pi * done))

    def table(self, spark: SparkSession) -> DataFrame:
        """epoch, lr of all epochs, as expressions."""
        e, peak, low = F.col("epoch"), F.lit(self.peak), F.lit(self.lr)
        warm = low + (peak - low) * e / F.lit(max(self.warmup, 1))
        if self.kind == "constant":
            later = peak
        elif self.kind == "step":
            later = peak * F.pow(F.lit(self.gamma), F.floor((e if self.step_from_start else e - self.warmup) / self.step_size).cast("double"))
        else:
            later = low + 0.5 * (peak - low) * (1 + F.cos(F.lit(math.pi) * (e - self.warmup) / F.lit(max(1, self.epochs - self.warmup))))
        rate = F.when(e <= self.warmup, warm).otherwise(later)
        return spark.range(1, self.epochs + 1).select(F.col("id").cast("int").alias("epoch")).select("epoch", rate.alias("lr"))
