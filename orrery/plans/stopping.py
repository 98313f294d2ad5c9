"""Early stopping and history queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass
class EarlyStop:
    """A value improves on the best if value + delta < best; patience misses in a row stop."""

    patience: int = 3
    delta: float = 1e-6
    best: float = float("inf")
    best_epoch: int = 0
    misses: int = 0

    def update(self, epoch: int, value: float) -> bool:
        """Whether to stop after this epoch."""
        if value + self.delta < self.best:
            self.best, self.best_epoch, self.misses = value, epoch, 0
        else:
            self.misses += 1
        return self.misses >= self.patience


def early_stop_trace(history: DataFrame, *, value: str = "test_rmse", patience: int = 3, delta: float = 1e-6) -> DataFrame:
    """W14 over a recorded history: best_epoch, best_value, stop_epoch (the last one where it never stops).

    A fold in epoch order, as delta makes the best depend on the path. A history has few rows, one for each epoch."""
    rows = history.agg(F.sort_array(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), F.col(value).cast("double").alias("v")))).alias("h"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("best_epoch"), F.lit(0).alias("misses"), F.lit(0).alias("stop"))

    def step(s, x):
        better = x["v"] + delta < s["best"]
        misses = F.when(better, 0).otherwise(s["misses"] + 1)
        moved = F.struct(F.when(better, x["v"]).otherwise(s["best"]).alias("best"), F.when(better, x["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"), misses.alias("misses"), x["epoch"].alias("stop"))
        return F.when(s["misses"] >= patience, s).otherwise(moved)

    return rows.select(F.aggregate("h", start, step).alias("s")).select(F.col("s.best_epoch").alias("best_epoch"), F.col("s.best").alias("best_value"), F.col("s.stop").alias("stop_epoch"))


def best_epoch(history: DataFrame, value: str = "test_rmse") -> DataFrame:
    """Epoch and value of the least value, the first epoch of equal ones."""
    least = history.agg(F.min(F.struct(F.col(value).alias("v"), F.col("epoch").alias("e"))).alias("s"))
    return least.select(F.col("s.e").alias("best_epoch"), F.col("s.v").alias("best_value"))


def every(steps: DataFrame, k: int, step: str = "k") -> DataFrame:
    """Every k-th step."""
    return steps.where(F.col(step) % k == 0)
