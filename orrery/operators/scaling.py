"""Scaling as fit and transform (N1-N8). Fitting is one aggregate; a fitted scaler is a few numbers in generated code."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CHUNK_ROWS


class NotFitted(RuntimeError):
    """A scaler was used before fit()."""


@dataclass
class StandardScaler:
    """(x - mean) / population deviation for features and target apart (N1-N5); a constant column is divided by 1."""

    features: Sequence[str]
    target: str | None = None
    stats: dict[str, tuple[float, float]] | None = None

    @property
    def columns(self) -> list[str]:
        return [*self.features, *([self.target] if self.target else [])]

    def fit(self, df: DataFrame) -> "StandardScaler":
        row = df.agg(*[f(c).alias(f"{n}_{c}") for c in self.columns for n, f in (("mean", F.avg), ("dev", F.stddev_pop))]).first()
        if row is None or row[f"mean_{self.columns[0]}"] is None:
            raise ValueError("no rows to fit on")
        self.stats = {c: (row[f"mean_{c}"], row[f"dev_{c}"] or 1.0) for c in self.columns}
        return self

    def _fitted(self) -> dict[str, tuple[float, float]]:
        if self.stats is None:
            raise NotFitted("fit() first")
        return self.stats

    def feature_names(self) -> list[str]:
        """N5."""
        self._fitted()
        return list(self.features)

    def transform(self, df: DataFrame) -> DataFrame:
        """Scaled columns in place; features that df lacks become 0 before scaling."""
        stats = self._fitted()
        absent = [c for c in self.features if c not in df.columns]
        df = df.withColumns({c: F.lit(0.0) for c in absent}) if absent else df
        return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in stats.items() if c in df.columns})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """N4."""
        return self.fit(df).transform(df)

    def inverse_target(self, value: Column) -> Column:
        """Scaled target back to its unit."""
        mean, dev = self._fitted()[self.target]
        return value * dev + mean


def minmax_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of min_c and max_c."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def unit_range(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low); a constant column is 0, null stays null."""
    return F.when(value.isNotNull(), F.coalesce((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)))


def minmax_scale(df: DataFrame, columns: Sequence[str], mode: str = "global", *, index: str = "row_idx", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Columns scaled to [0, 1] over all rows ('global') or over each chunk of consecutive rows ('chunk').

    global costs one small job for the bounds and no shuffle; chunk aggregates bounds per chunk and joins them back."""
    if mode == "global":
        row = minmax_stats(df, columns).first().asDict()
        return df.withColumns({c: unit_range(F.col(c), F.lit(row[f"min_{c}"]), F.lit(row[f"max_{c}"])) for c in columns})
    if mode != "chunk":
        raise ValueError(f"unknown mode {mode!r}; known: global, chunk")
    chunk = Window.partitionBy(F.floor(F.col(index) / chunk_rows))
    return df.withColumns({c: unit_range(F.col(c), F.min(c).over(chunk), F.max(c).over(chunk)) for c in columns})
