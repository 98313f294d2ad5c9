"""Two-phase aggregates (A1-A16), column profiles (P19-P21) and error measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


class NoValidRows(RuntimeError):
    """Nothing is left to work on."""


def count_valid(df: DataFrame) -> int:
    """A1: rows; none is an error."""
    if not (n := df.count()):
        raise NoValidRows("no valid rows")
    return n


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    """sum(value * weight) / sum(weight), null for no weight."""
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0))).alias("weighted_mean"))


def error_measures(df: DataFrame, prediction: Column, truth: Column, *, spread: float = 1.0, empty: float | None = None) -> DataFrame:
    """A7, A7b-A7d: n, sse, mse, half_mse, rmse and the same error times spread (the target's unit).

    empty is the value of mse, half_mse and rmse over no rows."""
    square = F.pow(prediction - truth, F.lit(2.0))
    sums = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(square), F.lit(0.0)).alias("sse"))
    mse = F.coalesce(F.col("sse") / F.nullif(F.col("n"), F.lit(0)), F.lit(empty).cast("double"))
    return sums.select("n", "sse", mse.alias("mse"), (mse / 2).alias("half_mse"), F.sqrt(mse).alias("rmse"), (F.sqrt(mse) * spread).alias("rmse_unscaled"))


def step_rmse(df: DataFrame, step: str, prediction: Column, truth: Column) -> DataFrame:
    """RMSE of each step."""
    return df.groupBy(step).agg(F.sqrt(F.avg(F.pow(prediction - truth, F.lit(2.0)))).alias("train_rmse"))


def dead_fraction(df: DataFrame, z: Column) -> DataFrame:
    """Share of values at or under 0."""
    return df.agg(F.avg((z <= 0).cast("double")).alias("dead_fraction"))


def split_tally(df: DataFrame, split: str = "split") -> DataFrame:
    """Train and test rows and the share of test rows."""
    n = lambda s: F.count_if(F.col(split) == s)
    return df.agg(n("train").alias("n_train"), n("test").alias("n_test"), (n("test") / F.nullif(F.count("*"), F.lit(0))).alias("test_ratio"))


def timing_sums(df: DataFrame) -> DataFrame:
    """A10: io, compute and comm seconds of all workers by epoch."""
    return df.groupBy("epoch").agg(*[F.sum(c).alias(f"{c}_sum") for c in ("io_time", "compute_time", "comm_time")])


def missing(c: str, kind: T.DataType) -> Column:
    return F.col(c).isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c).isNull()


def null_profile(df: DataFrame) -> DataFrame:
    """column_name and n_missing of the columns with missing values; one pass."""
    counts = df.agg(*[F.count_if(missing(f.name, f.dataType)).alias(f.name) for f in df.schema])
    return counts.unpivot([], df.columns, "column_name", "n_missing").where("n_missing > 0")


# Whole-number types from narrow to wide with the bounds that values must stay strictly within.
INTEGERS = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -(2**31), 2**31 - 1)]
FLOAT_BOUND = 3.4028234663852886e38


def dtype_plan(df: DataFrame, category_share: float = 0.5) -> DataFrame:
    """P20: column_name, from_type, to_type: the narrowest type whose bounds hold all values; strings of few
    distinct values (under category_share of the rows) become 'category'. One aggregate over all columns."""
    kinds = {f.name: f.dataType for f in df.schema}
    whole = [c for c, k in kinds.items() if isinstance(k, T.IntegralType)]
    real = [c for c, k in kinds.items() if isinstance(k, (T.DoubleType, T.FloatType))]
    text = [c for c, k in kinds.items() if isinstance(k, T.StringType)]
    parts = [f(c).alias(f"{n}_{c}") for c in whole + real for n, f in (("min", F.min), ("max", F.max))] + [F.count_distinct(c).alias(f"n_{c}") for c in text]
    sums = df.agg(F.count("*").alias("rows__"), *parts)

    def to_type(c: str) -> Column:
        kind = kinds[c].simpleString()
        low, high = F.col(f"min_{c}") if c not in text else None, F.col(f"max_{c}") if c not in text else None
        if c in whole:
            rule = F.lit(kind)
            for name, a, z in reversed(INTEGERS):
                rule = F.when((low > a) & (high < z), name).otherwise(rule)
            return rule
        if c in real:
            return F.when((low > -FLOAT_BOUND) & (high < FLOAT_BOUND), "float").otherwise(kind)
        return F.when(F.col(f"n_{c}") < F.col("rows__") * category_share, "category").otherwise("string") if c in text else F.lit(kind)

    plan = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k.simpleString()).alias("from_type"), to_type(c).alias("to_type")) for c, k in kinds.items()])
    return sums.select(F.explode(plan).alias("p")).select("p.*")


def apply_dtype_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    """P20: df cast to the plan; Parquet dictionaries serve for categories."""
    to = {r["column_name"]: r["to_type"] for r in plan.collect()}
    return df.select(*[F.col(c).cast("string" if to.get(c) == "category" else to[c]).alias(c) if c in to else F.col(c) for c in df.columns])


def distinct_head(df: DataFrame, column: str, n: int = 10, order: str = "row_idx") -> DataFrame:
    """The first n distinct values in the order of their first row."""
    return df.groupBy(column).agg(F.min(order).alias("first_row")).orderBy("first_row").limit(n)
