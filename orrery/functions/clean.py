"""Column rules and frame rules that turn raw trips into features (P1-P18). All of them stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import DROPOFF, DURATION_CLIP, DURATION_RANGE, FEATURES_16, FEATURES_8, NUMERIC, PICKUP, RANGES, RAW, TARGET, TIMESTAMP_FORMAT


class MissingColumns(ValueError):
    """Columns that a rule needs are not in the frame."""


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns, in order; fails before any work if one is absent."""
    if absent := [c for c in names if c not in df.columns]:
        raise MissingColumns(", ".join(absent))
    return df.select(*names)


def existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Those of the named columns that exist, in the given order."""
    return df.select(*[c for c in names if c in df.columns])


def parse_timestamp(text: Column) -> Column:
    """month/day/year and a 12-hour clock, fields of one or two digits, am or pm in any case; null where it does not parse."""
    return F.try_to_timestamp(F.upper(text), F.lit(TIMESTAMP_FORMAT))


def parse_timestamp_strict(text: Column) -> Column:
    """As parse_timestamp, but a value that does not parse fails the query."""
    return F.to_timestamp(F.upper(text), TIMESTAMP_FORMAT)


def minutes_between(start: Column, stop: Column) -> Column:
    """Fractional minutes, negative where stop is earlier."""
    return (F.unix_micros(stop) - F.unix_micros(start)) / F.lit(6e7)


def interval_between(start: Column, stop: Column) -> Column:
    """A day-time interval."""
    return stop - start


def clip(value: Column, low: float, high: float) -> Column:
    """value within [low, high]; null stays null (greatest and least alone would give a bound)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def to_number(text: Column) -> Column:
    """P10: a double, null where it is no number; NaN is null, as missing values are one thing here."""
    number = F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double")
    return F.when(~F.isnan(number), number)


def calendar_parts(ts: Column, side: str) -> list[Column]:
    """Hour, day, month and weekday (Monday is 0)."""
    return [f(ts).alias(f"{side}_{part}") for part, f in (("hour", F.hour), ("day", F.dayofmonth), ("month", F.month), ("weekday", F.weekday))]


def coerce_numbers(df: DataFrame, names: Sequence[str] = (*NUMERIC, TARGET)) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c)) for c in names if c in df.columns})


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows with a null (or NaN) in any column, or in any of subset."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def in_ranges(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]] = RANGES) -> DataFrame:
    """Rows within inclusive ranges; columns that do not exist set no condition."""
    for c, (low, high) in ranges.items():
        if c in df.columns:
            df = df if low is None else df.where(F.col(c) >= low)
            df = df if high is None else df.where(F.col(c) <= high)
    return df


def clean_trips(raw: DataFrame) -> DataFrame:
    """Numbers coerced, rows with a missing raw value dropped, ranges kept, whole passengers."""
    kept = in_ranges(drop_missing(coerce_numbers(raw), RAW))
    return kept.withColumn("passenger_count", F.col("passenger_count").cast("int"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once a row.

    A generator of one row keeps the optimizer from copying costly expressions into every filter and projection above."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_times(df: DataFrame) -> DataFrame:
    """pickup and dropoff; parsed once, here."""
    if {"pickup", "dropoff"} <= {*df.columns}:
        return df
    return once(df, pickup=parse_timestamp(F.col(PICKUP)), dropoff=parse_timestamp(F.col(DROPOFF)))


def with_duration(df: DataFrame) -> DataFrame:
    """P3c then P12: minutes are clipped first, so negative ones stay as 0, and those over the range go."""
    clipped = with_times(df).withColumn("trip_duration", clip(minutes_between(F.col("pickup"), F.col("dropoff")), *DURATION_CLIP))
    return drop_missing(clipped, ["trip_duration"]).where(F.col("trip_duration").between(*DURATION_RANGE))


def with_calendar(df: DataFrame) -> DataFrame:
    df = with_times(df)
    return df.select("*", *calendar_parts(F.col("pickup"), "pickup"), *calendar_parts(F.col("dropoff"), "dropoff"))


def engineer_8(raw: DataFrame, keep: Sequence[str] = ("row_idx",)) -> DataFrame:
    """Seven numbers, unclipped minutes and the target as float32, rows with any missing value dropped."""
    timed = coerce_numbers(with_times(raw)).withColumn("time_on_taxi", minutes_between(F.col("pickup"), F.col("dropoff")))
    rows = existing(timed, [*keep, *FEATURES_8, TARGET])
    return drop_missing(rows).select(*[c for c in keep if c in rows.columns], *[F.col(c).cast("float").alias(c) for c in (*FEATURES_8, TARGET)])


def engineer_16(raw: DataFrame, keep: Sequence[str] = ("row_idx",)) -> DataFrame:
    """The sixteen features and the target, cleaned."""
    return existing(with_calendar(with_duration(clean_trips(raw))), [*keep, *FEATURES_16, TARGET])


#: Buckets of a pass of exact_median, and values that one aggregate may hold.
MEDIAN_BUCKETS, MEDIAN_VALUES = 4096, 1_000_000


def exact_median(df: DataFrame, name: str) -> float | None:
    """The median of a column, null without values, in passes that count buckets: each narrows the range to the buckets of the middle
    rows, until few enough values are left for one exact aggregate. No pass moves more than its buckets."""
    v = F.col(name).cast("double")
    rows = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    want = [(n - 1) // 2, n // 2]  # ranks of the middle rows, from 0
    while n > MEDIAN_VALUES and low < high:
        width = (high - low) / MEDIAN_BUCKETS
        if not width or low + width == low or width == float("inf"):
            break
        at = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(MEDIAN_BUCKETS - 1))
        counts = rows.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("at").collect()
        before, kept = 0, []
        for r in counts:
            if before <= want[1] and before + r["n"] > want[0]:
                kept.append((before, r))
            before += r["n"]
        if sum(r["n"] for _, r in kept) == n:
            break
        want = [w - kept[0][0] for w in want]
        n, low, high = sum(r["n"] for _, r in kept), kept[0][1]["low"], kept[-1][1]["high"]
        rows = rows.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
    if low == high:
        return low
    # the values left by how often they occur: at most MEDIAN_VALUES, but for ranges that cannot be divided further
    seen, ends = 0, []
    for r in rows.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").toLocalIterator():
        seen += r["n"]
        while len(ends) < 2 and seen > want[len(ends)]:
            ends.append(r["v"])
        if len(ends) == 2:
            break
    return (ends[0] + ends[1]) / 2


def impute_median(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Nulls of the named columns become the column's exact median."""
    medians = {c: exact_median(df, c) for c in names}
    return df.fillna({c: m for c, m in medians.items() if m is not None})


def reindex(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The fitted names in order; a column that is absent is 0."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in names])


def assemble(df: DataFrame, names: Sequence[str], label: str = TARGET, keep: Sequence[str] = ("row_idx",)) -> DataFrame:
    """Features as an array beside the label, in one row, so they cannot come apart."""
    return df.select(*keep, F.array(*[F.col(c).cast("float") for c in names]).alias("features"), F.col(label).cast("float").alias("label"))


