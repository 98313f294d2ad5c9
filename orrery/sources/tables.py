"""Parquet tables of a folder, and the trips view over the events table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.clean import once


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """Raw trips with a dense row_idx, made from events; some values are missing, malformed or out of range on purpose."""
    e, ts = table(spark, folder, "events"), F.col("ts")
    text = lambda t: F.date_format(t, "MM/dd/yyyy hh:mm:ss a")
    after = lambda seconds: ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    every = lambda k: F.col("event_id") % k == 0
    kind = F.col("event_type")
    payment = F.when(kind == "click", 1).when(kind == "error", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(5)
    shown = once(
        e,
        tpep_pickup_datetime=F.when(every(97), "bad").otherwise(text(ts)),
        tpep_dropoff_datetime=F.when(every(101), None).when(every(53), text(after(F.lit(-60)))).otherwise(text(after(F.floor(F.col("value") * 60)))),
    )
    return shown.select(
        F.col("event_id").alias("row_idx"),
        "tpep_pickup_datetime",
        "tpep_dropoff_datetime",
        F.when(every(89), "x").otherwise((F.col("event_id") % 10).cast("string")).alias("passenger_count"),
        (F.col("value") / 4).alias("trip_distance"),
        (F.col("user_id") % 6 + 1).alias("RatecodeID"),
        F.col("user_id").alias("PULocationID"),
        F.regexp_extract("props", "([0-9]+)", 1).try_cast("int").alias("DOLocationID"),
        payment.alias("payment_type"),
        (F.col("event_id") % 7 - 1).alias("extra"),
        (3 + 2.5 * F.col("value")).alias("total_amount"),
    )
