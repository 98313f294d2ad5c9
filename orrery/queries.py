"""The engine's operators as queries over the tables of a folder, each with SQL that gives the same rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .functions import clean as C
from .functions.activations import activation
from .functions.vectors import added, dot, l2_norm, scaled
from .operators import indexing as I, scaling as N, splitting as W, stats as A
from .plans import experiment as X, stopping as S
from .plans.network import Network
from .plans.optimiser import Schedule, scaled_lr
from .plans.session import work_folder
from .plans.trainer import Trainer, reduced, scored
from .schema import FEATURES_16, FEATURES_8, NUMERIC, RAW, RAW_SCHEMA, TARGET
from .sources import history as H, matrix as M, text as R
from .sources.tables import table, trips
from .streaming import incremental as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with SQL for the same rows if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- trips in SQL

TRIPS = """trips AS (
  SELECT event_id AS row_idx,
    CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE strftime(ts, '%m/%d/%Y %I:%M:%S %p') END AS tpep_pickup_datetime,
    CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 53 = 0 THEN strftime(ts - INTERVAL 60 SECOND, '%m/%d/%Y %I:%M:%S %p')
      ELSE strftime(ts + to_seconds(CAST(floor(value * 60) AS BIGINT)), '%m/%d/%Y %I:%M:%S %p') END AS tpep_dropoff_datetime,
    CASE WHEN event_id % 89 = 0 THEN 'x' ELSE CAST(event_id % 10 AS VARCHAR) END AS passenger_count,
    value / 4 AS trip_distance, CAST(user_id % 6 + 1 AS DOUBLE) AS "RatecodeID", CAST(user_id AS DOUBLE) AS "PULocationID",
    CAST(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS DOUBLE) AS "DOLocationID",
    CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS DOUBLE) AS payment_type,
    CAST(event_id % 7 - 1 AS DOUBLE) AS extra, 3 + 2.5 * value AS total_amount
  FROM events), numbered AS (
  SELECT * REPLACE (TRY_CAST(passenger_count AS DOUBLE) AS passenger_count), try_strptime(tpep_pickup_datetime, '%m/%d/%Y %I:%M:%S %p') AS pickup,
    try_strptime(tpep_dropoff_datetime, '%m/%d/%Y %I:%M:%S %p') AS dropoff FROM trips), timed AS (
  SELECT *, (epoch_us(dropoff) - epoch_us(pickup)) / 6e7 AS minutes FROM numbered), cleaned AS (
  SELECT * REPLACE (CAST(passenger_count AS INTEGER) AS passenger_count) FROM timed
  WHERE tpep_pickup_datetime IS NOT NULL AND tpep_dropoff_datetime IS NOT NULL AND passenger_count BETWEEN 1 AND 8 AND trip_distance BETWEEN 0 AND 100
    AND "RatecodeID" IS NOT NULL AND "PULocationID" IS NOT NULL AND "DOLocationID" IS NOT NULL AND payment_type IS NOT NULL AND extra >= 0 AND total_amount BETWEEN 0 AND 1000), rides AS (
  SELECT *, greatest(0, least(1440, minutes)) AS trip_duration FROM cleaned WHERE minutes IS NOT NULL AND greatest(0, least(1440, minutes)) <= 300), whole AS (
  SELECT *, minutes AS time_on_taxi FROM timed WHERE tpep_pickup_datetime IS NOT NULL AND minutes IS NOT NULL AND passenger_count IS NOT NULL AND "DOLocationID" IS NOT NULL)"""
NUMBERS_SQL = 'passenger_count, trip_distance, "RatecodeID", "PULocationID", "DOLocationID", payment_type, extra'
PARTS_SQL = ", ".join(f"CAST(extract({part} FROM {side}) AS INTEGER) AS {side}_{part}" for side in ("pickup", "dropoff") for part in ("hour", "day", "month")) + ", " + ", ".join(f"CAST(isodow({side}) - 1 AS INTEGER) AS {side}_weekday" for side in ("pickup", "dropoff"))


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Doubles (those named, or all) rounded, as sums depend on their order in the last digits."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in names or df.columns if kinds[c] in ("double", "float")})


# ---------------------------------------------------------------- cleaning


@query(f"WITH {TRIPS} SELECT row_idx, pickup, dropoff, {NUMBERS_SQL}, total_amount FROM cleaned")
def trips_parse_clean(spark, d):
    return C.with_times(C.clean_trips(C.require_columns(trips(spark, d), ["row_idx", *RAW]))).select("row_idx", F.col("pickup").cast("timestamp_ntz").alias("pickup"), F.col("dropoff").cast("timestamp_ntz").alias("dropoff"), "passenger_count", *[F.col(c).cast("double").alias(c) for c in (*NUMERIC[1:], TARGET)])


@query(f"WITH {TRIPS} SELECT row_idx, round(trip_duration, 6) AS trip_duration FROM rides")
def trips_duration_clip_filter(spark, d):
    return rounded(C.with_duration(C.clean_trips(trips(spark, d))).select("row_idx", "trip_duration"))


@query(f"WITH {TRIPS} SELECT row_idx, {PARTS_SQL} FROM numbered")
def trips_calendar_parts(spark, d):
    return C.with_calendar(trips(spark, d)).drop(*RAW, "pickup", "dropoff")


EIGHT_SQL = ", ".join(f'round(CAST(CAST("{c}" AS FLOAT) AS DOUBLE), 3) AS "{c}"' for c in (*FEATURES_8, TARGET))


@query(f"WITH {TRIPS} SELECT row_idx, {EIGHT_SQL} FROM whole")
def trips_engineer_8(spark, d):
    return rounded(C.engineer_8(trips(spark, d)), 3)


@query(f"WITH {TRIPS} SELECT row_idx, {NUMBERS_SQL}, {PARTS_SQL}, round(trip_duration, 6) AS trip_duration, total_amount FROM rides")
def trips_engineer_16(spark, d):
    df = C.engineer_16(trips(spark, d))
    return rounded(df.withColumns({c: F.col(c).cast("double") for c in NUMERIC[1:]}), 6, "trip_duration")


@query(f"WITH {TRIPS} SELECT count(*)::BIGINT AS n_rows FROM numbered WHERE tpep_pickup_datetime IS NOT NULL AND tpep_dropoff_datetime IS NOT NULL AND passenger_count IS NOT NULL AND pickup IS NOT NULL AND dropoff IS NOT NULL AND \"DOLocationID\" IS NOT NULL")
def trips_dropna_any(spark, d):
    return C.drop_missing(C.coerce_numbers(C.with_times(trips(spark, d)))).agg(F.count("*").alias("n_rows"))


@query(f"WITH {TRIPS} SELECT row_idx, passenger_count FROM numbered WHERE passenger_count IS NOT NULL AND tpep_dropoff_datetime IS NOT NULL")
def trips_dropna_subset(spark, d):
    return C.drop_missing(C.coerce_numbers(trips(spark, d)), ["passenger_count", "tpep_dropoff_datetime"]).select("row_idx", "passenger_count")


@query("SELECT o_orderkey, CAST(epoch(o_orderdate + INTERVAL 90 MINUTE) - epoch(o_orderdate) AS BIGINT) AS seconds FROM orders")
def orders_strict_interval(spark, d):
    text = F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a")
    start = C.parse_timestamp_strict(text)
    gap = C.interval_between(start, start + F.expr("INTERVAL '90' MINUTE"))
    return table(spark, d, "orders").select("o_orderkey", F.expr("0").alias("z"), gap.alias("gap")).select("o_orderkey", (F.extract(F.lit("HOUR"), "gap") * 3600 + F.extract(F.lit("MINUTE"), "gap") * 60).cast("long").alias("seconds"))


@query(f"WITH {TRIPS}, m AS (SELECT median(passenger_count) AS pm, median(minutes) AS mm FROM timed) SELECT row_idx, coalesce(passenger_count, pm) AS passenger_count, round(coalesce(minutes, mm), 6) AS minutes FROM timed, m")
def median_impute(spark, d):
    timed = C.with_times(C.coerce_numbers(trips(spark, d))).withColumn("minutes", C.minutes_between(F.col("pickup"), F.col("dropoff")))
    return rounded(C.impute_median(timed.select("row_idx", "passenger_count", "minutes"), ["passenger_count", "minutes"]))


@query(f"WITH {TRIPS} SELECT row_idx, extra, 0.0::DOUBLE AS tolls FROM timed")
def reindex_features(spark, d):
    return C.reindex(C.coerce_numbers(trips(spark, d)), ["extra", "tolls"], keep=["row_idx"])


# ---------------------------------------------------------------- profiles


@query(f"WITH {TRIPS}, n AS (SELECT count(*) FILTER (passenger_count IS NULL) AS a, count(*) FILTER (pickup IS NULL) AS b, count(*) FILTER (dropoff IS NULL) AS c, count(*) FILTER (tpep_dropoff_datetime IS NULL) AS e FROM numbered) SELECT * FROM (SELECT 'passenger_count' AS column_name, a AS n_missing FROM n UNION ALL SELECT 'pickup', b FROM n UNION ALL SELECT 'dropoff', c FROM n UNION ALL SELECT 'tpep_dropoff_datetime', e FROM n) WHERE n_missing > 0")
def null_profile(spark, d):
    return A.null_profile(C.coerce_numbers(C.with_times(trips(spark, d))))


_DTYPE = {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "j", "p_retailprice": "d"}


def _dtype_sql() -> str:
    rules = []
    for c, k in _DTYPE.items():
        kind = {"i": "bigint", "j": "int", "s": "string", "d": "double"}[k]
        to = {"s": f"CASE WHEN count(DISTINCT {c}) < count(*) * 0.5 THEN 'category' ELSE 'string' END", "d": f"CASE WHEN max({c}) < 3.4e38 AND min({c}) > -3.4e38 THEN 'float' ELSE 'double' END"}.get(k) or f"CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint' WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE '{kind}' END"
        rules.append(f"SELECT '{c}' AS column_name, '{kind}' AS from_type, {to} AS to_type FROM part")
    return " UNION ALL ".join(rules)


@query(_dtype_sql())
def dtype_plan(spark, d):
    return A.dtype_plan(table(spark, d, "part"))


@query("SELECT CAST(sum(p_size) AS BIGINT) AS sizes, round(sum(CAST(p_retailprice AS FLOAT)::DOUBLE), 2) AS prices, count(DISTINCT p_brand) AS brands FROM part")
def dtype_apply(spark, d):
    part = table(spark, d, "part")
    return A.apply_dtype_plan(part, A.dtype_plan(part)).agg(F.sum("p_size").alias("sizes"), F.round(F.sum(F.col("p_retailprice").cast("double")), 2).alias("prices"), F.count_distinct("p_brand").alias("brands"))


@query("SELECT event_type, min(event_id) AS first_row FROM events GROUP BY 1 ORDER BY 2 LIMIT 10")
def distinct_head(spark, d):
    return A.distinct_head(table(spark, d, "events"), "event_type", 10, "event_id")


# ---------------------------------------------------------------- scaling


@query(f"WITH {TRIPS}, s AS (SELECT avg(total_amount) AS m, stddev_pop(total_amount) AS v, avg(trip_duration) AS dm, stddev_pop(trip_duration) AS dv FROM rides) SELECT row_idx, round((total_amount - m) / v, 6) AS total_amount, round((trip_duration - dm) / dv, 6) AS trip_duration FROM rides, s")
def standard_scale(spark, d):
    df = C.engineer_16(trips(spark, d))
    return rounded(N.StandardScaler(["trip_duration"], TARGET).fit_transform(df).select("row_idx", TARGET, "trip_duration"))


@query(f"WITH {TRIPS}, h AS (SELECT total_amount FROM rides ORDER BY row_idx LIMIT 500), s AS (SELECT avg(total_amount) AS m, stddev_pop(total_amount) AS v FROM h) SELECT row_idx, round((total_amount - m) / v, 4) AS scaled, round(total_amount, 4) AS total_amount FROM rides, s")
def standard_inverse(spark, d):
    df = C.engineer_16(trips(spark, d))
    scaler = N.StandardScaler(["trip_duration"], TARGET).fit(R.head_sample(df, 500))
    return rounded(scaler.transform(df).select("row_idx", F.col(TARGET).alias("scaled"), scaler.inverse_target(F.col(TARGET)).alias(TARGET)), 4)


@query("SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice FROM lineitem")
def lineitem_minmax_stats(spark, d):
    return N.minmax_stats(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 6) AS l_quantity, round((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem), 6) AS l_extendedprice FROM lineitem")
def lineitem_minmax_global(spark, d):
    names = ["l_quantity", "l_extendedprice"]
    return rounded(N.minmax_scale(table(spark, d, "lineitem"), names), 6, *names).select("l_orderkey", "l_linenumber", *names)


@query("SELECT event_id, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0), 6) AS value FROM events WINDOW w AS (PARTITION BY event_id // 500)")
def events_minmax_by_chunk(spark, d):
    return rounded(N.minmax_scale(table(spark, d, "events"), ["value"], "chunk", index="event_id", chunk_rows=500).select("event_id", "value"))


# ---------------------------------------------------------------- aggregates


@query(f"WITH {TRIPS} SELECT count(*)::BIGINT AS n FROM cleaned")
def count_valid(spark, d):
    return spark.createDataFrame([(A.count_valid(C.clean_trips(trips(spark, d))),)], "n long")


@query("SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_mean FROM lineitem")
def weighted_mean(spark, d):
    return rounded(A.weighted_mean(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity"), 4)


_MODEL = "10 + 2.0 * trip_duration"


@query(f"WITH {TRIPS}, e AS (SELECT count(*) AS n, sum(pow({_MODEL} - total_amount, 2)) AS sse FROM rides) SELECT n, round(sse, 2) AS sse, round(sse / n, 5) AS mse, round(sse / n / 2, 5) AS half_mse, round(sqrt(sse / n), 5) AS rmse, round(sqrt(sse / n) * 2.5, 5) AS rmse_unscaled FROM e")
def eval_rmse_scaled_unscaled(spark, d):
    out = A.error_measures(C.engineer_16(trips(spark, d)), 10 + 2.0 * F.col("trip_duration"), F.col(TARGET), spread=2.5)
    return rounded(rounded(out, 2, "sse"), 5, "mse", "half_mse", "rmse", "rmse_unscaled")


@query(f"WITH {TRIPS} SELECT row_idx // 1000 AS step, round(sqrt(avg(pow({_MODEL} - total_amount, 2))), 5) AS train_rmse FROM rides GROUP BY 1")
def step_rmse(spark, d):
    df = C.engineer_16(trips(spark, d)).withColumn("step", F.floor(F.col("row_idx") / 1000))
    return rounded(A.step_rmse(df, "step", 10 + 2.0 * F.col("trip_duration"), F.col(TARGET)), 5)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def embedding_norms(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", l2_norm(F.col("embedding")).alias("norm")))


@query("SELECT round(avg(CASE WHEN embedding[1] - embedding[2] <= 0 THEN 1.0 ELSE 0.0 END), 6) AS dead_fraction FROM embeddings")
def dead_relu_fraction(spark, d):
    return rounded(A.dead_fraction(table(spark, d, "embeddings"), F.col("embedding")[0] - F.col("embedding")[1]))


@query("SELECT event_id % 5 AS epoch, round(sum(value), 4) AS io_time_sum, round(sum(value / 2), 4) AS compute_time_sum, round(sum(value / 4), 4) AS comm_time_sum FROM events GROUP BY 1")
def timing_sums(spark, d):
    v = F.col("value")
    df = table(spark, d, "events").select((F.col("event_id") % 5).alias("epoch"), v.alias("io_time"), (v / 2).alias("compute_time"), (v / 4).alias("comm_time"))
    return rounded(A.timing_sums(df), 4)


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def label_counts(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- index, shards, splits


@query("WITH c AS (SELECT event_id // 700 AS chunk, count(*) AS n_rows FROM events GROUP BY 1) SELECT chunk, n_rows, coalesce(sum(n_rows) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c")
def chunk_prefix_offsets(spark, d):
    return I.chunk_offsets(table(spark, d, "events"), F.floor(F.col("event_id") / 700))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_idx FROM orders")
def dense_row_index(spark, d):
    return I.dense_index(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_idx")


@query("SELECT (ntile(7) OVER (ORDER BY event_id) - 1)::INTEGER AS shard, event_id FROM events")
def shard_bounds(spark, d):
    events = table(spark, d, "events")
    return events.select(I.shard_of(F.col("event_id"), events.count(), 7).alias("shard"), "event_id")


@query("WITH s AS (SELECT ntile(7) OVER (ORDER BY event_id) - 1 AS shard, event_id, value FROM events) SELECT shard::INTEGER AS shard, min(event_id) AS lo, max(event_id) + 1 AS hi, count(*) AS n_rows, round(avg(value), 5) AS mean_value FROM s GROUP BY 1")
def shard_stats(spark, d):
    events = table(spark, d, "events")
    sharded = events.withColumn("shard", I.shard_of(F.col("event_id"), events.count(), 7))
    return rounded(sharded.groupBy("shard").agg(F.min("event_id").alias("lo"), (F.max("event_id") + 1).alias("hi"), F.count("*").alias("n_rows"), F.avg("value").alias("mean_value")), 5)


_N = "(SELECT count(*) FROM events)"
_SPLIT = f"CASE WHEN (7919 * event_id + 104729) % {_N} < floor(0.3 * {_N}) THEN 'test' ELSE 'train' END"


def _split_events(spark, d, rounding="floor"):
    events = table(spark, d, "events")
    return W.exact_split(events, events.count(), key=(7919, 104729), rounding=rounding, index="event_id")


@query(f"SELECT event_id, {_SPLIT} AS split FROM events")
def exact_split(spark, d):
    return _split_events(spark, d).select("event_id", "split")


@query(f"SELECT event_id, {_SPLIT.replace('floor', 'ceil')} AS split FROM events")
def library_split(spark, d):
    return _split_events(spark, d, "ceil").select("event_id", "split")


@query(f"WITH s AS (SELECT {_SPLIT} AS split FROM events) SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test, round(count(*) FILTER (split = 'test') / count(*), 6) AS test_ratio FROM s")
def split_tally(spark, d):
    return rounded(A.split_tally(_split_events(spark, d)))


def _draw_sql(seed: int, index: str = "event_id") -> str:
    a = 1 + (seed * 7_919 + 104_729) % W.MULTIPLIER
    return f"(({index} % {W.PRIME}) * {a} + {seed * 15_485_863 % W.PRIME}) % {W.PRIME}"


@query(f"WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_id // 700 ORDER BY {_draw_sql(42)}, event_id) AS rank, count(*) OVER (PARTITION BY event_id // 700) AS n FROM events) SELECT event_id, CASE WHEN rank <= floor(n * 0.3) THEN 'test' ELSE 'train' END AS split FROM r")
def batch_split(spark, d):
    return W.batch_split(table(spark, d, "events"), F.floor(F.col("event_id") / 700), index="event_id").select("event_id", "split")


@query(f"WITH s AS (SELECT event_id, {_SPLIT} AS split FROM events) SELECT event_id, split, row_number() OVER (PARTITION BY split ORDER BY event_id) - 1 AS split_pos FROM s")
def split_positions(spark, d):
    return I.route(_split_events(spark, d), index="event_id").select("event_id", "split", "split_pos")


@query(f"WITH r AS (SELECT event_id, event_id % 4 AS shard, row_number() OVER (PARTITION BY event_id % 4 ORDER BY ({_draw_sql(42 + 31 * 2)} + (event_id % 4) * 97409) % {W.PRIME}, event_id) AS rank FROM events) SELECT event_id, shard FROM r WHERE rank <= 64")
def minibatch_sample(spark, d):
    return W.minibatch(table(spark, d, "events").withColumn("shard", F.col("event_id") % 4), "shard", 64, epoch=2, index="event_id").select("event_id", "shard")


@query(f"SELECT event_id, event_id % 4 AS shard, (row_number() OVER (PARTITION BY event_id % 4 ORDER BY {_draw_sql(12345 + 3)}, event_id) - 1) // 100 AS batch FROM events")
def epoch_batches(spark, d):
    return W.epoch_batches(table(spark, d, "events").withColumn("shard", F.col("event_id") % 4), "shard", 100, epoch=3, index="event_id").select("event_id", "shard", "batch")


@query(f"WITH b AS (SELECT DISTINCT event_id // 128 AS block FROM events) SELECT block, row_number() OVER (ORDER BY {_draw_sql(9, 'block')}, block)::INTEGER AS block_rank FROM b")
def block_order(spark, d):
    return I.block_order(table(spark, d, "events"), 128, W.draw_key(F.col("block"), 9), "event_id")


@query(f"SELECT event_id, (7919 * event_id + 104729) % {_N} AS logical, event_id AS back FROM events")
def affine_permutation(spark, d):
    events = table(spark, d, "events")
    n = events.count()
    logical = events.select("event_id", I.permute(F.col("event_id"), n, 7919, 104729).alias("logical"))
    return logical.withColumn("back", I.unpermute(F.col("logical"), n, 7919, 104729))


_LOGICAL = f"SELECT event_id AS physical, (7919 * event_id + 104729) % {_N} AS logical FROM events"


def _permuted(spark, d):
    events = table(spark, d, "events")
    n = events.count()
    return events.select(F.col("event_id").alias("physical"), I.permute(F.col("event_id"), n, 7919, 104729).alias("logical")), n


@query(f"WITH l AS ({_LOGICAL}), b AS (SELECT physical, logical // (SELECT count(*) // 2 FROM events) AS super FROM l), m AS (SELECT *, physical - row_number() OVER (PARTITION BY super ORDER BY physical) AS island FROM b), r AS (SELECT super, min(physical) AS first, count(*) AS n_rows FROM m GROUP BY super, island) SELECT super, row_number() OVER (PARTITION BY super ORDER BY first)::BIGINT AS run, first, n_rows FROM r")
def superbatch_runs(spark, d):
    df, n = _permuted(spark, d)
    return I.runs(df.withColumn("super", I.batch_of(F.col("logical"), n // 2)), "super", "physical")


@query(f"WITH l AS ({_LOGICAL}) SELECT physical, logical, logical // 300 AS batch, (row_number() OVER (PARTITION BY logical // 300 ORDER BY physical) - 1)::INTEGER AS physical_pos, (row_number() OVER (PARTITION BY logical // 300 ORDER BY logical) - 1)::INTEGER AS logical_pos FROM l")
def inverse_permutation(spark, d):
    df, _ = _permuted(spark, d)
    return I.inverse_positions(df.withColumn("batch", I.batch_of(F.col("logical"), 300)), "batch", "logical", "physical")


@query(f"WITH l AS ({_LOGICAL}) SELECT logical // 256 AS batch, count(*) AS n_rows, sum(physical)::BIGINT AS sum_physical FROM l GROUP BY 1")
def batch_assign(spark, d):
    df, _ = _permuted(spark, d)
    return df.groupBy(I.batch_of(F.col("logical"), 256).alias("batch")).agg(F.count("*").alias("n_rows"), F.sum("physical").alias("sum_physical"))


# ---------------------------------------------------------------- sources and sinks


@query("SELECT * FROM (SELECT event_id AS row_idx FROM events ORDER BY 1 LIMIT 123)")
def head_sample(spark, d):
    return R.head_sample(trips(spark, d), 123).select("row_idx")


@query("SELECT * FROM (SELECT event_id AS row_idx FROM events ORDER BY 1 LIMIT 50 OFFSET 400)")
def offset_sample(spark, d):
    return R.offset_sample(trips(spark, d), 400, 50).select("row_idx")


@query(f"WITH {TRIPS} SELECT row_idx, pickup, passenger_count, total_amount FROM cleaned")
def csv_round_trip(spark, d):
    path = work_folder(spark, "csv")
    trips(spark, d).select("row_idx", *RAW).write.csv(path, header=True)
    schema = T.StructType([T.StructField("row_idx", T.LongType()), *RAW_SCHEMA])
    back = C.with_times(C.clean_trips(R.read_csv(spark, path, schema)))
    return back.select("row_idx", F.col("pickup").cast("timestamp_ntz").alias("pickup"), "passenger_count", TARGET)


@query("SELECT event_id, user_id, value FROM events")
def parse_lines(spark, d):
    lines = table(spark, d, "events").select(F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("value").cast("string")).alias("value"))
    return R.parse_lines(lines, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType())]))


@query("SELECT count(*)::BIGINT AS n_lines FROM events")
def text_line_count(spark, d):
    path = work_folder(spark, "text")
    table(spark, d, "events").select("props").write.text(path)
    return R.line_count(spark, path)


@query("SELECT count(*)::BIGINT AS n_rows FROM lineitem")
def scan_row_counts(spark, d):
    return R.rows_by_partition(table(spark, d, "lineitem")).agg(F.sum("n_rows").alias("n_rows"))


@query(f"WITH {TRIPS}, s AS (SELECT CASE WHEN (7919 * row_idx + 104729) % {_N} < floor(0.3 * {_N}) THEN 'test' ELSE 'train' END AS split FROM whole) SELECT split, count(*) AS n_rows, 8 AS n_features, true AS is_regular FROM s GROUP BY 1")
def matrix_round_trip(spark, d):
    return M.matrix_shape(M.read_matrix(spark, _written_matrix(spark, d)))


def _written_matrix(spark, d):
    raw = trips(spark, d)
    rows = C.assemble(C.engineer_8(raw), FEATURES_8)
    path = work_folder(spark, "matrix")
    M.write_matrix(W.exact_split(rows, raw.count(), key=(7919, 104729)), path)
    return path


@query(f"WITH {TRIPS} SELECT row_idx, {EIGHT_SQL} FROM whole WHERE (7919 * row_idx + 104729) % {_N} < floor(0.3 * {_N})")
def matrix_test_split(spark, d):
    """The values of the test split, written and read back."""
    rows = M.read_matrix(spark, _written_matrix(spark, d), "test")
    features = [F.col("features")[i].alias(c) for i, c in enumerate(FEATURES_8)]
    return rounded(rows.select("row_idx", *features, F.col("label").alias(TARGET)), 3)


# A run's test error and loss by epoch: falling as 1 / epoch, with a bump at the fourth and a plateau from the seventh on.
SERIES = [round(0.1 + 0.3 / min(e, 7) + (0.08 if e == 4 else 0.0), 6) for e in range(1, 11)]
LOSSES = [round(v / 5, 6) for v in SERIES]
_SERIES_SQL = "(VALUES " + ", ".join(f"({i}, {loss}, {v})" for i, (loss, v) in enumerate(zip(LOSSES, SERIES), 1)) + ") AS h(epoch, loss, test_rmse)"


def _recorded() -> list[dict]:
    return [{"epoch": i, "loss": loss, "test_rmse": v} for i, (loss, v) in enumerate(zip(LOSSES, SERIES), 1)]


def _series(spark):
    return H.history_frame(spark, _recorded())


@query(f"SELECT epoch::INTEGER AS epoch, round(loss::DOUBLE, 6) AS loss, test_rmse::DOUBLE AS test_rmse FROM {_SERIES_SQL}")
def history_csv_round_trip(spark, d):
    path = work_folder(spark, "history")
    H.write_history_csv(_series(spark), path)
    return rounded(H.read_history_csv(spark, path))


@query(f"SELECT epoch::INTEGER AS epoch, test_rmse::DOUBLE AS test_rmse, 7 AS best_epoch FROM {_SERIES_SQL}")
def history_json_round_trip(spark, d):
    path = work_folder(spark, "run")
    H.write_run(spark, path, {"hidden": 64}, min(SERIES), 7, _recorded())
    return H.read_run(spark, path).select(F.explode("history").alias("h"), "best_epoch").select("h.epoch", "h.test_rmse", "best_epoch")


# ---------------------------------------------------------------- model mathematics

THETA = np.array([0.5, -0.25, 0.1, 0.2, -0.3, 0.4, 0.6, 0.05, -0.1])
_UNIT = "CASE WHEN {z} >= 0 THEN {z} ELSE 0.01 * {z} END"
_Z = ["(0.2 * a - 0.3 * b + 0.05)", "(0.4 * a + 0.6 * b - 0.1)"]
_FORWARD = f"pts AS (SELECT event_id AS row_idx, (value / 100)::FLOAT::DOUBLE AS a, ((event_id % 7) / 7.0)::FLOAT::DOUBLE AS b, (value / 50)::FLOAT::DOUBLE AS y FROM events), z AS (SELECT *, {_Z[0]} AS z1, {_Z[1]} AS z2 FROM pts), h AS (SELECT *, {_UNIT.format(z='z1')} AS a1, {_UNIT.format(z='z2')} AS a2, CASE WHEN z1 >= 0 THEN 1 ELSE 0.01 END AS d1, CASE WHEN z2 >= 0 THEN 1 ELSE 0.01 END AS d2 FROM z), p AS (SELECT *, 0.5 * a1 - 0.25 * a2 + 0.1 AS p, 0.5 * a1 - 0.25 * a2 + 0.1 - y AS e FROM h)"


def _points(events):
    v, i = F.col("value"), F.col("event_id")
    return events.select(i.alias("row_idx"), F.array((v / 100).cast("float"), ((i % 7) / F.lit(7.0)).cast("float")).alias("features"), (v / 50).cast("float").alias("label"))


@query(f"WITH {_FORWARD} SELECT row_idx, round(p, 5) AS prediction FROM p")
def nn_forward_column(spark, d):
    return rounded(_points(table(spark, d, "events")).select("row_idx", Network(2, 2).column(THETA, F.col("features")).alias("prediction")), 5)


@query(f"WITH {_FORWARD} SELECT row_idx, round(p, 5) AS prediction FROM p")
def nn_forward_batch(spark, d):
    return rounded(scored(_points(table(spark, d, "events")), Network(2, 2), THETA), 5).select("row_idx", "prediction")


@query(f"""WITH {_FORWARD}, s AS (SELECT [sum(e * a1), sum(e * a2), sum(e), sum(e * 0.5 * d1 * a), sum(e * 0.5 * d1 * b), sum(e * -0.25 * d2 * a), sum(e * -0.25 * d2 * b), sum(e * 0.5 * d1), sum(e * -0.25 * d2)] AS g, count(*) AS n FROM p)
SELECT (i - 1)::INTEGER AS i, round(g[i] / n, 5) AS gradient FROM s, range(1, 10) AS t(i)""")
def nn_gradient(spark, d):
    m = reduced(_points(table(spark, d, "events")), Network(2, 2), THETA)
    return rounded(spark.createDataFrame([(i, float(g)) for i, g in enumerate(m.gradient / m.n)], "i int, gradient double"), 5)


@query("SELECT (i - 1)::INTEGER AS i, t[i]::DOUBLE AS theta FROM (SELECT [" + ", ".join(f"{float(x)!r}" for x in THETA) + "] AS t) AS x, range(1, 10) AS r(i)")
def theta_round_trip(spark, d):
    """M3: unpacked and packed again, through a trainer's accessors."""
    net = Network(2, 2)
    trainer = Trainer(net)
    trainer.set_params(net.pack(*net.unpack(THETA)))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(trainer.get_params())], "i int, theta double")


@query("WITH p AS (SELECT value / 100 AS x, value / 50 AS y FROM events) SELECT round(avg((0.3 * x + 0.1 - y) * x), 6) AS g_w, round(avg(0.3 * x + 0.1 - y), 6) AS g_b FROM p")
def linear_gradient(spark, d):
    x, y = F.col("value") / 100, F.col("value") / 50
    e = 0.3 * x + 0.1 - y
    return rounded(table(spark, d, "events").agg(F.avg(e * x).alias("g_w"), F.avg(e).alias("g_b")))


@query("SELECT event_id, round(1 / (1 + exp(-greatest(-500, least(500, value - 50)))), 6) AS sigmoid, round((exp(2 * (value / 100 - 0.5)) - 1) / (exp(2 * (value / 100 - 0.5)) + 1), 6) AS tanh, greatest(value - 50, 0) AS relu, round(CASE WHEN value - 50 >= 0 THEN value - 50 ELSE 0.01 * (value - 50) END, 6) AS leaky_relu FROM events")
def activations(spark, d):
    z = F.col("value") - 50
    f = {n: activation(n).column for n in ("sigmoid", "relu", "leaky_relu", "tanh")}
    out = table(spark, d, "events").select("event_id", f["sigmoid"](z).alias("sigmoid"), f["tanh"](F.col("value") / 100 - 0.5).alias("tanh"), f["relu"](z).alias("relu"), f["leaky_relu"](z).alias("leaky_relu"))
    return rounded(out, 6, "sigmoid", "tanh", "leaky_relu")


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings) SELECT vec_id, round(embedding[1] * least(1.0, 0.5 / norm), 6) AS first, round(norm * least(1.0, 0.5 / norm), 6) AS norm FROM n")
def clip_norm(spark, d):
    v = F.col("embedding").cast("array<double>")
    by = F.least(F.lit(1.0), F.lit(0.5) / l2_norm(v))
    out = table(spark, d, "embeddings").select("vec_id", scaled(v, by).alias("v"))
    return rounded(out.select("vec_id", F.col("v")[0].alias("first"), l2_norm(F.col("v")).alias("norm")))


@query("SELECT vec_id, round(embedding[1]::DOUBLE - 0.1 * (0.9 * embedding[2]::DOUBLE + embedding[1]::DOUBLE), 6) AS first FROM embeddings")
def momentum_step(spark, d):
    v = F.col("embedding").cast("array<double>")
    rolled = F.concat(F.slice(v, 2, 64), F.slice(v, 1, 1))
    velocity = added(scaled(rolled, F.lit(0.9)), v)
    return rounded(table(spark, d, "embeddings").select("vec_id", added(v, scaled(velocity, F.lit(-0.1)))[0].alias("first")))


@query("SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = 0")
def embedding_dot(spark, d):
    e = table(spark, d, "embeddings")
    first = e.where("vec_id = 0").first()
    other = F.array(*map(F.lit, first["embedding"])) if first else F.expr("cast(array() as array<double>)")
    return rounded((e if first else e.limit(0)).select("vec_id", dot(F.col("embedding"), other).alias("similarity")), 5)


def _schedule_sql(later: str) -> str:
    return f"SELECT e::INTEGER AS epoch, round(CASE WHEN e <= 5 THEN 0.001 + (0.001 * sqrt(24) - 0.001) * e / 5 ELSE {later} END, 9) AS lr FROM range(1, 11) AS t(e)"


def _schedule(spark, kind, **more):
    return rounded(Schedule(1e-3, scaled_lr(1e-3, 24), 10, 5, kind, **more).table(spark), 9)


@query(_schedule_sql("0.001 * sqrt(24)"))
def lr_schedule_constant(spark, d):
    return _schedule(spark, "constant")


@query(_schedule_sql("0.001 * sqrt(24) * pow(0.5, (e - 5) // 2)"))
def lr_schedule_step(spark, d):
    return _schedule(spark, "step", step_size=2)


@query(_schedule_sql("0.001 * sqrt(24) * pow(0.5, e // 2)"))
def lr_schedule_step_from_start(spark, d):
    return _schedule(spark, "step", step_size=2, step_from_start=True)


@query(_schedule_sql("0.001 + 0.5 * (0.001 * sqrt(24) - 0.001) * (1 + cos(pi() * (e - 5) / 5))"))
def lr_schedule_cosine(spark, d):
    return _schedule(spark, "cosine")


@query(f"""WITH RECURSIVE h AS (SELECT epoch, test_rmse::DOUBLE AS v FROM {_SERIES_SQL}), t AS (
  SELECT 0 AS epoch, 1e308::DOUBLE AS best, 0 AS best_epoch, 0 AS misses
  UNION ALL SELECT h.epoch, CASE WHEN h.v + 1e-6 < t.best THEN h.v ELSE t.best END, CASE WHEN h.v + 1e-6 < t.best THEN h.epoch ELSE t.best_epoch END, CASE WHEN h.v + 1e-6 < t.best THEN 0 ELSE t.misses + 1 END
  FROM t JOIN h ON h.epoch = t.epoch + 1 WHERE t.misses < 3)
SELECT best_epoch::INTEGER AS best_epoch, best AS best_value, epoch::INTEGER AS stop_epoch FROM t ORDER BY epoch DESC LIMIT 1""")
def early_stop_trace(spark, d):
    return S.early_stop_trace(_series(spark))


@query(f"SELECT 7 AS best_epoch, min(test_rmse)::DOUBLE AS best_value FROM {_SERIES_SQL}")
def best_epoch(spark, d):
    return S.best_epoch(_series(spark))


@query("SELECT event_id AS k, value FROM events WHERE event_id % 50 = 0")
def log_every_k(spark, d):
    return S.every(table(spark, d, "events").select(F.col("event_id").alias("k"), "value"), 50)


# ---------------------------------------------------------------- experiments

CHOICES = {"mpi_processes": [4, 8, 12, 16, 24], "activation": ["relu", "tanh", "leaky_relu"], "batch": [1024, 16384, 98304, 2_000_000], "hidden": [32, 64]}
_GRID = " CROSS JOIN ".join("(VALUES " + ", ".join(f"('{v}')" if isinstance(v, str) else f"({v}::BIGINT)" for v in vs) + f") AS {k}_(\"{k}\")" for k, vs in CHOICES.items())
_NAMED = f"SELECT *, greatest(1, least(128, 1000000 // batch))::INTEGER AS q_super, 'mpi_processes-' || mpi_processes || '__activation-' || activation || '__batch-' || batch || '__hidden-' || hidden AS name FROM {_GRID}"


def _runs(spark):
    return X.grid(spark, CHOICES).withColumn("q_super", X.super_batches(F.col("batch"))).withColumn("name", X.run_name([*CHOICES]))


@query(_NAMED)
def experiment_grid(spark, d):
    return _runs(spark)


@query(f"SELECT name FROM ({_NAMED}) WHERE NOT (hidden = 64 AND mpi_processes < 16)")
def experiment_pending(spark, d):
    runs = _runs(spark)
    done = runs.select("name", (F.col("hidden") == 64).alias("success"), F.lit(1.0).alias("time"), "mpi_processes").where("mpi_processes < 16")
    return X.pending(runs, done).select("name")


@query(f"SELECT count(*) AS n_runs, count(*) FILTER (hidden = 64) AS n_success, sum(batch / 1000.0) AS total_time FROM ({_NAMED})")
def experiment_tally(spark, d):
    return X.tally(_runs(spark).select("name", (F.col("hidden") == 64).alias("success"), (F.col("batch") / 1000).alias("time")))


@query(f"SELECT name, hidden = 64 AS success, (batch / 1000.0)::DOUBLE AS time FROM ({_NAMED})")
def results_round_trip(spark, d):
    """Results appended in two parts, summed up in one record and read back."""
    path, folder = work_folder(spark, "results"), work_folder(spark, "summary")
    done = _runs(spark).select("name", (F.col("hidden") == 64).alias("success"), (F.col("batch") / 1000).alias("time"))
    for part in (True, False):
        H.write_results(done.where(F.col("success") == part), path)
    H.write_summary(spark, folder, {"epochs": 10}, spark.read.schema("name string, success boolean, time double").json(path))
    return H.read_summary(spark, folder).select(F.explode("results").alias("r")).select("r.*")


@query("SELECT page_id, regexp_replace(url, '\\.[^./]+$', '') || '_X_train.parquet' AS path FROM pages")
def path_templates(spark, d):
    return table(spark, d, "pages").select("page_id", M.store_path(F.col("url"), "X", "train").alias("path"))


# ---------------------------------------------------------------- streaming


@query("SELECT event_type, count(*) AS n_rows, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1")
def streaming_stats(spark, d):
    path = os.path.join(d, "events.parquet")
    stream = ST.stream_table(spark, os.path.join(d, "events*.parquet"), spark.read.parquet(path).schema)
    return ST.drained(ST.running_stats(stream, ["value"], ["event_type"]), f"stats_{uuid.uuid4().hex}", work_folder(spark, "stream"))


@query(ORACLES["nn_gradient"])
def streaming_gradient(spark, d):
    """A message for each micro-batch of the events as a stream, summed."""
    total, n = np.zeros(Network(2, 2).size), 0

    def act(df):
        nonlocal total, n
        m = reduced(_points(df), Network(2, 2), THETA)
        total, n = total + m.gradient, n + m.n

    stream = ST.stream_table(spark, os.path.join(d, "events*.parquet"), spark.read.parquet(os.path.join(d, "events.parquet")).schema)
    ST.for_each_batch(stream, act, work_folder(spark, "stream"))
    return rounded(spark.createDataFrame([(i, float(g / n)) for i, g in enumerate(total)], "i int, gradient double"), 5)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS from_ts, event_type, count(*) AS n_rows FROM events GROUP BY 1, 2")
def streaming_windows(spark, d):
    stream = ST.stream_table(spark, os.path.join(d, "events*.parquet"), spark.read.parquet(os.path.join(d, "events.parquet")).schema)
    counts = ST.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 hour", ["event_type"])
    found = ST.drained(counts, f"windows_{uuid.uuid4().hex}", work_folder(spark, "stream"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("from_ts"), "event_type", "n_rows")


# ---------------------------------------------------------------- training


def _steps_sql(batches: list[str], *, lr: float, momentum: float, clip: float, decay: float) -> str:
    """CTEs of clipped heavy-ball updates of the network of two units, one over each batch (a condition on pts): t0 has theta and velocity at
    the beginning, t{k} after k updates, g{k} the loss that update k + 1 starts from."""
    theta = "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in THETA) + "]"
    parts = ["pts AS (SELECT event_id AS row_idx, (value / 100)::FLOAT::DOUBLE AS a, ((event_id % 7) / 7.0)::FLOAT::DOUBLE AS b, (value / 50)::FLOAT::DOUBLE AS y FROM events)", f"t0 AS (SELECT {theta} AS t, list_transform({theta}, lambda x: 0.0::DOUBLE) AS v)"]
    for k, batch in enumerate(batches):
        unit = lambda z: f"CASE WHEN {z} >= 0 THEN {z} ELSE 0.01 * {z} END"
        slope = lambda z: f"CASE WHEN {z} >= 0 THEN 1 ELSE 0.01 END"
        parts += [
            f"z{k} AS (SELECT a, b, y, t, t[4] * a + t[5] * b + t[8] AS z1, t[6] * a + t[7] * b + t[9] AS z2 FROM pts, t{k} WHERE {batch})",
            f"h{k} AS (SELECT *, {unit('z1')} AS a1, {unit('z2')} AS a2, {slope('z1')} AS d1, {slope('z2')} AS d2 FROM z{k})",
            f"e{k} AS (SELECT *, t[1] * a1 + t[2] * a2 + t[3] - y AS e FROM h{k})",
            f"s{k} AS (SELECT any_value(t) AS t, count(*) AS n, sum(e * e) AS sse, [sum(e * a1), sum(e * a2), sum(e), sum(e * t[1] * d1 * a), sum(e * t[1] * d1 * b), sum(e * t[2] * d2 * a), sum(e * t[2] * d2 * b), sum(e * t[1] * d1), sum(e * t[2] * d2)] AS g FROM e{k})",
            f"g{k} AS (SELECT t, 0.5 * sse / n + 0.5 * {decay} * list_sum(list_transform(list_filter(t, lambda x, i: i NOT IN (3, 8, 9)), lambda x: x * x)) AS loss, list_transform(g, lambda x, i: x / n + CASE WHEN i IN (3, 8, 9) THEN 0 ELSE {decay} * t[i] END) AS g FROM s{k})",
            f"c{k} AS (SELECT t, list_transform(g, lambda x: x * least(1.0::DOUBLE, {clip} / sqrt(list_sum(list_transform(g, lambda q: q * q))))) AS g FROM g{k})",
            f"v{k} AS (SELECT c{k}.t, list_transform(g, lambda x, i: {momentum} * t{k}.v[i] + x) AS v FROM c{k}, t{k})",
            f"t{k + 1} AS (SELECT list_transform(t, lambda x, i: x - {lr} * v[i]) AS t, v FROM v{k})",
        ]
    return "WITH " + ", ".join(parts)


_RULE = {"lr": 0.1, "momentum": 0.9, "clip": 0.2, "decay": 0.01}
_ALL = _steps_sql(["true"] * 3, **_RULE)
_HALF = f"((7919 * row_idx + 104729) % {_N}) // ((SELECT count(*) + 1 FROM events) // 2) = "
_HALVES = _steps_sql([_HALF + "0", _HALF + "1"] * 2, **_RULE)
_THETA_SQL = "SELECT (i - 1)::INTEGER AS i, round(t[i], 5) AS theta FROM {t}, range(1, 10) AS r(i)"


def _small(spark, d, epochs, **settings):
    """A trainer of the network of two units over _points, with the rule of the SQL."""
    c = X.TrainConfig(hidden=2, epochs=epochs, warmup=0, schedule="constant", lr=_RULE["lr"], momentum=_RULE["momentum"], clip=_RULE["clip"], weight_decay=_RULE["decay"], **settings)
    return Trainer(Network(2, 2), c, THETA.copy()).fit(_points(table(spark, d, "events")))


def _theta(spark, trainer):
    return rounded(spark.createDataFrame([(i, float(x)) for i, x in enumerate(trainer.theta)], "i int, theta double"), 5)


@query(f"{_ALL} {_THETA_SQL.format(t='t3')}")
def train_full_batch_theta(spark, d):
    return _theta(spark, _small(spark, d, 3, mode="full_batch"))


@query(f"{_ALL} " + " UNION ALL ".join(f"SELECT {k + 1} AS epoch, round(loss, 5) AS loss FROM g{k}" for k in range(3)))
def train_full_batch_losses(spark, d):
    return rounded(H.history_frame(spark, _small(spark, d, 3, mode="full_batch").history).select("epoch", "loss"), 5)


@query(f"{_HALVES} {_THETA_SQL.format(t='t4')}")
def train_superbatch_theta(spark, d):
    """Two epochs of two batches of an affine permutation, read as one superbatch."""
    n = table(spark, d, "events").count()
    return _theta(spark, _small(spark, d, 2, mode="minibatch", batch=(n + 1) // 2, key=(7919, 104729)))


@query(f"{_HALVES} {_THETA_SQL.format(t='t4')}")
def train_minibatch_theta(spark, d):
    """The same updates, a job for each batch."""
    n = table(spark, d, "events").count()
    return _theta(spark, _small(spark, d, 2, mode="minibatch", batch=(n + 1) // 2, key=(7919, 104729), q_super=1))


@query(f"{_steps_sql(['true'], **_RULE)}, zs AS (SELECT row_idx, t, t[4] * a + t[5] * b + t[8] AS z1, t[6] * a + t[7] * b + t[9] AS z2 FROM pts, t1) SELECT row_idx, round(t[1] * CASE WHEN z1 >= 0 THEN z1 ELSE 0.01 * z1 END + t[2] * CASE WHEN z2 >= 0 THEN z2 ELSE 0.01 * z2 END + t[3], 5) AS prediction FROM zs")
def score_batch(spark, d):
    """Trained for an epoch, then scored."""
    trainer = _small(spark, d, 1, mode="full_batch")
    return rounded(scored(_points(table(spark, d, "events")), trainer.network, trainer.theta).select("row_idx", "prediction"), 5)


# ---------------------------------------------------------------- training on trips: fitted values, which tests compare with plain loops


def training_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Standard-scaled trips as (train, test) matrices."""
    raw = trips(spark, d)
    rows = W.exact_split(C.engineer_16(raw), raw.count())
    scaled_rows = N.StandardScaler(FEATURES_16, TARGET).fit(rows.where("split = 'train'")).transform(rows)
    matrix = C.assemble(scaled_rows, FEATURES_16, keep=["row_idx", "split"])
    return matrix.where("split = 'train'"), matrix.where("split = 'test'")


def trained(spark: SparkSession, d: str, **settings) -> Trainer:
    """Three epochs on trips; the sets are cached for as long as it takes."""
    train, test = (x.persist() for x in training_sets(spark, d))
    if settings["mode"] == "minibatch":
        settings = {"batch": max(256, -(-train.count() // 8))} | settings
    config = X.TrainConfig(**{"hidden": 16, "epochs": 3, "warmup": 0, "lr": 0.05, "schedule": "constant", "weight_decay": 0.0} | settings)
    try:
        return Trainer(Network(len(FEATURES_16), config.hidden, config.activation), config).fit(train, test)
    finally:
        train.unpersist()
        test.unpersist()


@query(f"{_steps_sql(['row_idx % 2 = 0'], **_RULE)} {_THETA_SQL.format(t='t1')}")
def train_transformed_theta(spark, d):
    """A transform of the caller's, applied before an epoch of training."""
    c = X.TrainConfig(mode="full_batch", hidden=2, epochs=1, warmup=0, schedule="constant", lr=_RULE["lr"], momentum=_RULE["momentum"], clip=_RULE["clip"], weight_decay=_RULE["decay"])
    points = _points(table(spark, d, "events"))
    return _theta(spark, Trainer(Network(2, 2), c, THETA.copy()).fit(points, transform=lambda df: df.where("row_idx % 2 = 0")))


@query()
def train_full_batch(spark, d):
    return H.history_frame(spark, trained(spark, d, mode="full_batch").history)


@query()
def train_sampled(spark, d):
    return H.history_frame(spark, trained(spark, d, mode="sampled", batch=256, workers=4, lr_scaling="none").history)


@query()
def train_minibatch(spark, d):
    return H.history_frame(spark, trained(spark, d, mode="minibatch").history)


@query()
def train_block_shuffle(spark, d):
    return H.history_frame(spark, trained(spark, d, mode="minibatch", shuffle="block", batch=1024, workers=2, lr_scaling="none").history)


@query()
def train_local_shuffle(spark, d):
    return H.history_frame(spark, trained(spark, d, mode="minibatch", shuffle="local", batch=1024, workers=2, lr_scaling="none").history)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Trips to cleaned, engineered, standard-scaled features; one row of their statistics."""
    df = C.engineer_16(trips(spark, d))
    scaled_rows = N.StandardScaler(FEATURES_16, TARGET).fit_transform(df)
    return rounded(scaled_rows.agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{n}_{c}") for c in ("trip_duration", TARGET) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]))


@query(f"WITH {TRIPS}, s AS (SELECT avg(total_amount) AS m, stddev_pop(total_amount) AS v, avg(trip_duration) AS dm, stddev_pop(trip_duration) AS dv FROM rides) SELECT count(*) AS n_rows, round(avg((trip_duration - dm) / dv), 6) + 0.0 AS mean_trip_duration, round(min((trip_duration - dm) / dv), 6) AS min_trip_duration, round(max((trip_duration - dm) / dv), 6) AS max_trip_duration, round(avg((total_amount - m) / v), 6) + 0.0 AS mean_total_amount, round(min((total_amount - m) / v), 6) AS min_total_amount, round(max((total_amount - m) / v), 6) AS max_total_amount FROM rides, s")
def scaled_statistics(spark, d):
    return flagship(spark, d).withColumns({c: F.col(c) + 0.0 for c in ("mean_trip_duration", "mean_total_amount")})


