"""Names, types and ranges of the trip tables."""

from pyspark.sql import types as T

# The columns of a raw trip file, its timestamp format and the accepted ranges.
PICKUP, DROPOFF, TARGET = "tpep_pickup_datetime", "tpep_dropoff_datetime", "total_amount"
NUMERIC = ["passenger_count", "trip_distance", "RatecodeID", "PULocationID", "DOLocationID", "payment_type", "extra"]
RAW = [PICKUP, DROPOFF, *NUMERIC, TARGET]
TIMESTAMP_FORMAT = "M/d/yyyy h:m:s a"
RANGES = {"total_amount": (0, 1000), "trip_distance": (0, 100), "passenger_count": (1, 8), "extra": (0, None)}
DURATION_CLIP, DURATION_RANGE = (0, 1440), (0, 300)
CALENDAR = [f"{side}_{part}" for side in ("pickup", "dropoff") for part in ("hour", "day", "month", "weekday")]
FEATURES_8 = [*NUMERIC, "time_on_taxi"]
FEATURES_16 = [*NUMERIC, *CALENDAR, "trip_duration"]
CHUNK_ROWS, HEAD_ROWS, TEST_RATIO, SEED = 50_000, 100_000, 0.3, 42

#: Everything arrives as text; types are given by the tolerant casts of functions.clean.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW])
MATRIX_SCHEMA = T.StructType([T.StructField("row_idx", T.LongType()), T.StructField("features", T.ArrayType(T.FloatType())), T.StructField("label", T.FloatType()), T.StructField("split", T.StringType())])
