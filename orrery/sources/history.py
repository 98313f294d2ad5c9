"""Training history and run artefacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

HISTORY = T.StructType([
    T.StructField("epoch", T.IntegerType()), T.StructField("loss", T.DoubleType()), T.StructField("test_rmse", T.DoubleType()),
    T.StructField("lr", T.DoubleType()), T.StructField("time", T.DoubleType()), T.StructField("grad_norm", T.DoubleType()),
    *[T.StructField(f"{c}_time_sum", T.DoubleType()) for c in ("io", "compute", "comm")],
])
STEPS = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("train_rmse", T.DoubleType()), T.StructField("lr", T.DoubleType())])
RUN = T.StructType([
    T.StructField("config", T.MapType(T.StringType(), T.StringType())), T.StructField("best_rmse", T.DoubleType()), T.StructField("best_epoch", T.IntegerType()),
    T.StructField("history", T.ArrayType(HISTORY)), T.StructField("step_history", T.ArrayType(STEPS)),
])


def history_frame(spark: SparkSession, history: Sequence[Mapping]) -> DataFrame:
    return spark.createDataFrame([Row(**{f.name: h.get(f.name) for f in HISTORY}) for h in history], HISTORY)


def write_run(spark: SparkSession, path: str, config: Mapping, best_rmse: float, best_epoch: int, history: Sequence[Mapping], steps: Sequence[Mapping] = ()) -> None:
    """One JSON record; values that do not exist are null."""
    row = ({k: str(v) for k, v in config.items()}, best_rmse, best_epoch, [tuple(h.get(f.name) for f in HISTORY) for h in history], [tuple(s.get(f.name) for f in STEPS) for s in steps])
    spark.createDataFrame([row], RUN).coalesce(1).write.mode("overwrite").json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path)


def write_history_csv(df: DataFrame, path: str) -> None:
    """Epoch, loss, test_rmse with a header, in one file."""
    df.select("epoch", "loss", "test_rmse").coalesce(1).sortWithinPartitions("epoch").write.mode("overwrite").csv(path, header=True)


def read_history_csv(spark: SparkSession, path: str) -> DataFrame:
    """The series that a chart of loss and RMSE by epoch needs."""
    return spark.read.csv(path, header=True, schema="epoch int, loss double, test_rmse double")


def write_results(df: DataFrame, path: str) -> None:
    """One row for each run, appended as JSON."""
    df.write.mode("append").json(path)


def write_artefacts(spark: SparkSession, folder: str, name: str, *, command: str = "", stdout: str = "", stderr: str = "") -> None:
    """The command line and what the run named so printed, as {name}.cmd.txt, .stdout.txt and .stderr.txt; only those that are not empty."""
    for kind, text in (("cmd", command), ("stdout", stdout), ("stderr", stderr)):
        if text:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.{kind}.txt")


def write_summary(spark: SparkSession, folder: str, settings: Mapping, results: DataFrame) -> None:
    """{folder}/_summary.json: one record of the settings that all runs share and the results by name."""
    base = F.create_map(*[F.lit(x) for k, v in settings.items() for x in (k, str(v))]) if settings else F.expr("cast(map() as map<string,string>)")
    rows = results.agg(F.sort_array(F.collect_list(F.struct("name", "success", "time"))).alias("results"))
    rows.select(base.alias("base_config"), "results").coalesce(1).write.mode("overwrite").json(f"{folder}/_summary.json")


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("base_config map<string,string>, results array<struct<name:string,success:boolean,time:double>>").json(f"{folder}/_summary.json")
