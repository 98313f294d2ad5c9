import pytest
from pyspark.sql import functions as F

from orrery.functions import clean
from orrery.schema import FEATURES_8, RAW
from orrery.sources import matrix, text


def test_timestamps(spark):
    values = ["01/31/2022 02:55:03 PM", "1/3/2022 2:55:03 PM", "1/3/2022 2:55:03 pm", "1/3/2022 12:00:00 AM", " 1/3/2022 2:55:03 PM", "1/3/2022 13:00:00 PM", "13/3/2022 2:55:03 PM", "bad", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(clean.parse_timestamp(F.col("v")).cast("string")).collect()]
    assert got == ["2022-01-31 14:55:03", "2022-01-03 14:55:03", "2022-01-03 14:55:03", "2022-01-03 00:00:00", None, None, None, None, None]
    with pytest.raises(Exception):
        df.select(clean.parse_timestamp_strict(F.col("v"))).collect()


def test_numbers(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["1.5", " 1.5 ", "1e3", "", "NaN", "x", None])], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(clean.to_number(F.col("v"))).collect()] == [1.5, 1.5, 1000.0, None, None, None, None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-5.0,), (None,), (2000.0,), (3.0,)], "v double")
    assert [r[0] for r in df.select(clean.clip(F.col("v"), 0, 1440)).collect()] == [0.0, None, 1440.0, 3.0]


def test_missing_column_fails_early(spark):
    with pytest.raises(clean.MissingColumns, match="b"):
        clean.require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b"])


def test_empty_frame_keeps_schema(spark, tmp_path):
    raw = spark.createDataFrame([], "row_idx long, " + ", ".join(f"{c} string" for c in RAW))
    assert clean.engineer_8(raw).count() == 0 and clean.engineer_16(raw).count() == 0
    rows = clean.assemble(clean.engineer_8(raw), FEATURES_8).withColumn("split", F.lit("train"))
    matrix.write_matrix(rows, str(tmp_path / "m"))
    assert text.empty_like(raw).schema == raw.schema


def test_csv_columns_by_name(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("other,total_amount,extra\n1,2.5,x\n2,3.5,1\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("extra", T.StringType()), T.StructField("total_amount", T.StringType())])
    assert text.csv_header(spark, path) == ["other", "total_amount", "extra"]
    assert [tuple(r) for r in text.read_csv(spark, path, schema).collect()] == [("x", "2.5"), ("1", "3.5")]
    with pytest.raises(ValueError, match="absent"):
        text.read_csv(spark, path, schema, columns=["absent"])


def test_offset_falls_back_to_head(spark):
    df = spark.range(10).withColumnRenamed("id", "row_idx")
    assert [r[0] for r in text.offset_sample(df, 8, 5).collect()] == [8, 9]
    assert [r[0] for r in text.offset_sample(df, 100, 2).collect()] == [0, 1]


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_exact_median(spark, monkeypatch, most):
    import statistics

    from orrery.functions import clean as C

    monkeypatch.setattr(C, "MEDIAN_VALUES", most)
    monkeypatch.setattr(C, "MEDIAN_BUCKETS", 7)
    for values in ([3.0], [2.0] * 40 + [9.0], [float(i * i % 101) for i in range(300)], [1e-300, 1e300, -1e300, 5.0], [0.1 * i for i in range(101)] + [7.0] * 200):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        assert C.exact_median(df, "v") == statistics.median(values)
    assert C.exact_median(spark.createDataFrame([(None,)], "v double"), "v") is None
