import math
from math import gcd

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from orrery.operators import indexing as I, scaling as N, splitting as W, stats as A


@pytest.mark.parametrize("n, shards", [(10, 3), (7, 4), (3, 5), (0, 2)])
def test_shards_cover_everything(spark, n, shards):
    bounds = I.shard_bounds(n, shards)
    assert bounds[0][0] == 0 and bounds[-1][1] == n and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    got = dict(spark.range(n).select("id", I.shard_of(F.col("id"), n, shards)).collect())
    assert all(got[i] == s for s, (lo, hi) in enumerate(bounds) for i in range(lo, hi))


@pytest.mark.parametrize("n, a", [(97, 5), (100, 7), (1, 1)])
def test_permutation_is_a_bijection(spark, n, a):
    df = spark.range(n).select("id", I.permute(F.col("id"), n, a, 13).alias("p"))
    rows = df.select("id", "p", I.unpermute(F.col("p"), n, a, 13).alias("back")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)
    if n == 100:
        with pytest.raises(ValueError):
            I.permute(F.col("id"), n, 10, 0)


def test_permutation_of_a_huge_table_is_exact(spark):
    n, a = 10**15 + 37, 10**14 + 3
    while gcd(a, n) != 1:
        a += 1
    df = spark.createDataFrame([(n - 1,), (12345678901234,)], "i long")
    rows = df.select("i", I.permute(F.col("i"), n, a, 5).alias("p")).collect()
    assert all(r["p"] == (a * r["i"] + 5) % n for r in rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 400), st.integers(0, 50))
def test_random_keys_are_coprime(n, seed):
    a, b = I.random_key(n, seed)
    assert gcd(a, n) == 1 and 0 <= b < max(n, 1)


def test_index_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    for parts in (1, 7):
        rows = I.dense_index(df.repartition(parts), ["v"]).collect()
        assert all(r["row_idx"] == r["v"] for r in rows)
    assert I.dense_index(df.limit(0), ["v"]).count() == 0


def test_exact_split_sizes(spark):
    df = spark.range(101).withColumnRenamed("id", "row_idx")
    for rounding, size in (("floor", 30), ("ceil", 31)):
        assert W.exact_split(df, 101, rounding=rounding).where("split = 'test'").count() == size


def test_minibatch_takes_all_of_a_small_shard(spark):
    df = spark.range(10).select(F.col("id").alias("row_idx"), F.lit(0).alias("shard"))
    assert W.minibatch(df, "shard", 99).count() == 10
    assert W.minibatch(df, "shard", 4, epoch=1).count() == 4


@pytest.mark.parametrize("n, size, batches", [(40, 10, 4), (41, 10, 5), (5, 10, 1)])
def test_batch_edges(spark, n, size, batches):
    assert spark.range(n).select(I.batch_of(F.col("id"), size).alias("b")).distinct().count() == batches


def test_constant_and_empty_columns_scale(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "c double, y double")
    assert [r["c"] for r in N.StandardScaler(["c"], "y").fit_transform(df).collect()] == [0.0, 0.0]
    assert [r["c"] for r in N.minmax_scale(df, ["c"]).collect()] == [0.0, 0.0]
    with pytest.raises(N.NotFitted):
        N.StandardScaler(["c"]).feature_names()
    with pytest.raises(ValueError):
        N.StandardScaler(["c"]).fit(df.limit(0))


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(5.0,), (7.0,)], "c double")
    scaler = N.StandardScaler([], "c").fit(df)
    assert scaler.stats["c"] == (6.0, 1.0)
    back = scaler.transform(df).select(scaler.inverse_target(F.col("c"))).collect()
    assert [r[0] for r in back] == [5.0, 7.0]


def test_errors_of_no_rows(spark):
    df = spark.createDataFrame([], "p double, y double")
    row = A.error_measures(df, F.col("p"), F.col("y"), empty=0.0).first()
    assert row["n"] == 0 and row["rmse"] == 0.0
    assert A.error_measures(df, F.col("p"), F.col("y")).first()["rmse"] is None
    with pytest.raises(A.NoValidRows):
        A.count_valid(df)


def test_dtype_bounds_are_strict(spark):
    df = spark.createDataFrame([(126, 127, 32767, 2**31, 1e39)], "a long, b long, c long, d long, e double")
    plan = {r["column_name"]: r["to_type"] for r in A.dtype_plan(df).collect()}
    assert plan == {"a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "double"}


def test_runs_rebuild_the_rows(spark):
    df = spark.createDataFrame([(0, p) for p in (3, 4, 5, 9, 11, 12)], "g int, p long")
    got = sorted((r["first"], r["n_rows"]) for r in I.runs(df, "g", "p").collect())
    assert got == [(3, 3), (9, 1), (11, 2)]


def test_rmse_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "p double, y double")
    assert A.error_measures(df, F.col("p"), F.col("y"), spread=10).first()["rmse_unscaled"] == pytest.approx(10 * math.sqrt(2.5))


def test_prefix_sums_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(I, "STRETCH", 3)
    df = spark.range(100).select((F.col("id") * F.col("id") % 23).alias("c"))
    rows = I.chunk_offsets(df, F.col("c")).orderBy("chunk").collect()
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_rows"]
    routed = I.route(spark.range(50).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split")))
    assert all(r["split_pos"] == (r["row_idx"] // 3 if r["split"] == "test" else r["row_idx"] - r["row_idx"] // 3 - 1) for r in routed.collect())


def test_sparse_rows_are_numbered_for_batches(spark):
    from orrery.plans.experiment import TrainConfig
    from orrery.plans.network import Network
    from orrery.plans.trainer import Trainer

    df = spark.createDataFrame([(7 * i, [float(i % 5)], float(i % 5)) for i in range(50)], "row_idx long, features array<float>, label float")
    t = Trainer(Network(1, 2), TrainConfig(batch=10, epochs=1, warmup=0, log_every=1)).fit(df)
    assert [s["k"] for s in t.steps] == [0, 1, 2, 3, 4]
