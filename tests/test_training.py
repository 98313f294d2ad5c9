import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions.activations import ACTIVATIONS, activation
from orrery.operators.indexing import random_key
from orrery.plans import experiment as X
from orrery.plans.network import Network
from orrery.plans.optimiser import Schedule, Sgd, clipped, scaled_lr
from orrery.plans.stopping import EarlyStop
from orrery.plans.trainer import Trainer, reduced, rmse
from orrery.queries import SERIES


@pytest.mark.parametrize("act", ACTIVATIONS)
@pytest.mark.parametrize("decay", [0.0, 1e-2])
def test_gradient_equals_finite_differences(act, decay):
    rng, net = np.random.default_rng(0), Network(3, 4, act)
    theta, x, y = net.init(1) + 0.05, rng.normal(size=(20, 3)), rng.normal(size=20)
    _, g = net.loss_and_gradient(theta, x, y, decay)
    for i in range(net.size):
        step = np.zeros(net.size)
        step[i] = 1e-6
        slope = (net.loss_and_gradient(theta + step, x, y, decay)[0] - net.loss_and_gradient(theta - step, x, y, decay)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-5)


def test_unknown_names_are_errors():
    for bad in (lambda: activation("step"), lambda: Schedule(1, 1, 1, kind="x"), lambda: scaled_lr(1, 1, "x"), lambda: Network(2).init(0, "x")):
        with pytest.raises(ValueError):
            bad()


def test_published_rates():
    s = Schedule(1e-3, scaled_lr(1e-3, 24), 10, 5)
    assert [round(s.at(e), 6) for e in (1, 5, 6, 10)] == [0.00178, 0.004899, 0.004527, 0.001]


def test_early_stop_of_a_recorded_series():
    stop = EarlyStop(3, 1e-6)
    ended = next(i for i, v in enumerate(SERIES, 1) if stop.update(i, v))
    assert (stop.best_epoch, ended) == (7, 10)


def test_clip_and_momentum():
    g = np.array([3.0, 4.0])
    assert np.allclose(clipped(g, 1.0), [0.6, 0.8]) and np.allclose(clipped(g, 10.0), g)
    sgd, theta = Sgd(momentum=0.5), np.zeros(2)
    theta = sgd.step(theta, g, 1.0)
    assert np.allclose(sgd.step(theta, g, 1.0), -(g + 1.5 * g))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3)).astype(np.float32)
    y = (np.tanh(x[:, 0]) + 0.5 * x[:, 1]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(500)], "row_idx long, features array<float>, label float")
    return df.repartition(3), x.astype(float), y.astype(float)


def test_message_does_not_depend_on_partitions(points):
    df, x, y = points
    net = Network(3, 5)
    theta = net.init(0)
    g, sse, _ = net.sums(theta, x, y)
    for parts in (1, 4):
        m = reduced(df.repartition(parts), net, theta)
        assert m.n == 500 and np.allclose(m.gradient, g) and m.sse == pytest.approx(sse)


def test_minibatch_epoch_equals_plain_loop(points):
    df, x, y = points
    net, c = Network(3, 5), X.TrainConfig(mode="minibatch", batch=128, epochs=2, warmup=0, lr=0.05, schedule="constant", seed=4)
    trainer = Trainer(net, c).fit(df)
    theta, sgd = net.init(c.seed), Sgd(c.momentum, c.clip)
    for epoch in (1, 2):
        a, b = random_key(500, c.seed + epoch)
        batch = (a * np.arange(500) + b) % 500 // 128
        for k in range(4):
            _, g = net.loss_and_gradient(theta, x[batch == k], y[batch == k], c.weight_decay)
            theta = sgd.step(theta, g, 0.05)
    assert np.allclose(trainer.theta, theta)


def test_training_beats_the_constant(points):
    df, _, y = points
    c = X.TrainConfig(mode="minibatch", batch=100, epochs=6, warmup=0, lr=0.1, schedule="constant")
    trainer = Trainer(Network(3, 8), c).fit(df, df)
    assert trainer.history[-1]["test_rmse"] < 0.7 * y.std()


def test_full_batch_stops_before_the_update(points):
    df, _, _ = points
    c = X.TrainConfig(mode="full_batch", epochs=9, patience=1, tolerance=1e9, warmup=0)
    trainer = Trainer(Network(3, 2), c).fit(df)
    assert trainer.stop_reason == "no improvement" and len(trainer.history) == 2


def test_rmse_of_no_rows_is_nan(points):
    df, _, _ = points
    net = Network(3, 2)
    assert math.isnan(rmse(df.limit(0), net, net.init(0)))


def test_column_network_equals_kernel(points):
    df, x, _ = points
    for act in ACTIVATIONS:
        net = Network(3, 2, act)
        theta = net.init(2)
        got = dict(df.select("row_idx", net.column(theta, F.col("features"))).collect())
        assert np.allclose([got[i] for i in range(500)], net.forward(theta, x))


def test_runs_continue_after_failures(spark):
    runs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, v int")
    done = spark.createDataFrame([("a", True)], "name string, success boolean")

    def run(config):
        if config["v"] == 2:
            raise RuntimeError("no")
        return config["v"]

    out = {r["name"]: r["success"] for r in X.run_all(runs, done, run).collect()}
    assert out == {"b": False, "c": True}


@pytest.mark.parametrize("shuffle", ["block", "local"])
@pytest.mark.parametrize("q_super", [1, 3])
def test_shuffles_equal_plain_loops(points, shuffle, q_super):
    """Blocks or permuted rows of two shards, one batch of each shard a step."""
    df, x, y = points
    net, c = Network(3, 4), X.TrainConfig(mode="minibatch", shuffle=shuffle, q_super=q_super, batch=60, workers=2, epochs=2, warmup=0, lr=0.05, lr_scaling="none", schedule="constant", seed=4)
    trainer = Trainer(net, c).fit(df)
    theta, sgd, orders = net.init(c.seed), Sgd(c.momentum, c.clip), []
    for epoch in (1, 2):
        steps = []
        for w, (lo, hi) in enumerate([(0, 250), (250, 500)]):
            if shuffle == "local":
                a, b = random_key(250, w + 12_345)
                steps.append([[lo + i for i in range(250) if (a * i + b) % 250 // 60 == k] for k in range(5)])
            else:
                a, b = random_key(5, c.seed + 100 * epoch + w)
                steps.append([[i for i in range(lo, hi) if (a * ((i - lo) // 60) + b) % 5 == k] for k in range(5)])
        orders.append(steps)
        for k in range(5):
            rows = steps[0][k] + steps[1][k]
            _, g = net.loss_and_gradient(theta, x[rows], y[rows], c.weight_decay)
            theta = sgd.step(theta, g, 0.05)
    assert np.allclose(trainer.theta, theta) and (orders[0] == orders[1]) == (shuffle == "local")
    assert all(h["compute_time_sum"] > 0 for h in trainer.history)


def test_superbatches_equal_single_batches(points):
    df, _, _ = points
    theta = [Trainer(Network(3, 4), X.TrainConfig(mode="minibatch", q_super=q, batch=40, epochs=2, warmup=0)).fit(df).theta for q in (1, 4, 100)]
    assert np.allclose(theta[0], theta[1]) and np.allclose(theta[0], theta[2])


def test_times_of_a_message(points):
    df, _, _ = points
    m = reduced(df, Network(3, 4), Network(3, 4).init(0))
    assert m.tasks == 3 and m.compute_time > 0 and m.io_time > 0


def test_overlong_runs_are_ended(spark):
    """A run that would take minutes in Spark is cancelled, and the next one still runs."""
    import time

    runs = spark.createDataFrame([("a", 600), ("b", 0)], "name string, v int")

    def run(config):
        if config["v"]:
            spark.range(0, 1 << 40, numPartitions=4).selectExpr("sum(hash(id))").collect()
        return 1.0

    began = time.monotonic()
    out = {r["name"]: (r["success"], r["error"]) for r in X.run_all(runs, spark.createDataFrame([], "name string, success boolean"), run, limit_s=3.0).collect()}
    assert out == {"a": (False, "over the time limit"), "b": (True, "")} and time.monotonic() - began < 60


def test_run_artefacts(spark, tmp_path):
    from orrery.sources import history as H

    H.write_artefacts(spark, str(tmp_path), "run-1", command="train --hidden 64", stderr="bad\nworse")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/run-1.stderr.txt").collect()] == ["bad", "worse"]
    assert spark.read.text(f"{tmp_path}/run-1.cmd.txt").first()[0] == "train --hidden 64" and not (tmp_path / "run-1.stdout.txt").exists()
    H.write_summary(spark, str(tmp_path), {}, spark.createDataFrame([], "name string, success boolean, time double"))
    assert H.read_summary(spark, str(tmp_path)).first()["results"] == []
