"""Loss/accuracy rollups, running mean, best-so-far, registry, guards vs brute force."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotrows.operators import metrics as M


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 4), i, round(rnd.uniform(0, 3), 3)) for i in range(700)]
    return rows, spark.createDataFrame(rows, "run long, epoch long, step long, value double")


def test_epoch_loss_two_level(log):
    rows, df = log
    got = {(r.run, r.epoch): r for r in M.epoch_loss(df, ["run", "epoch"], ["step"], "value", 8).collect()}
    pdf = pd.DataFrame(rows, columns=["run", "epoch", "step", "value"]).sort_values("step")
    for (run, ep), g in pdf.groupby(["run", "epoch"]):
        vals = list(g["value"])
        batches = [vals[i:i + 8] for i in range(0, len(vals), 8)]
        mob = sum(sum(b) / len(b) for b in batches) / max(len(batches), 1)
        r = got[(run, ep)]
        assert r.n_samples == len(vals) and r.n_batches == len(batches)
        assert abs(r.mean_of_batches - mob) < 1e-9
        assert abs(r.sample_mean - sum(vals) / len(vals)) < 1e-9


def test_running_mean_and_best(log):
    rows, df = log
    rm = {r.step: r for r in M.running_mean(df, ["run"], ["step"], "value", every=50).collect()}
    pdf = pd.DataFrame(rows, columns=["run", "epoch", "step", "value"]).sort_values("step")
    for run, g in pdf.groupby("run"):
        vals = list(g["value"])
        for i, (step, _) in enumerate(zip(g["step"], vals)):
            assert abs(rm[step].running_mean - sum(vals[:i + 1]) / (i + 1)) < 1e-9
            assert rm[step].reported == ((i + 1) % 50 == 0)
    ep = df.groupBy("run", "epoch").agg(F.avg("value").alias("loss"))
    best = {(r.run, r.epoch): r.is_best for r in M.best_so_far(ep, ["run"], ["epoch"], "loss").collect()}
    e = pdf.groupby(["run", "epoch"])["value"].mean().reset_index()
    for run, g in e.groupby("run"):
        cur = 1e5
        for ep_, loss in zip(g["epoch"], g["loss"] if "loss" in g else g["value"]):
            assert best[(run, ep_)] == (loss < cur)
            cur = min(cur, loss)


def test_best_accuracy_ties_keep_earlier(spark):
    df = spark.createDataFrame([(0, 0, 50.0), (0, 1, 50.0), (0, 2, 60.0), (0, 3, 10.0)], "g int, e int, acc double")
    got = [r.is_best for r in M.best_so_far(df, ["g"], ["e"], "acc", higher_is_better=True).orderBy("e").collect()]
    assert got == [True, False, True, False]


def test_registry_paths(spark):
    losses, train = [0.65064, 0.7, 0.12345], [0.9, 0.00005, 1.00005]
    df = spark.createDataFrame([(1, i, v, t) for i, (v, t) in enumerate(zip(losses, train))], "run long, e long, loss double, train_loss double")
    rows = M.checkpoint_registry(df, "run", "e", "loss", "train_loss").orderBy("e").collect()
    assert [r.path for r in rows] == [f"model_run_1_epoch_{i}_loss_{v:.4f}.bin" for i, v in enumerate(train)]
    assert [r.best_path for r in rows] == ["best_model_run_1_epoch_0_loss_0.6506.bin", None, f"best_model_run_1_epoch_2_loss_{0.12345:.4f}.bin"]


def test_empty_epoch_reports_zero(spark):
    none = spark.createDataFrame([], "id long, ce double")
    row = M.epoch_loss(none, [], ["id"], "ce", 8).first()
    assert (row.n_samples, row.n_batches, row.mean_of_batches, row.sample_mean) == (0, 0, 0.0, 0.0)


def test_moments_of_large_values(spark):
    df = spark.createDataFrame([(0, [1e8 + i / 10 for i in range(1, 9)])], "b int, a array<double>")
    assert abs(M.batch_moments(df, "a", "b").first().batch_std - 0.2449489742783178) < 1e-6


def test_value_counts_and_guard(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",), ("c",)], "t string")
    vc = [(r.t, r.n, r["rank"]) for r in M.value_counts(df, "t").orderBy("rank").collect()]
    assert vc == [("b", 2, 0), ("c", 2, 1), ("a", 1, 2)]
    g = M.row_count_guard(df, df.limit(2)).first()
    assert (g.n_left, g.n_right, g.counts_match) == (6, 2, False)
    with pytest.raises(Exception):
        M.row_count_guard(df, df.limit(2), strict=True).collect()


def test_batch_moments_sample_std(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0]), (1, [5.0, 7.0])], "b int, a array<double>")
    got = {r.b: r for r in M.batch_moments(df, "a", "b").collect()}
    assert got[0].batch_mean == 2.0 and abs(got[0].batch_std - 1.0) < 1e-12
    assert got[1].batch_mean == 6.0 and abs(got[1].batch_std - 2 ** 0.5) < 1e-12
