"""Streaming metric rollup equals the batch aggregation over the same appended log."""

import datetime as dt

from pyspark.sql import functions as F

from plotrows.sources.sinks import append_metrics
from plotrows.streaming.metric_stream import read_rollup, start_rollup


def test_rollup_matches_batch(spark, tmp_path):
    log, out, ckpt = str(tmp_path / "log"), str(tmp_path / "rollup"), str(tmp_path / "ckpt")
    day = dt.datetime(2024, 1, 1)
    first = [(1, day, i, "loss", float(i)) for i in range(5)]
    second = [(1, day, 10 + i, "loss", 1.0) for i in range(3)] + [(2, day, 20, "loss", 7.0)]
    schema = "run long, epoch timestamp_ntz, step long, metric string, value double"
    append_metrics(spark.createDataFrame(first, schema), log)
    start_rollup(spark, log, out, ckpt).awaitTermination(120)
    append_metrics(spark.createDataFrame(second, schema), log)
    start_rollup(spark, log, out, ckpt).awaitTermination(120)
    got = {r.run: r for r in read_rollup(spark, out).collect()}
    assert got[1].n == 8 and got[1].total == 13.0 and abs(got[1].sample_mean - 13.0 / 8) < 1e-12
    assert got[2].n == 1 and got[2].max_value == 7.0
    batch = spark.read.parquet(log).groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.run: r.n for r in batch} == {1: 8, 2: 1}


def test_rollup_restart_is_idempotent(spark, tmp_path):
    """A restarted query with the same checkpoint emits nothing new; the table stays the same."""
    log, out, ckpt = str(tmp_path / "log"), str(tmp_path / "rollup"), str(tmp_path / "ckpt")
    day = dt.datetime(2024, 1, 2)
    rows = [(7, day, i, "loss", 0.5 * i) for i in range(6)]
    schema = "run long, epoch timestamp_ntz, step long, metric string, value double"
    append_metrics(spark.createDataFrame(rows, schema), log)
    start_rollup(spark, log, out, ckpt).awaitTermination(120)
    first = sorted(tuple(r) for r in read_rollup(spark, out).collect())
    start_rollup(spark, log, out, ckpt).awaitTermination(120)
    assert sorted(tuple(r) for r in read_rollup(spark, out).collect()) == first
    assert first[0][3] == 6 and first[0][4] == 7.5
