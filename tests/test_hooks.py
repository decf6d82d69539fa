"""Caller-supplied functions: per-row transforms and per-batch collates."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from plotrows.operators import metrics as M
from plotrows.operators.hooks import collate_batches, transform_rows


def half_or_fail():
    def call(batch):
        v = batch["v"].to_pylist()
        if any(x is not None and x % 10 == 7 for x in v):
            raise ValueError("seven")
        return {"half": [None if x is None else x / 2 for x in v], "twice": pc.multiply(batch["v"], 2)}
    return call


def test_failing_rows_alone_get_errors(spark):
    df = spark.range(95).select("id", F.when(F.col("id") % 11 != 4, F.col("id")).alias("v"), F.lit("kept").alias("other"))
    rows = transform_rows(df, half_or_fail, ["v"], "half double, twice long", rows_per_call=16).collect()
    assert len(rows) == 95 and {r.other for r in rows} == {"kept"}
    for r in rows:
        if r.v is not None and r.v % 10 == 7:
            assert (r.half, r.twice, r.error) == (None, None, "ValueError: seven")
        else:
            assert (r.half, r.twice, r.error) == (None if r.v is None else r.v / 2, None if r.v is None else r.v * 2, None)


def broken():
    raise OSError("no model")


def short():
    return lambda batch: {"half": [0.0] * (batch.num_rows - 1)}


def test_a_hook_that_cannot_load_or_loses_rows_is_an_error(spark):
    df = spark.range(5).withColumn("v", F.col("id"))
    assert {r.error for r in transform_rows(df, broken, ["v"], "half double").collect()} == {"OSError: no model"}
    lost = transform_rows(df, short, ["v"], "half double", error="why").collect()
    assert len(lost) == 5 and all("rows for 1" in r.why for r in lost)


def test_empty_input_and_replaced_columns(spark):
    df = spark.createDataFrame([], "id long, v long, half string")
    out = transform_rows(df, half_or_fail, ["v"], "half double, twice long")
    assert out.collect() == [] and dict(out.dtypes)["half"] == "double"


def test_only_the_named_columns_go_to_python(spark):
    df = spark.range(3).select("id", F.col("id").alias("v"), F.repeat(F.lit("x"), 1000).alias("text"))
    plan = transform_rows(df, half_or_fail, ["v"], "half double, twice long")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


def joined():
    def call(table):
        return {"n": [table.num_rows], "text": [",".join(map(str, table["x"].to_pylist()))]}
    return call


def two_rows():
    return lambda table: pa.table({"n": [table.num_rows, -1], "text": ["a", "b"]})


def test_collate_sees_whole_batches_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), F.floor((F.col("id") * 37 % 1000) / 8).alias("b"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # batches cross Arrow batches
    try:
        rows = collate_batches(df, joined, "b", ["x"], [], "n long, text string", max_rows=8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.b: r.text for r in rows} == {b: ",".join(str(8 * b + i) for i in range(8)) for b in range(125)}
    assert {r.n for r in rows} == {8}
    more = collate_batches(df, two_rows, "b", ["x"], [], "n int, text string").collect()
    assert len(more) == 250 and {r.text for r in more} == {"a", "b"}


def test_collate_refuses_unbounded_batches(spark):
    df = spark.range(100).select(F.lit(1).alias("b"), F.col("id").alias("x"))
    with pytest.raises(Exception, match="more than 50 rows"):
        collate_batches(df, joined, "b", ["x"], [], "n long, text string", max_rows=50).collect()


def test_collate_null_batch_and_empty_input(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 4)], "b long, x long")
    rows = collate_batches(df, joined, "b", ["x"], [], "n long, text string").collect()
    assert {(r.b, r.text) for r in rows} == {(None, "1,2"), (3, "4")}
    assert collate_batches(df.where("x > 9"), joined, "b", ["x"], [], "n long, text string").collect() == []


def test_standardize_defines_constant_batches(spark):
    rows = [(1, "a", [2.0, 2.0]), (2, "a", [2.0]), (3, "b", [7.0]), (4, "c", [1.0, 3.0]), (5, "c", []), (6, "d", [1e9 + 1, 1e9 + 2, 1e9 + 3])]
    df = spark.createDataFrame(rows, "id int, b string, v array<double>")
    z = {r.id: r.z for r in M.standardize(df, "v", "b", out="z").collect()}
    assert z[1] == [0.0, 0.0] and z[2] == [0.0] and z[3] == [0.0] and z[5] == []
    assert z[4] == pytest.approx([-(0.5 ** 0.5), 0.5 ** 0.5]) and z[6] == pytest.approx([-1, 0, 1])
