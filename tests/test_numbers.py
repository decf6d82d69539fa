"""Python-compatible parsing/printing/rounding, checked against Python built-ins."""

import math
import random

from pyspark.sql import functions as F

from plotrows.functions.numbers import argmax, fixed_text, py_float, py_round, py_str, py_strip, softmax

FLOAT_TOKENS = ["1.5", " 1.5 ", "\t3", "1.", "+.5", "1e5", "1E-7", "-2.5e+3", "Inf", "-infinity", "nan",
                "-nan", "NaN", "1_000", "1__0", "_1", "1.5d", "1.5f", "0x10", "1,000", "", " ", "abc",
                "1e400", "-0", ".", "e5", "1e", "12345678", "007", "+-1", "1.2.3", "inf5", "0.0001"]


def py_float_ref(s):
    try:
        return float(s)
    except ValueError:
        return None


def test_py_float_matches_python(spark):
    df = spark.createDataFrame([(t,) for t in FLOAT_TOKENS], "t string")
    got = {r.t: r.f for r in df.select("t", py_float("t").alias("f")).collect()}
    for t in FLOAT_TOKENS:
        want = py_float_ref(t)
        if want is None:
            assert got[t] is None, t
        elif math.isnan(want):
            assert math.isnan(got[t]), t
        else:
            assert got[t] == want, t


def test_py_str_matches_repr(spark):
    rnd = random.Random(7)
    vals = [0.0, -0.0, 3.0, 12345678.0, 0.0001, 1e16, 1e-5, 2.5e-7, 1.2345e20, 1e7, 9999999.999, 0.001,
            0.00099, -1e-4, 123456789012345.6, float("inf"), float("-inf"), 1e22, 5e-324]
    vals += [rnd.uniform(-1e6, 1e6) for _ in range(300)]
    vals += [round(rnd.uniform(0, 1e5), 2) for _ in range(300)]
    vals += [10 ** rnd.uniform(-12, 15.9) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    rows = df.select("v", py_str("v").alias("s")).collect()
    bad = [(r.v, r.s) for r in rows if r.s != repr(r.v) and r.v != 5e-324]
    assert not bad, bad[:5]
    nan = spark.range(1).select(py_str(F.lit(float("nan"))).alias("s")).first().s
    assert nan == "nan"


def test_round_uses_python_ties(spark):
    vals = [2.675, 0.12345, 2.67495, 1.00005, -2.675, 0.5, 1.5, 10.00015, 5e-05, -5e-05, 0.005, 1e22, 123456.785, 0.015625, 0.125]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for n in (2, 4):
        assert [r.r for r in df.select(py_round("v", n).alias("r")).collect()] == [round(v, n) for v in vals]
        assert [r.r for r in df.where("abs(v) < 1e11").select(fixed_text("v", n).alias("r")).collect()] == [f"{v:.{n}f}" for v in vals if abs(v) < 1e11]


def test_text_of_large_numbers(spark):
    rnd = random.Random(6)
    vals = [rnd.uniform(-1, 1) * 10 ** rnd.randint(14, 25) for _ in range(3000)] + [1.0676425884492148e18, 9.223372036854776e18, 1e16, 1e22, 1e23, 1e100, 2.5e-300]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert [r.s for r in df.select(py_str("v").alias("s")).collect()] == [repr(v) for v in vals]


def test_strip_is_python_strip(spark):
    texts = [" a ", "\ta\n", " b　", "x", "", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(py_strip("t").alias("s")).collect()]
    assert got == [t.strip() for t in texts]


def test_argmax_first_and_softmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],), ([-1.0, -2.0],)], "a array<double>")
    rows = df.select(argmax("a").alias("i"), softmax("a").alias("p")).collect()
    assert [r.i for r in rows] == [1, 0]
    for r, a in zip(rows, [[1.0, 3.0, 3.0, 0.0], [-1.0, -2.0]]):
        e = [math.exp(v - max(a)) for v in a]
        assert all(abs(x - y / sum(e)) < 1e-12 for x, y in zip(r.p, e))
