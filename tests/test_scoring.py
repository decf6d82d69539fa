"""Distributed scoring: mapInPandas scorer, routed models with error isolation, softmax/CE, Spark ML."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotrows.operators.scoring import (linear_scorer_factory, route_of, routed_scoring, rule_weights,
                                        score_classes, softmax_ce, train_class_model)


def test_score_classes_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 64))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "id long, px array<double>")
    got = {r.id: (r.pred_idx, r.pred_class) for r in score_classes(df, "px", linear_scorer_factory()).collect()}
    want = (x @ rule_weights(5, 64).T).argmax(axis=1)
    names = ["dot", "horizontal_bar", "vertical_bar", "line", "scatter"]
    assert got == {i: (int(want[i]), names[want[i]]) for i in range(40)}


def _upper():
    return lambda s: s.str.upper()


def _fragile():
    def model(s):
        if (s == "boom").any():
            raise RuntimeError("bad input")
        return s + "!"
    return model


def _broken():
    raise ImportError("weights missing")


def test_routed_scoring_isolates_failures(spark):
    rows = [(1, "horizontal_bar", "a"), (2, "line", "b"), (3, "scatter", "boom"), (4, "dot", "c"), (5, "line", "d")]
    df = spark.createDataFrame(rows, "id long, chart_type string, inp string").withColumn("route", route_of("chart_type"))
    models = {"horizontal_bar": _upper, "scatter_line": _fragile, "all": _broken}
    got = {r.id: (r.route, r.text, r.error) for r in routed_scoring(df, "route", models, "inp", "id").collect()}
    assert got[1] == ("horizontal_bar", "A", None)
    assert got[2][:2] == ("scatter_line", "b!") and got[5][1] == "d!"
    assert got[3][1] is None and "bad input" in got[3][2]
    assert got[4][1] is None and "weights missing" in got[4][2]


def test_softmax_ce(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5], 1), ([3.0, 3.0, 1.0], 0)], "lg array<double>, y int")
    t = softmax_ce("lg", "y")
    rows = df.select(t["ce"].alias("ce"), t["pred"].alias("pred"), t["p1"].alias("p1")).collect()
    for r, (lg, y) in zip(rows, [([1.0, 2.0, 0.5], 1), ([3.0, 3.0, 1.0], 0)]):
        p = np.exp(np.array(lg) - max(lg))
        p /= p.sum()
        assert abs(r.ce + np.log(p[y])) < 1e-12 and r.pred == int(np.argmax(lg)) and abs(r.p1 - p[1]) < 1e-12


def test_cross_entropy_of_an_underflowing_label(spark):
    df = spark.createDataFrame([([800.0, 0.0, 0.0], 1), ([0.0, -800.0], 1), ([1.0], 5)], "lg array<double>, y int")
    ce = softmax_ce("lg", "y")["ce"]
    assert [r.ce for r in df.where("y = 1").select(ce.alias("ce")).collect()] == [800.0, 800.0]
    with pytest.raises(Exception, match="label outside"):
        df.where("y = 5").select(ce.alias("ce")).collect()


def _clusters(n=300, noise=0.1):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        y = i % 3
        v = rng.normal(size=4) * noise
        v[y] += 3.0
        rows.append((i, v.tolist(), y))
    return rows


def test_train_class_model_learns_separable_classes(spark):
    df = spark.createDataFrame(_clusters(), "id long, f array<double>, label int")
    run = train_class_model(df.filter(F.col("id") % 5 != 0), df.filter(F.col("id") % 5 == 0), "f", "label", 3, 4, epochs=5)
    assert run.accuracies[run.kept] > 0.95 and run.losses == sorted(run.losses, reverse=True) and len(run.weights) == 5
    scored = score_classes(df, "f", run.scorer(), classes=["a", "b", "c"]).collect()
    assert sum(r.pred_idx == r.id % 3 for r in scored) > 280


def test_training_is_one_run_kept_at_its_best_epoch(spark):
    """Against plain gradient descent: losses, every epoch's accuracy, and the first highest one."""
    rows = _clusters(200, noise=3.0)
    x, y = np.array([[*f, 1.0] for _, f, _ in rows]), np.array([c for *_, c in rows])
    held = np.arange(200) % 4 == 0
    w, losses, accuracies = np.zeros((3, 5)), [], []
    for _ in range(8):
        lg = x[~held] @ w.T
        p = np.exp(lg - lg.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(p)), y[~held]]).mean())
        p[np.arange(len(p)), y[~held]] -= 1
        w = w - 3.0 * (p.T @ x[~held]) / len(p)
        accuracies.append(((x[held] @ w.T).argmax(1) == y[held]).mean())
    df = spark.createDataFrame(rows, "id long, f array<double>, label int")
    runs = [train_class_model(d.filter(F.col("id") % 4 != 0), d.filter(F.col("id") % 4 == 0), "f", "label", 3, 4, epochs=8, rate=3.0)
            for d in (df.repartition(1), df.repartition(7))]
    for run in runs:
        assert np.allclose(run.losses, losses, atol=1e-9) and run.accuracies == accuracies
        assert run.kept == int(np.argmax(accuracies)) and np.allclose(run.weights[-1], w, atol=1e-9)
    assert all((a == b).all() for a, b in zip(runs[0].weights, runs[1].weights, strict=True))  # to the last bit


def test_training_leaves_out_rows_without_label_and_survives_empty_tables(spark):
    df = spark.createDataFrame([*_clusters(30), (100, None, 1), (101, [9.0] * 4, None)], "id long, f array<double>, label int")
    run = train_class_model(df, df.filter("id < 0"), "f", "label", 3, 4, epochs=2)
    same = train_class_model(df.filter("id < 100"), df, "f", "label", 3, 4, epochs=2)
    assert run.losses == same.losses and run.kept is None and same.kept is not None
    assert train_class_model(df.filter("id < 0"), df, "f", "label", 3, 4, epochs=1).losses == [0.0]


def _lengths():
    return lambda s, prompt=None: s.map(lambda v: f"{len(v)}{prompt or ''}")


def test_each_route_prepares_its_own_input(spark):
    df = spark.createDataFrame([(1, "a", [1, 2, 3, 4], "x"), (2, "b", [1, 2, 3, 4], "y"), (3, "c", [1, 2], "z")], "id long, r string, px array<int>, more string")
    out = routed_scoring(df, "r", {"a": _lengths, "b": _lengths, "c": _lengths}, "px", "id", prompt="!",
                         prepare={"a": lambda c: F.slice(c, 1, 1), "c": lambda c: F.concat(c, c)}, keep=["more"]).collect()
    assert {r.id: (r.text, r.more, r.error) for r in out} == {1: ("1!", "x", None), 2: ("4!", "y", None), 3: ("4!", "z", None)}
