"""Stratified folds vs a procedural restatement of the round-robin allocation."""

import random
from collections import Counter

import pytest

from plotrows.operators.folds import positional_split, stratified_kfold


def reference_folds(labels, k):
    classes = []
    for y in labels:
        if y not in classes:
            classes.append(y)
    enc = [classes.index(y) for y in labels]
    order = sorted(enc)
    alloc = [[0] * len(classes) for _ in range(k)]
    for i in range(k):
        for c in order[i::k]:
            alloc[i][c] += 1
    folds = [None] * len(labels)
    for c in range(len(classes)):
        per_class = [i for i in range(k) for _ in range(alloc[i][c])]
        idx = [j for j, e in enumerate(enc) if e == c]
        for j, f in zip(idx, per_class):
            folds[j] = f
    return folds


@pytest.mark.parametrize("k,n", [(10, 997), (5, 203), (3, 7)])
def test_ordered_folds_match_reference(spark, k, n):
    rnd = random.Random(n)
    weights = ["line"] * 5 + ["dot"] * 1 + ["scatter"] * 3 + ["bar"] * 2
    labels = [rnd.choice(weights) for _ in range(n)]
    df = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "id long, y string")
    got = {r.id: r.fold for r in stratified_kfold(df, "y", ["id"], k=k).collect()}
    want = reference_folds(labels, k)
    assert [got[i] for i in range(n)] == want


def test_shuffled_folds_keep_sizes(spark):
    rnd = random.Random(1)
    labels = [rnd.choice("aaabbc") for _ in range(500)]
    df = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "id long, y string")
    a = stratified_kfold(df, "y", ["id"], k=5).collect()
    b = stratified_kfold(df, "y", ["id"], k=5, shuffle=True, seed=42).collect()
    assert len(b) == 500
    sizes = lambda rows: Counter((r.y, r.fold) for r in rows)
    assert sizes(a) == sizes(b)
    assert {r.id: r.fold for r in a} != {r.id: r.fold for r in b}
    for y in set(labels):
        per = [sizes(b)[(y, f)] for f in range(5)]
        assert max(per) - min(per) <= 1


def test_positional_split(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = {r.k: r.split for r in positional_split(df, ["k"], 0.95).collect()}
    assert sum(1 for v in got.values() if v == "train") == int(100 * 0.95) + 1
    assert got[95] == "train" and got[96] == "valid"


def test_null_and_empty_classes_are_two_classes(spark):
    rnd = random.Random(4)
    labels = [rnd.choice([None, "", "a", "b"]) for _ in range(137)]
    df = spark.createDataFrame(list(enumerate(labels)), "id long, c string")
    got = stratified_kfold(df, "c", ["id"], k=10).collect()
    assert len(got) == len(labels)
    assert {r.id: r.fold for r in got} == dict(enumerate(reference_folds(labels, 10)))
