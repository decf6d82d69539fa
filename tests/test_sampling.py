"""Reproducible shuffle, head, shuffle-limit and batches vs plain Python."""

import hashlib

from plotrows.operators import sampling


def md5_order(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}:{seed}".encode()).hexdigest(), k))


def test_shuffle_matches_md5_order(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    got = {r.k: r.shuffle_rank for r in sampling.shuffle(df, ["k"], 42).collect()}
    want = {k: i for i, k in enumerate(md5_order(range(300)))}
    assert got == want


def test_shuffle_limit(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    want = {k: i for i, k in enumerate(md5_order(range(300))[:37])}
    for parts in (1, 9):
        assert {r.k: r.shuffle_rank for r in sampling.shuffle_limit(df.repartition(parts), ["k"], 37).collect()} == want


def test_head_and_batches(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    head = sorted((r.k, r["rank"]) for r in sampling.head_n(df, ["k"], 5).collect())
    assert head == [(i, i) for i in range(5)]
    b = {r.k: r.batch_id for r in sampling.batch_assign(df, ["k"], 8).collect()}
    assert b == {k: k // 8 for k in range(50)}
