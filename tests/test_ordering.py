"""Skew-safe ordered scan vs brute force, with one key holding a third of the rows."""

import random

import pandas as pd
import pytest

from plotrows.operators.ordering import global_position, ordered_scan


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{rnd.randint(0, 200)}"
        rows.append((i, g, rnd.randint(0, 50), float(rnd.randint(-100, 100)) / 4))
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, g string, t long, v double")


def brute(rows):
    df = pd.DataFrame(rows, columns=["id", "g", "t", "v"]).sort_values(["g", "t", "id"])
    df["rank"] = df.groupby("g").cumcount()
    df["cum_v"] = df.groupby("g")["v"].cumsum()
    df["prev_min_v"] = df.groupby("g")["v"].transform(lambda s: s.cummin().shift(1))
    df["prev_max_v"] = df.groupby("g")["v"].transform(lambda s: s.cummax().shift(1))
    return df.set_index("id")


@pytest.mark.parametrize("parts", [1, 3, 11, 40])
def test_ordered_scan_matches_brute_force(skewed, parts):
    rows, df = skewed
    want = brute(rows)
    out = ordered_scan(df, order_by=["t", "id"], group_by=["g"], sums=["v"], prev_mins=["v"], prev_maxs=["v"],
                       num_partitions=parts).collect()
    assert len(out) == len(rows)
    for r in out:
        w = want.loc[r.id]
        assert r["rank"] == w["rank"]
        assert r.cum_v == w["cum_v"]
        if pd.isna(w["prev_min_v"]):
            assert r.prev_min_v is None and r.prev_max_v is None
        else:
            assert r.prev_min_v == w["prev_min_v"] and r.prev_max_v == w["prev_max_v"]


def test_hot_group_is_split_across_partitions(skewed):
    _, df = skewed
    from pyspark.sql import functions as F
    ranged = df.repartitionByRange(8, "g", "t", "id").withColumn("p", F.spark_partition_id())
    parts = ranged.filter(F.col("g") == "hot").select("p").distinct().count()
    assert parts >= 2


def test_global_position_is_dense(skewed):
    rows, df = skewed
    out = global_position(df, ["t", "id"]).select("id", "pos").collect()
    want = {rid: i for i, (rid, *_rest) in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert {r.id: r.pos for r in out} == want


def test_running_sums_do_not_depend_on_partitions(spark):
    """Sums of doubles whose order would show in the last bits; NULL keys are one group."""
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "a", "b", None]), rnd.uniform(-1, 1) * 10 ** rnd.randint(-3, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = []
    for parts in (1, 7, 50):
        out = ordered_scan(df, order_by=["id"], group_by=["g"], sums=["v"], num_partitions=parts).collect()
        got.append({r.id: (r["rank"], r.cum_v) for r in out})
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def test_collect_series_chunks_keep_order(spark):
    """A hot chart spanning many chunks comes back whole and in position order."""
    from plotrows.operators.series import collect_series
    rnd = random.Random(3)
    rows = [(1, p, f"x{p}", str(p * 0.5)) for p in range(1, 1001)]
    rows += [(k, p, f"s{k}-{p}", "1") for k in range(2, 30) for p in range(1, rnd.randint(1, 5) + 1)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "image_id long, pos int, x string, y string").repartition(7)
    got = {r.image_id: r for r in collect_series(df, chunk=64).collect()}
    hot = got[1]
    assert hot.n_points == 1000
    assert [p.pos for p in hot.gts] == list(range(1, 1001))
    assert [p.x for p in hot.gts] == [f"x{p}" for p in range(1, 1001)]
    for k in range(2, 30):
        assert [p.pos for p in got[k].gts] == list(range(1, got[k].n_points + 1))
