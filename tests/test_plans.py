"""End-to-end plan parameters checked against plain Python over the sf0.001 tables."""

import hashlib

import pyarrow.parquet as pq

from plotrows import constants as K
from plotrows.plans import training as TR
from plotrows.sources import fixtures as fx


def _charts(sf):
    o = pq.read_table(f"{sf}/orders.parquet", columns=["o_orderkey", "o_orderpriority"]).to_pylist()
    keys = {r["o_orderkey"]: fx.PRIORITY_TO_TYPE[r["o_orderpriority"]] for r in o}
    return {i: None if i % 97 == 0 else "" if i % 89 == 0 else t for i, t in keys.items()}


def test_single_class_sample_variant(spark, sf_small):
    charts = _charts(sf_small)
    got = TR.extra_sample(spark, sf_small, n=20, only="horizontal_bar").collect()
    train = sorted((r.shuffle_rank, r.file_name) for r in got if r.split == "train")
    names = [f"{i}.jpg" for i, t in charts.items() if t == "horizontal_bar" and i % 10 != 0]
    order = sorted(names, key=lambda s: (hashlib.md5(f"{s}:42".encode()).hexdigest(), s))[:20]
    assert [f for _, f in train] == order and [r for r, _ in train] == list(range(20))
    valid = {r.file_name for r in got if r.split == "valid"}
    assert valid == {f"{i}.jpg" for i, t in charts.items() if t == "horizontal_bar" and i % 10 == 0}


def test_chart_points_positions(spark, sf_small):
    li = pq.read_table(f"{sf_small}/lineitem.parquet").to_pylist()
    by = {}
    for r in li:
        by.setdefault(r["l_orderkey"], []).append(tuple(r[c] for c in fx.POINT_ORDER))
    want = {(k, i + 1): str(v[0]) for k, vs in by.items() for i, v in enumerate(sorted(vs))}
    got = {(r.image_id, r.pos): r.x for r in fx.chart_points(spark, sf_small).collect()}
    assert got == want


def test_train_valid_prep_batches(spark, sf_small):
    rows = TR.train_valid_prep(spark, sf_small).collect()
    for split in ("train", "valid"):
        pos = sorted(r.pos for r in rows if r.split == split)
        assert pos == list(range(len(pos)))
        assert all(r.batch_id == r.pos // 8 for r in rows if r.split == split)


def test_annotation_round_trip_through_json(spark, sf_small):
    """charts -> JSON Lines (y as numbers) -> scan -> series: x kept as text, y printed as Python floats."""
    from collections import Counter

    from plotrows.plans.source_queries import write_annotation_lines
    from plotrows.sources.files import scan_annotations
    path = write_annotation_lines(spark, sf_small)
    got = Counter((r.chart_type, r.source, tuple(p.x for p in r.gts), tuple(p.y for p in r.gts))
                  for r in scan_annotations(spark, path, multi_line=False).collect())
    want = Counter((w.chart_type, w.source, tuple(p.x for p in w.gts), tuple(repr(float(p.y)) for p in w.gts))
                   for w in fx.charts_with_series(spark, sf_small).collect())
    assert got == want


def test_a_class_outside_the_map_raises_when_strict(spark):
    import pytest

    from plotrows.plans.inference_queries import class_index
    df = spark.createDataFrame([("line",), ("dot",)], "chart_type string")
    assert [r.i for r in df.select(class_index("chart_type").alias("i")).collect()] == [3, 0]
    for bad in ("pie", "", None):
        with pytest.raises(Exception, match="unknown class"):
            spark.createDataFrame([(bad,)], "chart_type string").select(class_index("chart_type").alias("i")).collect()
