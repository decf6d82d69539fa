"""Sources and sinks: files are written by the test into its own tmp folder."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotrows.operators.images import byte_values, image_prep
from plotrows.sources import files, sinks

EDGE_VALUES = ["1.10", "1e5", "1E-7", "1.0", "100000000000000000000", "true", "null", "NaN", '"1.10"',
               "-0.0", "-0", "1e400", "Infinity", "-Infinity", '""', '"a \\"q\\""', '"true"', '"null"', '"NaN"']


def py_text(tok):
    return str(json.loads(tok))


def test_annotation_scan_matches_python_str(spark, tmp_path):
    d = tmp_path / "train" / "annotations"
    d.mkdir(parents=True)
    pts = ", ".join('{"x": %s, "y": %s}' % (t, EDGE_VALUES[-1 - i]) for i, t in enumerate(EDGE_VALUES))
    (d / "c1.json").write_text('{"source": "generated", "chart-type": "line", "data-series": [%s], '
                               '"extra": {"k": 1}}' % pts, encoding="utf-8")
    (d / "c2.json").write_text('{"source": "extracted", "chart-type": "dot", "data-series": []}', encoding="utf-8")
    df = files.scan_annotations(spark, str(d)).orderBy("chart_type").collect()
    assert [r.chart_type for r in df] == ["dot", "line"]
    assert df[0].gts == [] and df[0].image_path.endswith("/train/images/c2.jpg")
    xs = [p.x for p in df[1].gts]
    ys = [p.y for p in df[1].gts]
    assert xs == [py_text(t) for t in EDGE_VALUES]
    assert ys == [py_text(t) for t in reversed(EDGE_VALUES)]
    assert [p.pos for p in df[1].gts] == list(range(1, len(EDGE_VALUES) + 1))


def test_annotation_files_are_read_in_bulk_as_the_text_source_reads_them(spark, tmp_path):
    """One task reads many small files without a text reader for each; odd names and bytes give the same rows, an empty file none."""
    d = tmp_path / "a b" / "x%20y"
    d.mkdir(parents=True)
    line = '{"source": "%s", "chart-type": "line", "data-series": [{"x": "1", "y": 2}]}'
    texts = {"c 1.json": (line % "ünï 😀").encode(), "c#2.json": b"", "c%3.json": (line % "a").replace(",", ",\r\n").encode(), "c4.v2.json": line.encode() % b"bad \xff byte",
             "c5.json": b"\xef\xbb\xbf" + (line % "bom").encode(), "_hidden.json": b"{", ".c6.json": b"{"}
    for name, data in texts.items():
        (d / name).write_bytes(data)
    got = files.scan_annotations(spark, str(tmp_path), strict=False, recursive=True)
    text = spark.read.option("recursiveFileLookup", True).text(str(tmp_path), wholetext=True)
    opts = {"allowNonNumericNumbers": "true"}
    want = text.select(F.col("_metadata.file_path").alias("p"), F.from_json("value", files._SERIES, opts).alias("s")).select("p", "s.source", F.col("s.`chart-type`"))
    rows = [tuple(r) for r in got.select("annotation_path", "source", "chart_type").collect()]
    assert len(rows) == 4 and sorted(rows, key=str) == sorted((tuple(r) for r in want.collect()), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FileScan binaryFile" in plan and "FileScan text" not in plan


def _annotation_rows(df):
    return sorted(((r.annotation_path, r.record_id, r.relative_path, r.source, [(p.pos, p.x, p.y) for p in r.gts]) for r in df.collect()), key=str)


def test_folders_of_many_annotation_files_are_not_listed_on_the_driver(spark, tmp_path, monkeypatch):
    """Beyond a few files no scan of Spark's holds the files on the driver; the rows are those of Spark's scan, whatever the names, folders and bytes."""
    doc = '{"source": "%s", "chart-type": "line", "data-series": [{"x": "%d", "y": 1.50}]}'
    names = ["a b.json", "c%3.json", "é😀.json", "n\u00a0b\u3000s.json", "t\tb\nl.json", "q?[1]{2}*.json", "e=f&g+h,i;j@k$.json", "p'(~)!\"<>|^`\\.json", "nfc\u0301.json", "\x7f\x85.json", "z.json.gz", "_a=b.json",
             "_m.json", ".h.json", "_metadata.json", "f._COPYING_", "_c=d._COPYING_"]
    folders = ["", "s p", "s p/_metadata_x/k", "k=v", "_k=v", "_hidden", ".hidden", "x._COPYING_"] + [f"many/{i}/deep" for i in range(30)]
    for folder in folders:
        d = tmp_path / "train" / folder
        d.mkdir(parents=True, exist_ok=True)
        (d / "empty.json").touch()
        (d / "broken.json").symlink_to(tmp_path / "nowhere")
        for i, name in enumerate(names if "many" not in folder else [f"{i}.v2.json" for i in range(50)]):
            (d / name).write_bytes((doc % (name.encode().hex(), i)).encode() if i % 5 else b'{"source": "bad \xff byte"')
    (tmp_path / "train" / "link").symlink_to(tmp_path / "train" / "s p")
    scan = lambda few, sub="", **k: (monkeypatch.setattr(files, "FEW_FILES", few, raising=False), files.scan_annotations(spark, f"{tmp_path}/train/{sub}", strict=False, **k))[1]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    many = scan(3, recursive=True)
    assert "FileScan binaryFile" not in plan(many) and "FileScan text" not in plan(many)
    want = _annotation_rows(scan(100_000, recursive=True))
    assert len(want) == 12 * 7 + 30 * 50 and _annotation_rows(many) == want
    flat = scan(3, "many/7/deep")
    assert "FileScan binaryFile" not in plan(flat) and len(_annotation_rows(flat)) == 50
    assert _annotation_rows(flat) == _annotation_rows(scan(100_000, "many/7/deep"))
    assert scan(3, "many").collect() == []  # the files lie in folders below


def test_folder_entries_are_the_same_in_every_store(tmp_path):
    """A local folder is read piece by piece, others by pyarrow's listing."""
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a b%.json").write_text("12345")
    (tmp_path / "d" / "empty").touch()
    (tmp_path / "d" / "broken").symlink_to(tmp_path / "nowhere")
    (tmp_path / "d" / "link").symlink_to(tmp_path / "d" / "sub")
    local, other = fs.LocalFileSystem(), fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    sizes = lambda found: sorted((n, d, 0 if d else size) for n, d, size in found)
    want = [("a b%.json", False, 5), ("empty", False, 0), ("link", True, 0), ("sub", True, 0)]
    assert sizes(files._entries(local, f"{tmp_path}/d")) == want == sizes(files._entries(other, "d"))


def test_other_scans_of_annotations_stay_with_spark(spark, tmp_path, monkeypatch):
    """Patterns, single files and folders named key=value are Spark's to read; a missing folder is an error."""
    monkeypatch.setattr(files, "FEW_FILES", 0, raising=False)
    for k in ("k=1", "k=2"):
        (tmp_path / "parts" / k).mkdir(parents=True)
        for i in range(3):
            (tmp_path / "parts" / k / f"c{i}.json").write_text('{"source": "s", "chart-type": "dot", "data-series": []}')
    assert len(files.scan_annotations(spark, f"{tmp_path}/parts").collect()) == 6
    assert len(files.scan_annotations(spark, f"{tmp_path}/parts/k=*").collect()) == 6
    assert len(files.scan_annotations(spark, f"{tmp_path}/parts/k=1/c2.json").collect()) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_annotations(spark, f"{tmp_path}/none", recursive=True)
    (tmp_path / "nothing").mkdir()
    assert files.scan_annotations(spark, f"{tmp_path}/nothing", recursive=True).collect() == []


def test_strict_annotation_scan_fails_on_bad_json(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"source": "x", "chart-type": ', encoding="utf-8")
    with pytest.raises(Exception):
        files.scan_annotations(spark, str(tmp_path), strict=True).collect()


def test_csv_round_trip_with_quotes_and_newlines(spark, tmp_path):
    rows = [(1, 'a,"b"\nc', "line"), (2, "", "dot"), (3, "plain", "scatter")]
    df = spark.createDataFrame(rows, "id int, data_series string, chart_type string")
    out = str(tmp_path / "sub")
    sinks.write_submission(df.withColumn("id", F.col("id").cast("string")), out)
    back = files.read_header_csv(spark, out, "id string, data_series string, chart_type string", multi_line=True)
    got = sorted((int(r.id), r.data_series or "", r.chart_type) for r in back.collect())
    assert got == sorted(rows)


def test_corpus_sink_partitions_by_fold(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, [(1, "a", "1")]), (2, 3, [])],
                               "image_id long, fold int, gts array<struct<pos:int,x:string,y:string>>")
    out = str(tmp_path / "corpus")
    sinks.write_corpus(df, out)
    assert sorted(f for f in os.listdir(out) if not f.startswith((".", "_"))) == ["fold=0", "fold=3"]
    back = spark.read.parquet(out).filter(F.col("fold") == 0)
    assert "PartitionFilters: [isnotnull(fold" in back._jdf.queryExecution().executedPlan().toString()
    assert back.first().gts[0].x == "a"
    sinks.write_corpus_csv(df, str(tmp_path / "csv"))
    txt = files.read_header_csv(spark, str(tmp_path / "csv"), "image_id long, fold int, gts string").orderBy("image_id").first().gts
    assert json.loads(txt) == [{"pos": 1, "x": "a", "y": "1"}]


def test_corpus_reads_only_the_folds_asked_for(spark, tmp_path):
    rows = [(i, i % 5, "line" if i % 3 else None, "" if i % 2 else 'q"uote,\ttab', [(1, 'x"1', "2;3")]) for i in range(40)]
    df = spark.createDataFrame(rows, "image_id long, fold int, types string, label string, gts array<struct<pos:int,x:string,y:string>>")
    out, csv = str(tmp_path / "corpus"), str(tmp_path / "csv")
    sinks.write_corpus(df, out)
    valid = files.read_corpus(spark, out, folds=[0])
    assert {r.image_id for r in valid.collect()} == {i for i in range(40) if i % 5 == 0}
    assert all("/fold=0/" in r.p for r in valid.select(F.col("_metadata.file_path").alias("p")).collect())
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan or "PartitionFilters: [fold" in plan
    sinks.write_corpus_csv(files.read_corpus(spark, out), csv)
    back = files.read_corpus_csv(spark, csv, "image_id long, types string, label string, gts string, fold int")
    got = {r.image_id: (r.fold, r.types, r.label, [tuple(p) for p in r.gts]) for r in back.collect()}
    assert got == {i: (f, t, lab or None, g) for i, f, t, lab, g in rows}


def test_reading_folds_of_an_unpartitioned_table_is_an_error(spark, tmp_path):
    spark.range(3).withColumn("fold", F.lit(0)).write.parquet(str(tmp_path / "flat"))
    with pytest.raises(ValueError, match="not partitioned"):
        files.read_corpus(spark, str(tmp_path / "flat"), folds=[0])


def test_a_metric_batch_counts_once(spark, tmp_path):
    schema = "run long, epoch timestamp_ntz, step long, metric string, value double"
    rows = [spark.createDataFrame([(1, None, s, "loss", float(s)) for s in range(k, k + 5)], schema) for k in (0, 5)]
    log = str(tmp_path / "log")
    assert [sinks.append_metrics(rows[i], log, f"b{i}") for i in (0, 1, 0, 1)] == [True, True, False, False]
    (tmp_path / "log" / "batch=b2" / "_temporary").mkdir(parents=True)  # a writer that died
    assert sinks.append_metrics(rows[0], log, "b2")
    back = sinks.read_metrics(spark, log, schema)
    assert sorted((r.batch, r.step) for r in back.collect()) == sorted([("b0", s) for s in range(5)] + [("b1", s) for s in range(5, 10)] + [("b2", s) for s in range(5)])


def test_files_are_written_one_by_one_and_found_by_id(spark, tmp_path):
    doc = '{"source": "s", "chart-type": "dot", "data-series": [{"x": "1.10", "y": 1.10}, {"y": "\\"x\\": \\"t", "x": null}], "extra": {"x": "no"}}'
    df = spark.createDataFrame([(f"train/annotations/{i % 2}/c{i}.v2.json", doc) for i in range(6)], "name string, doc string")
    root = str(tmp_path / "charts")
    sizes = {r.name: r.n_bytes for r in sinks.write_files(df, "name", "doc", root).collect()}
    assert set(sizes.values()) == {len(doc)}
    sinks.write_files(df, "name", "doc", "file:" + root).collect()  # again, by URI
    rows = files.scan_annotations(spark, root, recursive=True).collect()
    assert sorted((r.record_id, r.relative_path) for r in rows) == [(f"c{i}", f"train/annotations/{i % 2}/c{i}.v2.json") for i in range(6)]
    assert {tuple((p.x, p.y) for p in r.gts) for r in rows} == {(("1.10", "1.1"), ("None", '"x": "t'))}


def test_relative_path(spark):
    df = spark.createDataFrame([("file:///a/b/c/d.json",), ("hdfs://host:9000/a/b/e.json",), ("file:/z/f.json",)], "p string")
    got = [r.r for r in df.select(files.relative_path("p", "/a/b/").alias("r")).collect()]
    assert got == ["c/d.json", "e.json", "file:/z/f.json"]
    assert df.select(files.relative_path("p", "hdfs://host:9000/a").alias("r")).collect()[1].r == "b/e.json"


def _png(path, arr):
    """An H x W x 3 array as a PNG file."""
    h, w = arr.shape[:2]
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    raw = b"".join(b"\0" + arr[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_listing_scan_and_prep(spark, tmp_path):
    root = tmp_path / "images"
    (root / "sub").mkdir(parents=True)
    a = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    _png(root / "a.jpg.png", a)
    _png(root / "sub" / "b.png", 255 - a)
    (root / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nnot really")
    (root / "notes.txt").write_text("hello")
    listing = files.list_files(spark, str(root), recursive=True)
    assert sorted(r.name for r in listing.collect()) == ["a.jpg.png", "b.png", "broken.png", "notes.txt"]
    assert "content" not in listing.columns
    jpg = listing.filter(files.name_contains("name", ".jpg")).select(files.record_id("name").alias("rid")).collect()
    assert [r.rid for r in jpg] == ["a"]
    dflt = files.default_class_listing(spark, str(root)).collect()
    assert len(dflt) == 4 and {r.chart_type for r in dflt} == {"line"}
    imgs = files.scan_images(spark, str(root), recursive=True)
    got = {os.path.basename(r.path): r for r in imgs.collect()}
    assert sorted(got) == ["a.jpg.png", "b.png"]
    r = got["a.jpg.png"]
    assert (r.height, r.width, r.channels) == (4, 6, 3)
    bgr = np.frombuffer(bytes(r.data), dtype=np.uint8).reshape(4, 6, 3)
    assert (bgr[:, :, ::-1] == a).all()
    prepped = {os.path.basename(x.path): x.tensor for x in image_prep(imgs, 3, 5).collect()}
    want = prep_image(bytes(r.data), 4, 6, 3, 3, 5, 0.5, 0.5)
    assert np.allclose(np.asarray(prepped["a.jpg.png"]), want, atol=1e-6)


def test_resize_bilinear_identity_and_halving():
    img = np.random.default_rng(0).random((6, 8, 3))
    assert np.allclose(resize_bilinear(img, 6, 8), img)
    half = resize_bilinear(img, 3, 4)
    assert np.allclose(half[0, 0], img[0:2, 0:2].mean(axis=(0, 1)))


def resize_bilinear(img, out_h, out_w):
    """Plain bilinear resize with half-pixel centres and edge clamping."""
    h, w = img.shape[:2]
    out = np.zeros((out_h, out_w, img.shape[2]))
    for y in range(out_h):
        for x in range(out_w):
            py, px = (min(n - 1, max(0, (o + 0.5) * n / m - 0.5)) for o, n, m in ((y, h, out_h), (x, w, out_w)))
            a, b = int(py), int(px)
            c, d = min(a + 1, h - 1), min(b + 1, w - 1)
            out[y, x] = (img[a, b] * (1 - px + b) + img[a, d] * (px - b)) * (1 - py + a) + (img[c, b] * (1 - px + b) + img[c, d] * (px - b)) * (py - a)
    return out


def prep_image(data, height, width, channels, out_h, out_w, mean, std):
    img = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    if channels >= 3:
        img = np.concatenate([img[:, :, 2::-1], img[:, :, 3:]], axis=2)
    return ((resize_bilinear(img, out_h, out_w) / 255 - mean) / std).transpose(2, 0, 1).reshape(-1)


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_image_tensor_equals_a_plain_resize(spark, channels):
    rng = np.random.default_rng(channels)
    rows = [(f"i{i}", h, w, channels, rng.integers(0, 256, h * w * channels, np.uint8).tobytes()) for i, (h, w) in enumerate([(1, 1), (5, 3), (2, 9), (16, 16)])]
    df = spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary")
    for r in image_prep(df, 4, 7, mean=0.4, std=0.2).collect():
        assert np.allclose(r.tensor, prep_image(bytes(r.data), r.height, r.width, channels, 4, 7, 0.4, 0.2), atol=1e-12)


def test_byte_values(spark):
    df = spark.createDataFrame([(bytes(range(256)) * 2,), (b"",), (b"\x00",)], "data binary")
    assert [r.v for r in df.select(byte_values("data").alias("v")).collect()] == [list(range(256)) * 2, [], [0]]
