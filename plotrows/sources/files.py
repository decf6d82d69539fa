"""File sources: annotation JSON, listings, header CSV, images.

All scans are lazy Spark reads with explicit schemas; nothing is parsed on the
driver.  Folders of many annotation files are listed by the executors.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import deque
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotrows import constants as K
from plotrows.session import scratch_path, ship_package


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def annotation_to_image_path(path) -> Column:
    """Every 'annotations' -> 'images', then every 'json' -> 'jpg'."""
    p = F.replace(_c(path), F.lit("annotations"), F.lit("images"))
    return F.replace(p, F.lit("json"), F.lit("jpg"))


# A string value of a point is marked before the parse: read as text, "1.10" and 1.10 look alike.
_MARK = "="
_STRING_VALUE = '("[xy]"\\s*:\\s*")'


def json_value_text(raw: Column) -> Column:
    """

    Strings keep their text, integers their digits, booleans print as True/False, null
    as None, and every other number as a Python float.
    """
    from plotrows.functions.numbers import py_float, py_str
    bare = F.regexp_replace(raw, '^"|"$', "")
    return (F.when(raw.isNull(), F.lit("None"))
            .when(raw.startswith(_MARK), F.substr(raw, F.lit(len(_MARK) + 1)))
            .when(raw.isin("true", "false"), F.initcap(raw))
            .when(raw.rlike("^-?[0-9]+$"), F.regexp_replace(raw, "^-0$", "0"))
            .otherwise(F.coalesce(py_str(py_float(bare)), raw)))


def relative_path(path, root: str) -> Column:
    """The part of a file's URI below ``root`` (a folder's path or URI); the URI itself elsewhere."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "^/+", "")
    top, own = F.concat(F.rtrim(bare(F.lit(root)), F.lit("/")), F.lit("/")), bare(_c(path))
    return F.when(own.startswith(top), F.substr(own, F.length(top) + 1)).otherwise(_c(path))


_SERIES = "struct<source:string, `chart-type`:string, `data-series`:array<struct<x:string, y:string>>>"


#: Spark's own scan keeps each file on the driver and deals a few to a task: beyond so many files, executors list and read them.
FEW_FILES = 10_000
#: Files and bytes that a task reads, bytes of a batch, and entries after which a task leaves the folders below to others.
TASK_FILES, TASK_BYTES, BATCH_BYTES, WALK = 4_000, 64 << 20, 4 << 20, 1_000


def _whole_files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """(annotation_path, content) of each file that Spark's sources find below ``path``, empty ones left out.

    A file of many that is gone when it is read is an error, whatever ``ignoreMissingFiles`` says.
    """
    if place := _store_of(spark, path):
        listed = _list_tree(spark, *place[:2]).filter(~F.col("folder") & (F.col("length") > 0))
        n, size, parted = listed.agg(F.count(F.lit(1)), F.sum("length"), F.count_if(F.col("place").rlike("=[^/]*/"))).first()
        # without ``recursive``, Spark takes folders named key=value for partitions
        if n > FEW_FILES and (recursive or not parted):
            kept = listed if recursive else listed.filter(~F.col("place").contains("/"))
            tasks = max(n // TASK_FILES, size // TASK_BYTES) + 1
            return _read_files(kept.select("place").repartition(tasks, "place"), *place)
    # the text source sets up a reader for each whole file, which takes far longer than a small file's bytes
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return found.select(F.col("_metadata.file_path").alias("annotation_path"), "content")


def _store_of(spark: SparkSession, path: str) -> tuple[str, str, str] | None:
    """(URI of the store, the folder ``path`` in it, the folder's own URI).

    None if ``path`` is a pattern or no folder, or lies in a store that only Spark reads.
    """
    if re.search(r"[\\{}\[\]*?]", path):
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    root = f"{uri.getScheme()}:" + (f"//{uri.getAuthority()}" if uri.getAuthority() else "")
    try:
        store, base = _open(root)
        top = base.rstrip("/") + uri.getPath()
        if store.get_file_info(top).type != fs.FileType.Directory:
            return None
    except (OSError, ValueError, NotImplementedError):
        return None
    return root, top.rstrip("/"), (root + uri.getRawPath()).rstrip("/")


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), "") if root == "file:" else fs.FileSystem.from_uri(root + "/")


def _left_out(name: str, folder: bool) -> bool:
    """Do Spark's file sources pass over this name?"""
    hidden = name.startswith(".") or name.startswith("_") and "=" not in name
    kept = name.startswith(("_metadata", "_common_metadata")) or not (hidden or name.endswith("._COPYING_"))
    return not kept or hidden and not folder


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is it a folder, length) of what lies in a folder; a local folder is never held as a whole."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                try:
                    yield e.name, e.is_dir(), e.stat().st_size
                except FileNotFoundError:  # a link to nowhere, a file just deleted
                    continue
    else:
        for e in store.get_file_info(fs.FileSelector(folder)):
            if e.type != fs.FileType.NotFound:
                yield e.base_name, e.type == fs.FileType.Directory, e.size or 0


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


_LISTED = pa.schema([("place", pa.string()), ("folder", pa.bool_()), ("length", pa.int64())])
_LISTED_DDL = "place string, folder boolean, length long"


def _list_tree(spark: SparkSession, root: str, top: str) -> DataFrame:
    """(place below ``top``, folder, length): all files, and some folders, listed by the executors round by round.

    A task lists the folders it is given and those below; after ``WALK`` entries the folders
    it meets are rows of their own, which the next round deals out.  The rows lie in the
    shared scratch folder, none are sent to the driver.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(root)
        rows = []
        for start in (p for b in batches for p in b["place"].to_pylist()):
            todo, seen = deque([start]), 0
            while todo and seen < WALK:
                at = todo.popleft()
                for name, folder, length in _entries(store, f"{top}/{at}"):
                    seen += 1
                    if _left_out(name, folder):
                        continue
                    if folder and seen < WALK:
                        todo.append(f"{at}{name}/")
                    else:
                        rows.append((f"{at}{name}/" if folder else at + name, folder, 0 if folder else length))
                    if len(rows) >= 10_000:
                        yield _batch(rows, _LISTED)
                        rows = []
            rows += [(p, True, 0) for p in todo]
        if rows:
            yield _batch(rows, _LISTED)

    ship_package(spark)
    out, n, level = scratch_path(spark, "listing"), 1, 0
    folders = spark.range(1).select(F.lit("").alias("place"))
    while n:
        folders.repartition(min(n, 200)).mapInArrow(walk, _LISTED_DDL).write.parquet(f"{out}/level={level}")
        folders = spark.read.schema(_LISTED_DDL).parquet(f"{out}/level={level}").filter("folder").select("place")
        n, level = folders.count(), level + 1
    return spark.read.schema(_LISTED_DDL).parquet(out)


def _uri_path(path: str) -> str:
    """A path as ``java.net.URI`` prints it, and so ``_metadata.file_path``."""
    other = lambda m: m[0] if m[0] > "\x9f" and unicodedata.category(m[0])[0] != "Z" else quote(m[0], safe="")
    return re.sub(r"[^A-Za-z0-9_.!~*'():@&=+$,;/-]", other, path)


def _read_files(places: DataFrame, root: str, top: str, uri: str) -> DataFrame:
    """(annotation_path, content) of the files at ``places`` below ``top``, a bounded batch at a time."""
    schema = pa.schema([("annotation_path", pa.string()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(root)
        rows, size = [], 0
        for place in (p for b in batches for p in b["place"].to_pylist()):
            with store.open_input_stream(f"{top}/{place}", compression=None) as f:
                rows.append((f"{uri}/{_uri_path(place)}", f.read()))
            size += len(rows[-1][1])
            if size >= BATCH_BYTES or len(rows) >= TASK_FILES:
                yield _batch(rows, schema)
                rows, size = [], 0
        if rows:
            yield _batch(rows, schema)
    return places.mapInArrow(read, "annotation_path string, content binary")


def scan_annotations(spark: SparkSession, path: str, multi_line: bool = True,
                     strict: bool = True, recursive: bool = False) -> DataFrame:
    """One JSON object per file (``multi_line``) or JSON Lines, below the folder ``path``.

    Returns (record_id, annotation_path, relative_path, image_path, source, chart_type,
    gts): ``record_id`` is the file name before its first dot, ``relative_path`` stays the
    same wherever the folder lies, ``gts`` is the canonical ``ARRAY<STRUCT<pos,x,y>>``.  Each
    document is parsed once on the executors; values keep the document's text and whether
    they were strings, so each prints the way Python's ``str(json.loads(...))`` would.  A
    malformed document fails the job; without ``strict`` it yields NULLs.  Whole files are
    read as they are, never decompressed; a folder of many is listed when this is called.
    """
    if multi_line:
        raw = _whole_files(spark, path, recursive).select(F.col("content").cast("string").alias("value"), "annotation_path")
    else:
        raw = spark.read.option("recursiveFileLookup", recursive).text(path).select("value", F.col("_metadata.file_path").alias("annotation_path"))
    opts = {"allowNonNumericNumbers": "true", "mode": "FAILFAST" if strict else "PERMISSIVE"}
    marked = F.regexp_replace("value", _STRING_VALUE, f"$1{_MARK}")
    doc = raw.select("annotation_path", F.from_json(marked, _SERIES, opts).alias("s"))
    if not multi_line:
        doc = doc.filter(F.col("s").isNotNull())
    gts = F.transform(F.col("s.`data-series`"), lambda p, i: F.struct(
        (i + 1).cast("int").alias("pos"), json_value_text(p["x"]).alias("x"), json_value_text(p["y"]).alias("y")))
    return doc.select(
        record_id(F.substring_index("annotation_path", "/", -1)).alias("record_id"),
        "annotation_path",
        relative_path("annotation_path", path).alias("relative_path"),
        annotation_to_image_path("annotation_path").alias("image_path"),
        F.col("s.source").alias("source"),
        F.col("s.`chart-type`").alias("chart_type"),
        F.coalesce(gts, F.array().cast("array<struct<pos:int,x:string,y:string>>")).alias("gts"),
    )


def list_files(spark: SparkSession, path: str, recursive: bool = False,
               glob: str | None = None) -> DataFrame:
    """(path, name, length) of every file; the ``content`` column is never read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path).select("path", "length")
    return df.withColumn("name", F.substring_index("path", "/", -1))


def default_class_listing(spark: SparkSession, path: str, default: str = K.DEFAULT_CLASS) -> DataFrame:
    """S3 + P8: recursive listing, every file gets the default class."""
    return list_files(spark, path, recursive=True).select(
        F.col("path").alias("filename"), F.lit(default).alias("chart_type"))


def name_contains(name, needle: str = ".jpg") -> Column:
    """Keep names *containing* the text (not only as a suffix)."""
    return _c(name).contains(needle)


def record_id(name) -> Column:
    """Text before the first dot of a file name."""
    return F.substring_index(_c(name), ".", 1)


def read_header_csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """Header CSV with an explicit schema; with ``multi_line`` quoted fields may hold line feeds (one task per file)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
            .option("escape", '"').csv(path))


def read_corpus(spark: SparkSession, path: str, folds: Sequence[int] | None = None, fold_col: str = "fold") -> DataFrame:
    """The corpus that ``write_corpus`` wrote; ``folds`` reads only those folders.

    It is an error if the table is not partitioned by ``fold_col``: the filter would then
    read every row.
    """
    df = spark.read.parquet(path)
    if folds is None:
        return df
    plan = df.filter(F.col(fold_col).isin(*folds))
    if "PartitionFilters: []" in plan._jdf.queryExecution().executedPlan().toString():
        raise ValueError(f"{path} is not partitioned by {fold_col}")
    return plan


def read_corpus_csv(spark: SparkSession, path: str, columns: str, series_col: str = "gts") -> DataFrame:
    """S5 + S8: the CSV export with the explicit schema ``columns``; the series is parsed back from its JSON text.

    CSV has one empty field for an empty text and for NULL: both come back as NULL.
    """
    df = read_header_csv(spark, path, columns, multi_line=False)
    return df.withColumn(series_col, F.from_json(series_col, "array<struct<pos:int,x:string,y:string>>", {"mode": "FAILFAST"}))


def scan_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Decoded images (BGR, H x W x C bytes) via the built-in image source."""
    return (spark.read.format("image").option("dropInvalid", True)
            .option("recursiveFileLookup", recursive).load(path)
            .select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"),
                    F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"),
                    F.col("image.data").alias("data")))
