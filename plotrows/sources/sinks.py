"""Corpus, submission and metric-log sinks; files one by one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_corpus(df: DataFrame, path: str, fold_col: str = "fold") -> None:
    """Parquet partitioned by fold -- the fold filters of training become partition pruning."""
    df.write.mode("overwrite").partitionBy(fold_col).parquet(path)


def write_corpus_csv(df: DataFrame, path: str, series_col: str = "gts") -> None:
    """S8 CSV export: the nested series becomes JSON text (D9), quotes escaped by doubling."""
    out = df.withColumn(series_col, F.to_json(series_col)) if series_col in df.columns else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_submission(df: DataFrame, path: str) -> None:
    """``id,data_series,chart_type`` with a header, no index column."""
    (df.select("id", "data_series", "chart_type").write.mode("overwrite")
     .option("header", True).option("escape", '"').csv(path))


def _committed(spark: SparkSession, folder: str) -> bool:
    """Did a Spark job finish writing the folder?"""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def append_metrics(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append ``(run, epoch, step, metric, value)`` rows to the metric log, once for every ``batch``.

    A batch is a folder of its own (without a name, always a new one).  Appending a batch
    that is already there writes nothing (a retried step, a replayed stream) and returns
    False; a batch whose writer died is written again.  A stream over the log therefore
    never meets a row twice.
    """
    batch = batch or uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/batch={batch}"
    if _committed(df.sparkSession, folder):
        return False
    df.select("run", "epoch", "step", "metric", "value").write.mode("overwrite").parquet(folder)
    return True


def read_metrics(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The metric log with the explicit ``schema``; ``batch`` comes from the folder's name."""
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return spark.read.schema(T.StructType([*fields, T.StructField("batch", T.StringType())])).parquet(path)


def write_files(df: DataFrame, name: str, content: str, root: str) -> DataFrame:
    """One file for each row, from the executors: (name, bytes written); ``name`` may hold folders.

    ``root`` is a path or URI that every executor reaches.  A file is replaced as a whole, so
    a task that runs again writes the same files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if root.startswith("file:"):
            store, top = fs.LocalFileSystem(), "/" + root[len("file:"):].lstrip("/")
        else:
            store, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        made = set()
        for b in batches:
            size = []
            for n, c in zip(b[name].to_pylist(), b[content].to_pylist(), strict=True):
                data = c.encode() if isinstance(c, str) else c
                place = f"{top.rstrip('/')}/{n}"
                if (folder := place.rpartition("/")[0]) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(place) as f:
                    f.write(data)
                size.append(len(data))
            yield pa.RecordBatch.from_arrays([b[name], pa.array(size, pa.int64())], ["name", "n_bytes"])
    return df.select(name, content).mapInArrow(run, "name string, n_bytes long")
