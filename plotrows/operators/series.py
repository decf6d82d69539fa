"""Gather point rows into ordered per-record series, skew-safe.

A chart's series is one value, so it ends in one row; what must not happen is
one task sorting all points of a hot chart.  The collect runs in two levels:
points are grouped by (record, chunk of ``CHUNK`` positions) and sorted there,
then each record concatenates its already-sorted chunks (one short entry per
chunk).  Both levels use partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096


def collect_series(points: DataFrame, key: str = "image_id", pos: str = "pos",
                   x: str = "x", y: str = "y", out: str = "gts",
                   chunk: int = CHUNK) -> DataFrame:
    """``(key, pos, x, y)`` rows -> ``(key, n_points, gts ARRAY<STRUCT<pos,x,y>>)`` ordered by pos."""
    pts = F.struct(F.col(pos).cast("int").alias("pos"), F.col(x).cast("string").alias("x"),
                   F.col(y).cast("string").alias("y"))
    level1 = (points.groupBy(F.col(key), F.floor(F.col(pos) / chunk).alias("_chunk"))
              .agg(F.array_sort(F.collect_list(pts)).alias("_pts")))
    level2 = (level1.groupBy(key)
              .agg(F.array_sort(F.collect_list(F.struct("_chunk", "_pts"))).alias("_chunks")))
    return level2.select(
        key,
        F.flatten(F.transform("_chunks", lambda c: c["_pts"])).alias(out),
    ).withColumn("n_points", F.size(out).cast("long"))


def attach_series(records: DataFrame, series: DataFrame, key: str = "image_id",
                  out: str = "gts") -> DataFrame:
    """Left-join series onto records; records without points get an empty series."""
    empty = F.array().cast("array<struct<pos:int,x:string,y:string>>")
    # The series table grows with the points, so it is never broadcast: a
    # shuffle join keeps the per-record work after it spread over partitions
    # (the series side is already hash-partitioned by ``key``).
    return (records.join(series.hint("merge"), on=key, how="left")
            .withColumn(out, F.coalesce(F.col(out), empty))
            .withColumn("n_points", F.coalesce(F.col("n_points"), F.lit(0).cast("long"))))
