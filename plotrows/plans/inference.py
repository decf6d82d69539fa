"""Q2/Q3: decode model text, clean, truncate, and melt into submission rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotrows import constants as K
from plotrows.functions import series as S
from plotrows.operators.hooks import transform_rows
from plotrows.operators.scoring import ScorerFactory, route_of, routed_scoring
from plotrows.sources.files import name_contains, record_id


def image_name(path) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.substring_index(p, "/", -1)


def decoded_xxyy(preds: DataFrame, raw: str = "raw") -> DataFrame:
    """E5 + E7: decoded arrays with the decode-failure fallback and an ``error`` column."""
    d = preds.withColumn("_dec", S.decode_xxyy(raw))
    d = d.withColumn("error", F.when(F.col("_dec").isNull(), F.lit("decode_failed")))
    fb = S.with_decode_fallback(F.col("_dec"))
    return d.withColumn("xs", fb["xs"]).withColumn("ys", fb["ys"]).drop("_dec")


def cleaned_xxyy(preds: DataFrame, raw: str = "raw", chart_type: str = "chart_type") -> DataFrame:
    """E8 + L4 + E10 + E11 + P12: (image_id, chart_type, x_series, y_series, error)."""
    d = decoded_xxyy(preds, raw)
    xs = F.transform("xs", S.clean_x_xxyy)
    ys = F.transform("ys", S.clean_y_xxyy)
    n = S.shorter_length(F.col("xs"), F.col("ys"))
    ct = F.col(chart_type)
    record_failed = ct.isNull()
    graph_type = (F.when(record_failed, F.lit(K.DEFAULT_CLASS))
                  .when(F.length(ct) == 0, F.lit(K.DEFAULT_CLASS)).otherwise(ct))
    return d.select(
        "*",
        graph_type.alias("_type"),
        F.when(record_failed, F.lit(K.RECORD_FALLBACK_SERIES)).otherwise(S.truncate_join(xs, n)).alias("x_series"),
        F.when(record_failed, F.lit(K.RECORD_FALLBACK_SERIES)).otherwise(S.truncate_join(ys, n)).alias("y_series"),
    ).drop(chart_type).withColumnRenamed("_type", chart_type)


def decoded_xyxy(preds: DataFrame, raw: str = "raw") -> DataFrame:
    """Decoded arrays, ``error`` where the original raises, ``note`` where its numbers may differ."""
    d = preds.withColumn("_dec", S.decode_xyxy(raw))
    return (d.withColumn("error", F.when(F.col("_dec").isNull(), F.lit("parse_failed")))
            .withColumn("note", F.when(F.col("_dec.inexact"), F.lit("inexact_number")))
            .withColumn("xs", F.col("_dec.xs")).withColumn("ys", F.col("_dec.ys")).drop("_dec"))


def cleaned_xyxy(preds: DataFrame, raw: str = "raw", chart_type: str = "chart_type") -> DataFrame:
    """E6 + E9 + L4 + E10 + E11: any per-record failure gives ``line``, ``0;0``, ``0;0``."""
    d = decoded_xyxy(preds, raw)
    ct = F.col(chart_type)
    ys = F.transform("ys", S.clean_xyxy_value)
    xs = F.when(ct.isin("dot", "scatter"), F.transform("xs", S.clean_xyxy_value)).otherwise(F.col("xs"))
    n = S.shorter_length(F.col("xs"), F.col("ys"))
    failed = F.col("error").isNotNull() | ct.isNull()
    return d.select(
        "*",
        F.when(failed, F.lit(K.DEFAULT_CLASS)).otherwise(ct).alias("_type"),
        F.when(failed, F.lit(K.RECORD_FALLBACK_SERIES)).otherwise(S.truncate_join(xs, n)).alias("x_series"),
        F.when(failed, F.lit(K.RECORD_FALLBACK_SERIES)).otherwise(S.truncate_join(ys, n)).alias("y_series"),
    ).drop(chart_type).withColumnRenamed("_type", chart_type)


def with_class(images: DataFrame, features: str, scorer: ScorerFactory, classes: Sequence[str] = K.CHART_TYPES) -> DataFrame:
    """M1 inside a chain: adds ``chart_type``, the class with the first highest score, or NULL where the scorer fails."""
    names = list(classes)

    def factory():
        model = scorer()

        def call(batch: pa.RecordBatch) -> dict:
            x = batch[features].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            return {"chart_type": [names[i] for i in np.asarray(model(x)).argmax(axis=1)]}
        return call
    return transform_rows(images, factory, [features], "chart_type string", error="class_error", rows_per_call=4096)


def routed_texts(images: DataFrame, scorer: ScorerFactory, models: Mapping[str, Callable[[], Callable]],
                 prepare: Mapping[str, Callable[[Column], Column]] | None = None, route: Callable[[str], Column] = route_of,
                 needle: str = ".jpg") -> DataFrame:
    """S4 -> M1 -> F5 -> U2 -> M2: the texts of the series models over a listing with decoded images.

    ``images`` has ``image_path`` and ``px`` (0..255).  The files whose names hold
    ``needle`` are classified on the scaled values (T3); the class chooses the series model
    and how its input is prepared.  Returns (image_path, route, chart_type, raw, error).
    """
    listed = images.filter(name_contains(image_name("image_path"), needle))
    scaled = listed.withColumn("_x", F.transform("px", lambda v: (v / 255.0 - 0.5) / 0.5))
    classed = with_class(scaled, "_x", scorer).withColumn("route", route("chart_type"))
    return routed_scoring(classed, "route", models, "px", "image_path", out_col="raw", prompt=K.SERIES_PROMPT,
                          prepare=prepare, keep=["chart_type"])


def melt_xy(df: DataFrame, id_col: Column, x_col: str, y_col: str, type_col: str) -> DataFrame:
    """One record -> ``<id>_x`` and ``<id>_y`` rows in a single generator pass (no union)."""
    rows = F.array(
        F.struct(F.concat(id_col, F.lit("_x")).alias("id"), F.col(x_col).alias("data_series"),
                 F.col(type_col).alias("chart_type")),
        F.struct(F.concat(id_col, F.lit("_y")).alias("id"), F.col(y_col).alias("data_series"),
                 F.col(type_col).alias("chart_type")),
    )
    return df.select(F.inline(rows))


def submission(cleaned: DataFrame, path_col: str = "image_path") -> DataFrame:
    """Q2/Q3 tail: (id, data_series, chart_type), two rows per image."""
    return melt_xy(cleaned, record_id(image_name(path_col)), "x_series", "y_series", "chart_type")
