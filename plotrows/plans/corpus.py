"""Q1 building blocks: corpus frame, folds, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotrows.functions.series import encode_label
from plotrows.operators.folds import stratified_kfold
from plotrows.operators.series import attach_series
from plotrows.sources import fixtures as fx


def charts_with_folds(spark: SparkSession, sf_dir: str, k: int = 10, shuffle: bool = False,
                      seed: int = 42) -> DataFrame:
    """charts + fold, assigned on the narrow (image_id, type) rows."""
    c = fx.charts(spark, sf_dir).select("image_id", "chart_type")
    return stratified_kfold(c, "chart_type", ["image_id"], k=k, shuffle=shuffle, seed=seed)


def corpus(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """(image_id, image_path, source, types, fold, gts, n_points): the Q1 frame before labels.

    Only (image_id, type) goes through the fold numbering; folds and series are
    joined on ``image_id``.
    """
    charts = fx.charts(spark, sf_dir).join(charts_with_folds(spark, sf_dir, k).select("image_id", "fold"), "image_id")
    framed = attach_series(charts, fx.chart_series(spark, sf_dir))
    return framed.withColumnRenamed("chart_type", "types")


def build_corpus(spark: SparkSession, sf_dir: str, label_type: str = "xxyy", k: int = 10) -> DataFrame:
    """Q1: annotations -> folds -> labels (the written corpus keeps ``gts`` nested)."""
    c = corpus(spark, sf_dir, k)
    return c.withColumn("label", encode_label("gts", "types", "fold", label_type))
