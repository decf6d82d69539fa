"""Registered corpus queries: Q1 and the encode / fold / filter operators under it."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotrows import constants as K
from plotrows.functions import series as S
from plotrows.plans.catalog import register
from plotrows.plans.corpus import build_corpus, charts_with_folds, corpus
from plotrows.plans.training import EXCLUDED_TYPES, not_in
from plotrows.plans.sqlparts import folds_ctes, md5_key
from plotrows.sources import fixtures as fx

# ------------------------------------------------------------------ SQL -----

_FOLDS10 = folds_ctes("charts", "chart_type", "image_id", 10, "folds10")
_CORPUS_SQL_BASE = fx.with_views(["labelled"], "SELECT 1").replace("\nSELECT 1", "") + "," + _FOLDS10 + """,
corpus AS (SELECT l.*, l.chart_type AS types, f.fold FROM labelled l JOIN folds10 f USING (image_id))
"""


def _corpus_sql(body: str) -> str:
    return _CORPUS_SQL_BASE + body


def _points_rounded_sql(value_expr: str) -> str:
    """Corpus with per-point rounded text strings aggregated in order."""
    return _corpus_sql(f""",
rp AS (SELECT c.image_id, c.fold, p.pos,
              CASE WHEN c.fold = 0 THEN p.x ELSE {value_expr.format(v='p.x')} END AS rx,
              CASE WHEN c.fold = 0 THEN p.y ELSE {value_expr.format(v='p.y')} END AS ry
       FROM corpus c LEFT JOIN chart_points p USING (image_id)),
ra AS (SELECT image_id, fold, coalesce(string_agg(rx, ';' ORDER BY pos), '') AS xs,
              coalesce(string_agg(ry, ';' ORDER BY pos), '') AS ys,
              coalesce(string_agg(rx || ' | ' || ry, ' <0x0A> ' ORDER BY pos), '') AS xyxy
       FROM rp GROUP BY image_id, fold)
""")


_ROUND4 = ("CASE WHEN TRY_CAST({v} AS DOUBLE) IS NULL THEN {v} "
           "ELSE CAST(CAST(printf('%.4f', CAST({v} AS DOUBLE)) AS DOUBLE) AS VARCHAR) END")
_DIGIT = ("CASE WHEN TRY_CAST({v} AS DOUBLE) IS NOT NULL AND len(string_split({v}, '.')) = 2 THEN "
          "CASE WHEN length(split_part({v}, '.', 1)) > 2 THEN CAST(CAST(printf('%.2f', CAST({v} AS DOUBLE)) AS DOUBLE) AS VARCHAR) "
          "ELSE CAST(CAST(printf('%.4f', CAST({v} AS DOUBLE)) AS DOUBLE) AS VARCHAR) END ELSE {v} END")


@register("build_corpus", sql=_corpus_sql("""
SELECT image_id, image_path, source, types, fold, n_points, label_xxyy AS label FROM corpus"""))
def q_build_corpus(spark, sf_dir):
    return build_corpus(spark, sf_dir).select("image_id", "image_path", "source", "types", "fold",
                                              "n_points", "label")


@register("encode_xxyy", sql=fx.with_views(["labelled"], "SELECT image_id, n_points, label_xxyy AS label FROM labelled"))
def q_encode_xxyy(spark, sf_dir):
    return fx.charts_with_series(spark, sf_dir).select("image_id", "n_points",
                                                       S.encode_xxyy("gts").alias("label"))


@register("encode_xyxy", sql=fx.with_views(["labelled"], "SELECT image_id, n_points, label_xyxy AS label FROM labelled"))
def q_encode_xyxy(spark, sf_dir):
    return fx.charts_with_series(spark, sf_dir).select("image_id", "n_points",
                                                       S.encode_xyxy("gts").alias("label"))


@register("encode_xxyy_round", sql=_points_rounded_sql(_ROUND4) + """
SELECT image_id, fold, '<x_start>' || xs || '<x_end> <y_start>' || ys || '<y_end>' AS label FROM ra""")
def q_encode_xxyy_round(spark, sf_dir):
    return corpus(spark, sf_dir).select("image_id", "fold",
                                        S.encode_xxyy_rounded("gts", "fold").alias("label"))


@register("encode_xyxy_round", sql=_points_rounded_sql(_ROUND4) + """
SELECT image_id, fold, xyxy AS label FROM ra""")
def q_encode_xyxy_round(spark, sf_dir):
    return corpus(spark, sf_dir).select("image_id", "fold",
                                        S.encode_xyxy_rounded("gts", "fold").alias("label"))


@register("encode_digit_round", sql=_points_rounded_sql(_DIGIT) + """
SELECT image_id, fold, '<x_start>' || xs || '<x_end> <y_start>' || ys || '<y_end>' AS label FROM ra""")
def q_encode_digit_round(spark, sf_dir):
    return corpus(spark, sf_dir).select("image_id", "fold",
                                        S.encode_xxyy_rounded("gts", "fold", digit_aware=True).alias("label"))


@register("encode_bos", sql=_points_rounded_sql(_ROUND4) + """
SELECT image_id, '<|BOS|><' || types || '>' || '<x_start>' || xs || '<x_end> <y_start>' || ys || '<y_end>' AS label_bos_xxyy,
       '<|BOS|><' || types || '>' || label_xyxy AS label_bos_xyxy FROM corpus JOIN ra USING (image_id)""")
def q_encode_bos(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.select("image_id",
                    S.encode_label("gts", "types", "fold", "bos_xxyy").alias("label_bos_xxyy"),
                    S.encode_label("gts", "types", "fold", "bos_xyxy").alias("label_bos_xyxy"))


@register("label_dispatch", sql=_points_rounded_sql(_ROUND4) + """
SELECT image_id, 'xxyy' AS label_type, label_xxyy AS label FROM corpus
UNION ALL SELECT image_id, 'xyxy', label_xyxy FROM corpus
UNION ALL SELECT image_id, 'bos_xxyy', '<|BOS|><' || types || '>' || '<x_start>' || xs || '<x_end> <y_start>' || ys || '<y_end>'
          FROM corpus JOIN ra USING (image_id)
UNION ALL SELECT image_id, 'bos_xyxy', '<|BOS|><' || types || '>' || label_xyxy FROM corpus""")
def q_label_dispatch(spark, sf_dir):
    c = corpus(spark, sf_dir)
    kinds = K.LABEL_TYPES
    rows = F.array(*[F.struct(F.lit(t).alias("label_type"),
                              S.encode_label("gts", "types", "fold", t).alias("label")) for t in kinds])
    return c.select("image_id", F.inline(rows))


_TOKENS_SQL = "[" + ", ".join(f"'{t}'" for t in K.SPECIAL_TOKENS) + "]"


@register("token_audit", sql=_corpus_sql(f""",
bl AS (SELECT '<|BOS|><' || types || '>' || label_xxyy AS label FROM corpus),
tk AS (SELECT unnest({_TOKENS_SQL}) AS token, label FROM bl)
SELECT token,
       CAST(sum(CASE WHEN contains(label, token) THEN 1 ELSE 0 END) AS BIGINT) AS n_labels,
       CAST(sum((length(label) - length(replace(label, token, ''))) // length(token)) AS BIGINT) AS n_occurrences
FROM tk GROUP BY token"""))
def q_token_audit(spark, sf_dir):
    c = fx.charts_with_series(spark, sf_dir).withColumnRenamed("chart_type", "types").withColumn("fold", F.lit(0))
    lab = S.encode_label("gts", "types", "fold", "bos_xxyy")
    labels = c.select(lab.alias("label"))
    aggs = []
    for i, tok in enumerate(K.SPECIAL_TOKENS):
        occ = F.floor((F.length("label") - F.length(F.replace(F.col("label"), F.lit(tok), F.lit(""))))
                      / len(tok))
        aggs.append(F.sum(F.col("label").contains(tok).cast("long")).alias(f"l{i}"))
        aggs.append(F.sum(occ).cast("long").alias(f"o{i}"))
    wide = labels.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(tok).alias("token"), F.col(f"l{i}").alias("n_labels"),
                              F.col(f"o{i}").alias("n_occurrences"))
                     for i, tok in enumerate(K.SPECIAL_TOKENS)])
    return wide.select(F.inline(rows))


@register("stratified_folds", sql=fx.with_views(["charts"], "SELECT 1").replace("\nSELECT 1", "") + "," + _FOLDS10 + """
SELECT c.image_id, c.chart_type, f.fold FROM charts c JOIN folds10 f USING (image_id)""")
def q_stratified_folds(spark, sf_dir):
    return charts_with_folds(spark, sf_dir).select("image_id", "chart_type", "fold")


@register("stratified_folds_shuffled", sql=fx.with_views(["charts"], "SELECT 1").replace("\nSELECT 1", "") + ","
          + folds_ctes("charts", "chart_type", "image_id", 5, "folds5", order=md5_key("image_id") + ", image_id") + """
SELECT c.image_id, c.chart_type, f.fold FROM charts c JOIN folds5 f USING (image_id)""")
def q_stratified_folds_shuffled(spark, sf_dir):
    return charts_with_folds(spark, sf_dir, k=5, shuffle=True, seed=K.SEED).select("image_id", "chart_type", "fold")


@register("fold_class_counts", sql=_corpus_sql("""
SELECT fold, types, count(*) AS n FROM corpus GROUP BY fold, types"""))
def q_fold_class_counts(spark, sf_dir):
    f = charts_with_folds(spark, sf_dir)
    return f.groupBy("fold", F.col("chart_type").alias("types")).agg(F.count(F.lit(1)).alias("n"))


@register("fold_split", sql=_corpus_sql("""
SELECT image_id, fold, CASE WHEN fold <> 0 THEN 'train' ELSE 'valid' END AS split FROM corpus"""))
def q_fold_split(spark, sf_dir):
    f = charts_with_folds(spark, sf_dir)
    return f.select("image_id", "fold", F.when(F.col("fold") != 0, "train").otherwise("valid").alias("split"))


@register("class_exclusion", sql=_corpus_sql("""
SELECT image_id, types, fold FROM corpus WHERE coalesce(types NOT IN ('scatter', 'horizontal_bar'), true)"""))
def q_class_exclusion(spark, sf_dir):
    f = charts_with_folds(spark, sf_dir).withColumnRenamed("chart_type", "types")
    return f.filter(not_in("types", EXCLUDED_TYPES)).select("image_id", "types", "fold")


@register("single_class_valid", sql=_corpus_sql("""
SELECT image_id, types, fold FROM corpus WHERE types = 'scatter' AND fold = 0"""))
def q_single_class_valid(spark, sf_dir):
    f = charts_with_folds(spark, sf_dir).withColumnRenamed("chart_type", "types")
    return f.filter((F.col("types") == "scatter") & (F.col("fold") == 0)).select("image_id", "types", "fold")


@register("image_path", sql=fx.with_views(["charts"], """
SELECT image_id, annotation_path,
       replace(replace(annotation_path, 'annotations', 'images'), 'json', 'jpg') AS image_path
FROM (SELECT image_id, './train/annotations/' || CAST(image_id AS VARCHAR) || '.json' AS annotation_path FROM charts)"""))
def q_image_path(spark, sf_dir):
    from plotrows.sources.files import annotation_to_image_path
    c = fx.charts(spark, sf_dir).select(
        "image_id", F.concat(F.lit("./train/annotations/"), F.col("image_id").cast("string"),
                             F.lit(".json")).alias("annotation_path"))
    return c.withColumn("image_path", annotation_to_image_path("annotation_path"))


@register("class_counts", sql=fx.with_views(["charts"], """
SELECT chart_type, n, row_number() OVER (ORDER BY n DESC, chart_type) - 1 AS rank
FROM (SELECT chart_type, count(*) AS n FROM charts WHERE chart_type IS NOT NULL GROUP BY chart_type)"""))
def q_class_counts(spark, sf_dir):
    from plotrows.operators.metrics import value_counts
    return value_counts(fx.charts(spark, sf_dir), "chart_type")
