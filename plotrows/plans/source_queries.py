"""Registered source, sink and model queries.

Each one derives its files from the driver tables with Spark (JSON, PNG) into
a fresh folder under the shared checkpoint root, then scans them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plotrows import constants as K
from plotrows.functions.series import decode_xxyy, encode_xxyy
from plotrows.operators.images import image_prep
from plotrows.operators.scoring import route_of, routed_scoring, train_class_model
from plotrows.plans.catalog import register
from plotrows.plans.corpus import build_corpus
from plotrows.plans.corpus_queries import _corpus_sql
from plotrows.plans.inference import cleaned_xxyy, submission
from plotrows.plans.inference_queries import _DEC_XXYY, _MELT, _ROUTE_SQL, _with
from plotrows.plans.training import EXCLUDED_TYPES, not_in
from plotrows.session import scratch_path
from plotrows.sources import fixtures as fx
from plotrows.sources.files import (annotation_to_image_path, default_class_listing, list_files, read_corpus, read_corpus_csv, read_header_csv,
                                    record_id, scan_annotations, scan_images)
from plotrows.sources.sinks import append_metrics, read_metrics, write_corpus, write_corpus_csv, write_files, write_submission


def write_annotation_lines(spark, sf_dir: str) -> str:
    """JSON Lines derived from charts + points: x as text, y as a JSON number, an extra key."""
    c = fx.charts_with_series(spark, sf_dir)
    series = F.transform("gts", lambda p: F.struct(p["x"].alias("x"), p["y"].cast("double").alias("y")))
    doc = c.select("image_id", F.col("source"), F.col("chart_type").alias("chart-type"),
                   series.alias("data-series"), F.struct(F.col("n_points").alias("k")).alias("extra"))
    out = scratch_path(spark, "annotations")
    doc.drop("image_id").write.mode("overwrite").option("maxRecordsPerFile", 1000).json(out)
    return out


@register("scan_annotation_lines", sql=fx.with_views(["labelled", "chart_points"], """
, ys AS (SELECT image_id, string_agg(CAST(CAST(y AS DOUBLE) AS VARCHAR), ';' ORDER BY pos) AS ys FROM chart_points GROUP BY image_id)
SELECT source, chart_type, CAST(n_points AS BIGINT) AS n_points,
       '<x_start>' || xs_text || '<x_end> <y_start>' || coalesce(ys, '') || '<y_end>' AS label
FROM labelled LEFT JOIN ys USING (image_id)""").replace(")\n\n, ys AS", "),\nys AS").replace(")\n, ys AS", "),\nys AS"))
def q_scan_annotation_lines(spark, sf_dir):
    """S1 over JSON Lines: annotations written from the charts and scanned back."""
    path = write_annotation_lines(spark, sf_dir)
    a = scan_annotations(spark, path, multi_line=False)
    return a.select("source", "chart_type",
                    F.size("gts").cast("long").alias("n_points"), encode_xxyy("gts").alias("label"))


# one document per customer: its orders as points, y as every kind of JSON scalar
_SCALARS_SQL = """CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS VARCHAR)
    WHEN 1 THEN printf('%.2f', o_totalprice) WHEN 2 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
    WHEN 3 THEN 'None' WHEN 4 THEN 'True'
    ELSE CAST(CAST(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || 'e2' AS DOUBLE) AS VARCHAR) END"""


def write_annotations(spark, sf_dir: str) -> str:
    """One annotation file per customer, in folders: <root>/train/annotations/<folder>/<id>.json."""
    o = fx.table(spark, sf_dir, "orders")
    price, whole, kind = F.format_string("%.2f", "o_totalprice"), F.floor("o_totalprice").cast("string"), F.col("o_orderkey") % 6
    y = (F.when(kind == 0, price).when(kind == 1, F.concat(F.lit('"'), price, F.lit('"'))).when(kind == 2, whole)
         .when(kind == 3, F.lit("null")).when(kind == 4, F.lit("true")).otherwise(F.concat(whole, F.lit("e2"))))
    point = F.concat(F.lit('{"x": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('", "y": '), y, F.lit("}"))
    series = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", point.alias("p")))).alias("ps"))
    c = fx.table(spark, sf_dir, "customer").join(series, "c_custkey", "left")
    points = F.coalesce(F.array_join(F.transform("ps", lambda p: p["p"]), ", "), F.lit(""))
    classes = F.array(*[F.lit(t) for t in K.CHART_TYPES])
    doc = F.concat(F.lit('{"source": "'), F.col("c_mktsegment"), F.lit('", "chart-type": "'), F.get(classes, (F.col("c_custkey") % 5).cast("int")),
                   F.lit('", "data-series": ['), points, F.lit('], "extra": {"k": 1, "x": "no point"}}'))
    name = F.concat(F.lit("train/annotations/"), (F.col("c_custkey") % 7).cast("string"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".json"))
    out = scratch_path(spark, "chart-files")
    write_files(c.select(name.alias("name"), doc.alias("doc")), "name", "doc", out).agg(F.sum("n_bytes")).first()
    return out


@register("scan_annotations", sql=f"""
WITH points AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS x, {_SCALARS_SQL} AS y FROM orders)
SELECT CAST(c_custkey AS VARCHAR) AS record_id,
       'train/annotations/' || (c_custkey % 7) || '/' || c_custkey || '.json' AS relative_path,
       'train/images/' || (c_custkey % 7) || '/' || c_custkey || '.jpg' AS image_path,
       any_value(c_mktsegment) AS source, {"[" + ", ".join(f"'{t}'" for t in K.CHART_TYPES) + "]"}[c_custkey % 5 + 1] AS chart_type,
       count(o_orderkey) AS n_points,
       '<x_start>' || coalesce(string_agg(x, ';' ORDER BY o_orderkey), '') || '<x_end> <y_start>' || coalesce(string_agg(y, ';' ORDER BY o_orderkey), '') || '<y_end>' AS label
FROM customer LEFT JOIN points ON o_custkey = c_custkey GROUP BY c_custkey""")
def q_scan_annotations(spark, sf_dir):
    """S1 + P2 + P6: one JSON document per file in nested folders, read back with its id and its place."""
    a = scan_annotations(spark, write_annotations(spark, sf_dir), recursive=True)
    return a.select("record_id", "relative_path", annotation_to_image_path("relative_path").alias("image_path"), "source", "chart_type",
                    F.size("gts").cast("long").alias("n_points"), encode_xxyy("gts").alias("label"))


# ------------------------------------------------------ files out and in ------

@register("corpus_files", sql=_corpus_sql("""
SELECT image_id, fold, CASE WHEN fold <> 0 THEN 'train' ELSE 'valid' END AS split, types, nullif(types, '') AS csv_types,
       n_points, label_xxyy AS label, label_xxyy AS csv_label
FROM corpus WHERE coalesce(types NOT IN ('scatter', 'horizontal_bar'), true)"""))
def q_corpus_files(spark, sf_dir):
    """Q1 -> S8 -> S5 -> Q4: the corpus written by fold and as CSV, read back by fold folders and by explicit schema."""
    path, csv = scratch_path(spark, "corpus"), scratch_path(spark, "corpus-csv")
    write_corpus(build_corpus(spark, sf_dir), path)
    write_corpus_csv(read_corpus(spark, path), csv)
    train = read_corpus(spark, path, folds=range(1, 10)).withColumn("split", F.lit("train"))
    valid = read_corpus(spark, path, folds=[0]).withColumn("split", F.lit("valid"))
    text = read_corpus_csv(spark, csv, "image_id long, image_path string, source string, types string, gts string, n_points long, label string, fold int")
    text = text.select("image_id", F.col("types").alias("csv_types"), encode_xxyy("gts").alias("csv_label"))
    both = train.unionByName(valid).filter(not_in("types", EXCLUDED_TYPES))
    return both.join(text, "image_id").select("image_id", "fold", "split", "types", "csv_types", "n_points", "label", "csv_label")


@register("submission_file", sql=_with(["predictions"], _DEC_XXYY, f"SELECT id, nullif(data_series, '') AS data_series, chart_type FROM ({_MELT})"))
def q_submission_file(spark, sf_dir):
    """The submission of the damaged labels, written as CSV and read back."""
    path = scratch_path(spark, "submission")
    write_submission(submission(cleaned_xxyy(fx.predictions(spark, sf_dir))), path)
    return read_header_csv(spark, path, "id string, data_series string, chart_type string")


@register("metric_log_append", sql=fx.with_views(["metric_log"], """
SELECT 'part-' || (step % 4) AS batch, run, metric, count(*) AS n, count(DISTINCT step) AS n_steps, round(sum(value), 6) AS total
FROM metric_log GROUP BY ALL"""))
def q_metric_log_append(spark, sf_dir):
    """The metric log appended in four batches, two of them twice, and read back."""
    log, path = fx.metric_log(spark, sf_dir), scratch_path(spark, "metric-log")
    for part in (0, 1, 2, 1, 3, 0):
        append_metrics(log.filter(F.col("step") % 4 == part), path, f"part-{part}")
    back = read_metrics(spark, path, log.schema)
    return back.groupBy("batch", "run", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("step").alias("n_steps"), F.round(F.sum("value"), 6).alias("total"))


def write_images(spark, sf_dir: str) -> str:
    out = scratch_path(spark, "images")
    write_files(fx.image_files(spark, sf_dir), "name", "content", out).agg(F.sum("n_bytes")).first()
    return out


@register("default_class_listing", sql="SELECT CAST(vec_id AS VARCHAR) || '.png' AS name, 'line' AS chart_type FROM embeddings")
def q_default_class_listing(spark, sf_dir):
    """S3 + P8: every image file found by a recursive walk gets the default class."""
    listed = default_class_listing(spark, write_images(spark, sf_dir))
    return listed.select(F.substring_index("filename", "/", -1).alias("name"), "chart_type")


# an 8 x 8 RGB image in one stored block: signature 8, header 25, data 12 + 11 + 8 * 25, end 12
@register("file_listing", sql="SELECT CAST(vec_id AS VARCHAR) || '.png' AS name, CAST(vec_id AS VARCHAR) AS record_id, CAST(268 AS BIGINT) AS length FROM embeddings")
def q_file_listing(spark, sf_dir):
    """S2 + P6: names, ids and sizes of the files of a folder; their content is not read."""
    return list_files(spark, write_images(spark, sf_dir)).select("name", record_id("name").alias("record_id"), "length")


@register("image_scan", sql="SELECT CAST(vec_id AS VARCHAR) || '.png' AS name, 8 AS height, 8 AS width, 3 AS channels FROM embeddings")
def q_image_scan(spark, sf_dir):
    return scan_images(spark, write_images(spark, sf_dir)).select(
        F.substring_index("path", "/", -1).alias("name"), "height", "width", "channels")


# 8 x 8 RGB images resized to 16 x 16: every value of every channel
@register("image_prep", sql="""
WITH g AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: CAST(greatest(least(round((v + 1) * 127.5), 255), 0) AS INTEGER)) AS g FROM embeddings),
ch AS (SELECT vec_id, [g, list_transform(g, lambda v: 255 - v), list_transform(g, lambda v: (v * 7) % 256)] AS ch FROM g),
tap AS (SELECT o, CAST(floor(p) AS INTEGER) AS a, CAST(least(floor(p) + 1, 7) AS INTEGER) AS b, p - floor(p) AS w
        FROM (SELECT o, greatest(0.0::DOUBLE, least(7.0::DOUBLE, (o + 0.5)::DOUBLE * 0.5::DOUBLE - 0.5::DOUBLE)) AS p FROM range(16) t(o))),
v AS (SELECT vec_id, (c * 16 + y.o) * 16 + x.o AS i,
             ch[c + 1][y.a * 8 + x.a + 1] * (1 - x.w) + ch[c + 1][y.a * 8 + x.b + 1] * x.w AS top,
             ch[c + 1][y.b * 8 + x.a + 1] * (1 - x.w) + ch[c + 1][y.b * 8 + x.b + 1] * x.w AS low, y.w AS wy
      FROM ch, range(3) k(c), tap y, tap x)
SELECT CAST(vec_id AS VARCHAR) || '.png' AS name, count(*) AS n_values,
       md5(string_agg(CAST(CAST(floor(((top * (1 - wy) + low * wy) / 255.0::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS values_md5
FROM v GROUP BY vec_id""")
def q_image_prep(spark, sf_dir):
    """S6 + T1-T4: decoded, reordered, resized, scaled, in channel-row-column order."""
    imgs = scan_images(spark, write_images(spark, sf_dir))
    prepped = image_prep(imgs, 16, 16)
    return prepped.select(F.substring_index("path", "/", -1).alias("name"), F.size("tensor").cast("long").alias("n_values"),
                          F.md5(F.array_join(F.transform("tensor", lambda v: F.floor(v * 10000).cast("string")), ",")).alias("values_md5"))


def _echo_model():
    return lambda s, prompt=None: s


def _strict_model():
    def model(s, prompt=None):
        if (s.str.len() == 0).any():
            raise ValueError("empty model input")
        return s
    return model


_ROUTED_SQL = _with(["predictions"], _DEC_XXYY, f"""
SELECT image_id, route, CASE WHEN failed THEN NULL ELSE raw END AS text,
       CASE WHEN failed THEN 'ValueError: empty model input' END AS error, ok AND NOT failed AS decoded
FROM (SELECT *, {_ROUTE_SQL} AS route, {_ROUTE_SQL} = 'all' AND raw = '' AS failed FROM dec)""")


@register("routed_scoring", sql=_ROUTED_SQL)
def q_routed_scoring(spark, sf_dir):
    p = fx.predictions(spark, sf_dir).withColumn("route", route_of("chart_type"))
    models = {K.ROUTE_HORIZONTAL: _echo_model, K.ROUTE_SCATTER_LINE: _echo_model, K.ROUTE_DEFAULT: _strict_model}
    scored = routed_scoring(p, "route", models, "raw", "image_id", prompt=K.SERIES_PROMPT)
    return scored.withColumn("decoded", decode_xxyy("text").isNotNull())


EPOCHS, RATE = 6, 2.0


def _training_sql() -> str:
    """The run of ``train_class_model`` epoch by epoch: softmax, fixed-point gradient sums, one step."""
    logits = "list_transform(w, lambda c: list_sum(list_transform(range(1, 66), lambda j: c[j] * x[j])))"
    ctes = ["d AS (SELECT id, list_append(px, 1.0::DOUBLE) AS x, CAST(raw_label % 5 AS INTEGER) AS y FROM pixels)",
            "t AS (SELECT * FROM d WHERE id % 10 <> 0)",
            "w0 AS (SELECT list_transform(range(5), lambda c: list_transform(range(65), lambda j: 0.0::DOUBLE)) AS w, NULL::DOUBLE AS loss)"]
    for e in range(EPOCHS):
        ctes += [f"l{e} AS (SELECT x, y, {logits} AS lg FROM t, w{e})",
                 f"m{e} AS (SELECT x, y, lg, list_max(lg) AS m, list_transform(lg, lambda v: exp(v - list_max(lg))) AS e FROM l{e})",
                 f"p{e} AS (SELECT x, y, ln(list_sum(e)) + m - lg[y + 1] AS ce, list_transform(e, lambda v, c: v / list_sum(e) - CASE WHEN c = y + 1 THEN 1 ELSE 0 END) AS p FROM m{e})",
                 f"""g{e} AS (SELECT c, j, sum(CAST(round(p[c] * x[j] * 1099511627776) AS HUGEINT))::DOUBLE / 1099511627776 / count(*) AS g
                     FROM p{e}, range(1, 6) a(c), range(1, 66) b(j) GROUP BY c, j)""",
                 f"""s{e} AS (SELECT c, list(w{e}.w[c][j] - {RATE}::DOUBLE * g ORDER BY j) AS w FROM g{e}, w{e} GROUP BY c)""",
                 f"w{e + 1} AS (SELECT (SELECT list(w ORDER BY c) FROM s{e}) AS w, (SELECT sum(CAST(round(ce * 1099511627776) AS HUGEINT))::DOUBLE / 1099511627776 / count(*) FROM p{e}) AS loss)"]
    epochs = " UNION ALL ".join(f"SELECT {e} AS epoch, * FROM w{e + 1}" for e in range(EPOCHS))
    ctes += [f"runs AS ({epochs})",
             f"v AS (SELECT epoch, loss, y, {logits} AS lg FROM d, runs WHERE id % 10 = 0)",
             "a AS (SELECT epoch, any_value(loss) AS loss, sum((list_position(lg, list_max(lg)) - 1 = y)::INT)::DOUBLE / count(*) AS accuracy FROM v GROUP BY epoch)"]
    head = fx.with_views(["pixels"], "SELECT 1").replace("\nSELECT 1", "")
    return head + ",\n" + ",\n".join(ctes) + """
SELECT CAST(epoch AS INTEGER) AS epoch, round(loss, 6) AS train_loss, round(accuracy, 6) AS accuracy,
       epoch = (SELECT min(epoch) FROM a WHERE accuracy = (SELECT max(accuracy) FROM a)) AS kept FROM a"""


@register("train_class_model", sql=_training_sql())
def q_train_class_model(spark, sf_dir):
    """M3: one run of the class model; every epoch's loss and accuracy, and which one is kept."""
    px = fx.pixels(spark, sf_dir).withColumn("label", (F.col("raw_label") % 5).cast("int"))
    run = train_class_model(px.filter(F.col("id") % 10 != 0), px.filter(F.col("id") % 10 == 0), "px", "label", 5, 64, EPOCHS, RATE)
    rows = [(e, loss, acc, e == run.kept) for e, (loss, acc) in enumerate(zip(run.losses, run.accuracies, strict=True))]
    df = spark.createDataFrame(rows, "epoch int, train_loss double, accuracy double, kept boolean")
    return df.select("epoch", F.round("train_loss", 6).alias("train_loss"), F.round("accuracy", 6).alias("accuracy"), "kept")
