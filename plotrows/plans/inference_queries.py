"""Registered inference queries: Q2, Q3 and their decode / clean / route / melt steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotrows import constants as K
from plotrows.functions.numbers import argmax
from plotrows.functions.series import decode_xxyy
from plotrows.operators.images import resize_plane
from plotrows.operators.scoring import linear_scorer_factory, route_of, score_classes
from plotrows.plans import inference as I
from plotrows.plans.catalog import register
from plotrows.sources import fixtures as fx
from plotrows.sources.files import name_contains, record_id

# ------------------------------------------------------------------ SQL -----

_DEC_XXYY = """,
d0 AS (SELECT image_id, image_path, chart_type, raw,
              CASE WHEN contains(raw, '<x_end><y_start>') THEN string_split(raw, '<x_end><y_start>')
                   ELSE string_split(raw, '<x_end> <y_start>') END AS parts FROM predictions),
d1 AS (SELECT *, string_split(parts[1], '<x_start>')[2] AS x_side,
              string_split(parts[2], '<y_end>')[1] AS y_side FROM d0),
dec AS (SELECT image_id, image_path, chart_type, raw,
               x_side IS NOT NULL AND y_side IS NOT NULL AS ok,
               CASE WHEN x_side IS NULL OR y_side IS NULL THEN 'decode_failed' END AS error,
               CASE WHEN x_side IS NULL OR y_side IS NULL THEN ['0'] ELSE string_split(x_side, ';') END AS xs,
               CASE WHEN x_side IS NULL OR y_side IS NULL THEN ['0'] ELSE string_split(y_side, ';') END AS ys
        FROM d1),
cl AS (SELECT *,
              list_transform(xs, lambda v: CASE WHEN length(v) = 0 THEN '0' ELSE v END) AS xc,
              list_transform(ys, lambda v: CASE
                  WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN
                       CASE WHEN isnan(TRY_CAST(v AS DOUBLE)) OR isinf(TRY_CAST(v AS DOUBLE)) THEN '0'
                            ELSE CAST(TRY_CAST(v AS DOUBLE) AS VARCHAR) END
                  WHEN length(v) = 0 THEN '0' ELSE v END) AS yc,
              least(len(xs), len(ys)) AS n
       FROM dec),
wide AS (SELECT image_id, image_path, error,
                CASE WHEN chart_type IS NULL OR length(chart_type) = 0 THEN 'line' ELSE chart_type END AS chart_type,
                CASE WHEN chart_type IS NULL THEN '0;0'
                     ELSE array_to_string(list_transform(xc[1:n], lambda v: trim(v)), ';') END AS x_series,
                CASE WHEN chart_type IS NULL THEN '0;0'
                     ELSE array_to_string(list_transform(yc[1:n], lambda v: trim(v)), ';') END AS y_series
         FROM cl)
"""

_NA_SQL = "(" + ", ".join(f"'{w}'" for w in K.PANDAS_NA_WORDS) + ")"
_NUM = " *[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)? *|[+-]?(?i:inf|infinity)"


def _norm_cell(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL OR {expr} IN {_NA_SQL} THEN NULL ELSE {expr} END"


def _type_sql(col: str) -> str:
    bare = "regexp_replace(c, '^ +| +$', '', 'g')"
    return f"""CASE WHEN len(list_filter({col}, lambda c: c IS NULL)) = 0
                 AND len(list_filter({col}, lambda c: regexp_full_match(c, ' *[+-]?[0-9]+ *'))) = len({col})
            THEN list_transform({col}, lambda c: CAST(CAST({bare} AS HUGEINT) AS VARCHAR))
            WHEN len(list_filter({col}, lambda c: regexp_full_match(c, '{_NUM}')))
                 + len(list_filter({col}, lambda c: c IS NULL)) = len({col})
            THEN list_transform({col}, lambda c: coalesce(CAST(CAST({bare} AS DOUBLE) AS VARCHAR), 'nan'))
            WHEN len(list_filter({col}, lambda c: regexp_full_match(c, 'True|TRUE|true|False|FALSE|false')))
                 + len(list_filter({col}, lambda c: c IS NULL)) = len({col})
            THEN list_transform({col}, lambda c: coalesce(CASE lower(c) WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' END, 'nan'))
            ELSE list_transform({col}, lambda c: coalesce(c, 'nan')) END"""


_E9 = ("list_transform({v}, lambda v: CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL "
       "OR isnan(TRY_CAST(v AS DOUBLE)) THEN '0' ELSE v END)")

_CELL_SQL = '(?:"(?:[^"]|"")*"[^\\t\\r\\n]*|[^\\t\\r\\n"][^\\t\\r\\n]*|)(?:\\t|\\r\\n|\\n|\\r)'
_DEC_XYXY = f""",
yt AS (SELECT *, regexp_extract_all(t, '{_CELL_SQL}') AS k
       FROM (SELECT *, replace(replace(raw, '<0x0A>', chr(10)), ' | ', chr(9)) || chr(10) AS t FROM predictions_xyxy)),
yl AS (SELECT *, length(array_to_string(k, '')) <> length(t) AS broken,
              string_split(array_to_string(list_transform(k, lambda v: CASE WHEN right(v, 1) = chr(9) THEN left(v, length(v) - 1) || chr(1)
                                                                       ELSE left(v, length(v) - 1) || chr(2) END), ''), chr(2)) AS ls FROM yt),
y0 AS (SELECT image_id, image_path, chart_type, raw, broken,
              CASE WHEN NOT broken THEN list_transform(list_filter(ls[1:len(ls) - 1], lambda r: NOT regexp_full_match(r, ' *')),
                  lambda r: list_transform(string_split(r, chr(1)), lambda c: CASE WHEN left(c, 1) = '"'
                      THEN replace(regexp_extract(c, '(?s)^"((?:[^"]|"")*)"(.*)$', 1), '""', '"') || regexp_extract(c, '(?s)^"((?:[^"]|"")*)"(.*)$', 2) ELSE c END)) END AS cells
       FROM yl),
yw AS (SELECT *, greatest(coalesce(len(cells[1]), 2), 2) AS w FROM y0),
y1 AS (SELECT *, broken OR coalesce(len(list_filter(cells, lambda c: len(c) > w)), 0) > 0 AS bad,
              list_transform(cells, lambda c: {_norm_cell('c[w - 1]')}) AS xn,
              list_transform(cells, lambda c: {_norm_cell('c[w]')}) AS yn
       FROM yw),
y2 AS (SELECT image_id, image_path, chart_type, raw, bad,
              CASE WHEN bad THEN NULL ELSE {_type_sql('xn')} END AS xs,
              CASE WHEN bad THEN NULL ELSE {_type_sql('yn')} END AS ys
       FROM y1),
y3 AS (SELECT *, CASE WHEN chart_type IN ('dot', 'scatter') THEN {_E9.format(v='xs')} ELSE xs END AS xc,
              {_E9.format(v='ys')} AS yc, least(len(xs), len(ys)) AS n,
              bad OR chart_type IS NULL AS failed
       FROM y2),
wide AS (SELECT image_id, image_path, CASE WHEN bad THEN 'parse_failed' END AS error,
                CASE WHEN failed THEN 'line' ELSE chart_type END AS chart_type,
                CASE WHEN failed THEN '0;0' ELSE array_to_string(list_transform(xc[1:n], lambda v: trim(v)), ';') END AS x_series,
                CASE WHEN failed THEN '0;0' ELSE array_to_string(list_transform(yc[1:n], lambda v: trim(v)), ';') END AS y_series
         FROM y3)
"""


def _with(names, extra: str, body: str) -> str:
    head = fx.with_views(names, "SELECT 1").replace("\nSELECT 1", "")
    return head + extra + body


_MELT = """
SELECT split_part(regexp_extract(image_path, '[^/]*$'), '.', 1) || '_x' AS id, x_series AS data_series, chart_type FROM wide
UNION ALL
SELECT split_part(regexp_extract(image_path, '[^/]*$'), '.', 1) || '_y' AS id, y_series AS data_series, chart_type FROM wide"""


# ------------------------------------------------------------- queries ------

@register("decode_xxyy", sql=_with(["predictions"], _DEC_XXYY, """
SELECT image_id, ok, CASE WHEN ok THEN array_to_string(xs, ';') END AS xs_text,
       CASE WHEN ok THEN array_to_string(ys, ';') END AS ys_text,
       CASE WHEN ok THEN len(xs) END AS n_x, CASE WHEN ok THEN len(ys) END AS n_y FROM dec"""))
def q_decode_xxyy(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    d = p.select("image_id", decode_xxyy("raw").alias("d"))
    return d.select("image_id", F.col("d").isNotNull().alias("ok"),
                    F.array_join("d.xs", ";").alias("xs_text"), F.array_join("d.ys", ";").alias("ys_text"),
                    F.size("d.xs").cast("long").alias("n_x"), F.size("d.ys").cast("long").alias("n_y")) \
        .withColumn("n_x", F.when(F.col("ok"), F.col("n_x"))).withColumn("n_y", F.when(F.col("ok"), F.col("n_y")))


@register("decode_fallback", sql=_with(["predictions"], _DEC_XXYY, """
SELECT image_id, chart_type, error, array_to_string(xs, ';') AS xs_text, array_to_string(ys, ';') AS ys_text FROM dec"""))
def q_decode_fallback(spark, sf_dir):
    d = I.decoded_xxyy(fx.predictions(spark, sf_dir))
    return d.select("image_id", "chart_type", "error", F.array_join("xs", ";").alias("xs_text"),
                    F.array_join("ys", ";").alias("ys_text"))


@register("clean_xxyy", sql=_with(["predictions"], _DEC_XXYY, """
SELECT image_id, chart_type, error, x_series, y_series FROM wide"""))
def q_clean_xxyy(spark, sf_dir):
    c = I.cleaned_xxyy(fx.predictions(spark, sf_dir))
    return c.select("image_id", "chart_type", "error", "x_series", "y_series")


@register("decode_xyxy", sql=_with(["predictions_xyxy"], _DEC_XYXY, """
SELECT image_id, NOT bad AS ok, array_to_string(xs, ';') AS xs_text, array_to_string(ys, ';') AS ys_text FROM y2"""))
def q_decode_xyxy(spark, sf_dir):
    d = I.decoded_xyxy(fx.predictions_xyxy(spark, sf_dir))
    return d.select("image_id", F.col("error").isNull().alias("ok"), F.array_join("xs", ";").alias("xs_text"),
                    F.array_join("ys", ";").alias("ys_text"))


@register("clean_xyxy", sql=_with(["predictions_xyxy"], _DEC_XYXY, """
SELECT image_id, chart_type, error, x_series, y_series FROM wide"""))
def q_clean_xyxy(spark, sf_dir):
    c = I.cleaned_xyxy(fx.predictions_xyxy(spark, sf_dir))
    return c.select("image_id", "chart_type", "error", "x_series", "y_series")


@register("melt_xy", sql=fx.with_views(["labelled"], """
SELECT CAST(image_id AS VARCHAR) || '_x' AS id, xs_text AS data_series, chart_type FROM labelled
UNION ALL SELECT CAST(image_id AS VARCHAR) || '_y', ys_text, chart_type FROM labelled"""))
def q_melt_xy(spark, sf_dir):
    c = fx.charts_with_series(spark, sf_dir)
    c = c.select("image_id", "chart_type",
                 F.array_join(F.transform("gts", lambda p: p["x"]), ";").alias("xs"),
                 F.array_join(F.transform("gts", lambda p: p["y"]), ";").alias("ys"))
    return I.melt_xy(c, F.col("image_id").cast("string"), "xs", "ys", "chart_type")


_ROUTE_SQL = ("CASE WHEN chart_type = 'horizontal_bar' THEN 'horizontal_bar' "
              "WHEN chart_type IN ('scatter', 'line') THEN 'scatter_line' ELSE 'all' END")


@register("route_counts", sql=fx.with_views(["charts"], f"""
SELECT {_ROUTE_SQL} AS route, count(*) AS n FROM charts GROUP BY 1"""))
def q_route_counts(spark, sf_dir):
    c = fx.charts(spark, sf_dir)
    return c.groupBy(route_of("chart_type").alias("route")).agg(F.count(F.lit(1)).alias("n"))


@register("join_predictions", sql=fx.with_views(["charts", "predictions"], """
SELECT c.image_id, regexp_extract(c.image_path, '[^/]*$') AS image_name, p.chart_type, c.source,
       CAST(length(p.raw) AS BIGINT) AS raw_length
FROM charts c JOIN predictions p USING (image_id)"""))
def q_join_predictions(spark, sf_dir):
    c = fx.charts(spark, sf_dir).select("image_id", "image_path", "source")
    p = fx.predictions(spark, sf_dir).select("image_id", "chart_type", "raw")
    j = c.join(p, "image_id")
    return j.select("image_id", I.image_name("image_path").alias("image_name"), "chart_type", "source",
                    F.length("raw").cast("long").alias("raw_length"))


_CLASS_CASE = "CASE chart_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.CLASS_TO_INDEX.items()) + " END"


def class_index(col: str, strict: bool = True) -> F.Column:
    """Class -> index from the canonical map; strict raises on an unknown class."""
    m = F.create_map(*[x for k, v in K.CLASS_TO_INDEX.items() for x in (F.lit(k), F.lit(v))])
    idx = m[F.col(col)]
    if strict:
        idx = F.coalesce(idx, F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col(col), F.lit("NULL")))).cast("int"))
    return idx


def class_name(idx) -> F.Column:
    """Index -> class name."""
    names = F.array(*[F.lit(n) for n in K.CHART_TYPES])
    return F.get(names, idx)


@register("class_encode", sql=fx.with_views(["charts"], f"""
SELECT image_id, chart_type, {_CLASS_CASE} AS label FROM charts"""))
def q_class_encode(spark, sf_dir):
    c = fx.charts(spark, sf_dir)
    return c.select("image_id", "chart_type", class_index("chart_type", strict=False).alias("label"))


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in K.CHART_TYPES) + "]"


@register("class_decode", sql=fx.with_views(["scores"], f"""
SELECT id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred_idx,
       {_NAMES_SQL}[list_position(logits, list_max(logits))] AS pred_class FROM scores"""))
def q_class_decode(spark, sf_dir):
    s = fx.scores(spark, sf_dir)
    return s.select("id", argmax("logits").alias("pred_idx"), class_name(argmax("logits")).alias("pred_class"))


def _linear_logits_sql(arr: str, n_features: int, salt: int = 0) -> list[str]:
    out = []
    for c in range(5):
        out.append(f"list_sum(list_transform(range(1, {n_features + 1}), lambda j: {arr}[j] * "
                   f"((({c * 13} + (j - 1) * 7 + {salt * 5}) % 11) - 5) / 10.0))")
    return out


_LOGITS = _linear_logits_sql("px", 64)


@register("score_classes", sql=fx.with_views(["pixels"], f"""
SELECT id, CAST(list_position(lg, list_max(lg)) - 1 AS INTEGER) AS pred_idx,
       {_NAMES_SQL}[list_position(lg, list_max(lg))] AS pred_class
FROM (SELECT id, [{', '.join(_LOGITS)}] AS lg FROM pixels)"""))
def q_score_classes(spark, sf_dir):
    px = fx.pixels(spark, sf_dir)
    return score_classes(px, "px", linear_scorer_factory(5, 64)).select("id", "pred_idx", "pred_class")


@register("jpg_listing", sql=fx.with_views(["charts"], """
SELECT * FROM (
  SELECT 'charts' AS listing, image_id AS ref_id, regexp_extract(image_path, '[^/]*$') AS name FROM charts
  UNION ALL
  SELECT 'pages', page_id, regexp_extract(url, '[^/]*$') FROM pages)
WHERE contains(name, '.jpg')"""))
def q_jpg_listing(spark, sf_dir):
    c = fx.charts(spark, sf_dir).select(F.lit("charts").alias("listing"), F.col("image_id").alias("ref_id"),
                                        I.image_name("image_path").alias("name"))
    p = fx.table(spark, sf_dir, "pages").select(F.lit("pages").alias("listing"), F.col("page_id").alias("ref_id"),
                                                F.regexp_extract("url", "[^/]*$", 0).alias("name"))
    return c.unionByName(p).filter(name_contains("name", ".jpg"))


@register("image_id", sql="""
SELECT page_id, regexp_extract(url, '[^/]*$') AS name, split_part(regexp_extract(url, '[^/]*$'), '.', 1) AS record_id
FROM pages""")
def q_image_id(spark, sf_dir):
    p = fx.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "[^/]*$", 0).alias("name"))
    return p.withColumn("record_id", record_id("name"))


@register("path_rewrite", sql=fx.with_views(["extra_metadata"], """
SELECT file_name, 'train_extra' || '/' || file_name AS joined_path,
       replace('/data/charts/train_extra/' || file_name, '/data/charts', '.') AS rewritten_path
FROM extra_metadata"""))
def q_path_rewrite(spark, sf_dir):
    m = fx.extra_metadata(spark, sf_dir).select("file_name")
    return m.select("file_name", F.concat_ws("/", F.lit("train_extra"), "file_name").alias("joined_path"),
                    F.replace(F.concat(F.lit("/data/charts/train_extra/"), "file_name"), F.lit("/data/charts"),
                              F.lit(".")).alias("rewritten_path"))


@register("map_to_rows", sql=fx.with_views(["charts"], """
SELECT image_path AS filename, 'line' AS chart_type FROM charts"""))
def q_map_to_rows(spark, sf_dir):
    c = fx.charts(spark, sf_dir)
    m = c.select(F.create_map(F.col("image_path"), F.lit(K.DEFAULT_CLASS)).alias("m"))
    return m.select(F.explode("m").alias("filename", "chart_type"))


# ------------------------------------------------- listing -> submission ------

def _text(v: float) -> str:
    return str(int(v)) if v == int(v) else str(v)


def _label(xs, ys, middle: str = K.XXYY_MIDDLE, end: str = K.Y_END) -> str:
    return K.X_START + ";".join(map(_text, xs)) + middle + ";".join(map(_text, ys)) + end


def horizontal_model():
    """Stand-in series model: reads its series off the first row of the image."""
    return lambda px, prompt=None: px.map(lambda p: _label(p[:4], p[4:8]))


def scatter_line_model():
    """Stand-in series model of another dialect: tight middle, no end mark, one y too few."""
    return lambda px, prompt=None: px.map(lambda p: _label(p[8:12], p[12:15], K.XXYY_MIDDLE_TIGHT, ""))


def default_model():
    """Stand-in series model over 4 x 4 images; refuses dark ones."""
    def model(px, prompt=None):
        if any(len(p) != 16 for p in px):
            raise RuntimeError("not a 4 x 4 image")
        if any(p[0] < 40 for p in px):
            raise ValueError("dark image")
        return px.map(lambda p: _label(p[:3], p[3:7]))
    return model


SERIES_MODELS = {K.ROUTE_HORIZONTAL: horizontal_model, K.ROUTE_SCATTER_LINE: scatter_line_model, K.ROUTE_DEFAULT: default_model}
SERIES_INPUTS = {K.ROUTE_DEFAULT: lambda px: resize_plane(px, 8, 8, 4, 4)}


def xyxy_model():
    """Stand-in model for point rows: N/A, a third cell, a quoted cell and a missing y, by the first value."""
    def one(p):
        kind = int(p[0]) % 6
        first = "N/A" if kind == 1 else f'"{_text(p[0])}"' if kind == 2 else _text(p[0])
        last = _text(p[4]) + ("" if kind == 3 else f" | {_text(p[5])}") + (" | 9" if kind == 4 else "")
        return K.XYXY_NEWLINE.join([f"{first} | {_text(p[1])} ", f" {_text(p[2])} | {_text(p[3])} ", f" {last}"])
    return lambda px, prompt=None: px.map(one)


_TXT = "list_transform({v}, lambda v: CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END)"
_LABEL_SQL = "'<x_start>' || array_to_string(" + _TXT.format(v="{x}") + ", ';') || '{m}' || array_to_string(" + _TXT.format(v="{y}") + ", ';') || '{e}'"
_AT = "small[{i}]"
_CHAIN_BASE = f""",
listed AS (SELECT *, list_transform(px, lambda v: (v / 255.0 - 0.5) / 0.5) AS xn FROM chart_images WHERE contains(regexp_extract(image_path, '[^/]*$'), '.jpg')),
classed AS (SELECT image_id, image_path, px, {_NAMES_SQL}[list_position(lg, list_max(lg))] AS chart_type
            FROM (SELECT *, [{', '.join(_linear_logits_sql('xn', 64))}] AS lg FROM listed)),
prepared AS (SELECT *, {_ROUTE_SQL} AS route, list_transform(range(16), lambda i:
                 (px[(i // 4) * 16 + (i % 4) * 2 + 1] * 0.5::DOUBLE + px[(i // 4) * 16 + (i % 4) * 2 + 2] * 0.5::DOUBLE) * 0.5::DOUBLE
                 + (px[(i // 4) * 16 + (i % 4) * 2 + 9] * 0.5::DOUBLE + px[(i // 4) * 16 + (i % 4) * 2 + 10] * 0.5::DOUBLE) * 0.5::DOUBLE) AS small
             FROM classed),
predictions AS (SELECT image_id, image_path, chart_type, route,
    CASE route WHEN 'horizontal_bar' THEN {_LABEL_SQL.format(x='px[1:4]', y='px[5:8]', m=K.XXYY_MIDDLE, e=K.Y_END)}
               WHEN 'scatter_line' THEN {_LABEL_SQL.format(x='px[9:12]', y='px[13:15]', m=K.XXYY_MIDDLE_TIGHT, e='')}
               ELSE CASE WHEN small[1] >= 40 THEN {_LABEL_SQL.format(x='small[1:3]', y='small[4:7]', m=K.XXYY_MIDDLE, e=K.Y_END)} END END AS raw,
    CASE WHEN route = 'all' AND small[1] < 40 THEN 'ValueError: dark image' END AS failure
    FROM prepared)"""


@register("routed_union", sql=_with(["chart_images"], _CHAIN_BASE, """
SELECT image_path, route, chart_type, raw, failure AS error FROM predictions"""))
def q_routed_union(spark, sf_dir):
    """Three models with inputs of their own (only the default one's is resized), in one pass."""
    return I.routed_texts(fx.chart_images(spark, sf_dir), linear_scorer_factory(5, 64), SERIES_MODELS, SERIES_INPUTS) \
        .select("image_path", "route", "chart_type", "raw", "error")


@register("submission_xxyy", sql=_with(["chart_images"], _CHAIN_BASE + _DEC_XXYY, _MELT))
def q_submission_xxyy(spark, sf_dir):
    """Q2: listing -> class model -> route -> series models -> decode -> clean -> two rows an image."""
    texts = I.routed_texts(fx.chart_images(spark, sf_dir), linear_scorer_factory(5, 64), SERIES_MODELS, SERIES_INPUTS)
    return I.submission(I.cleaned_xxyy(texts))


_XYXY_SQL = f""",
predictions_xyxy AS (SELECT image_id, image_path, chart_type,
    CASE k WHEN 1 THEN 'N/A' WHEN 2 THEN '"' || t[1] || '"' ELSE t[1] END || ' | ' || t[2] || ' <0x0A> ' || t[3] || ' | ' || t[4] || ' <0x0A> '
    || t[5] || CASE WHEN k = 3 THEN '' ELSE ' | ' || t[6] END || CASE WHEN k = 4 THEN ' | 9' ELSE '' END AS raw
    FROM (SELECT *, CAST(px[1] AS BIGINT) % 6 AS k, {_TXT.format(v='px[1:6]')} AS t FROM classed))"""


@register("submission_xyxy", sql=_with(["chart_images"], _CHAIN_BASE.split(",\nprepared AS")[0] + _XYXY_SQL + _DEC_XYXY, _MELT))
def q_submission_xyxy(spark, sf_dir):
    """Q3: listing -> class model -> one series model -> decode the point rows -> clean -> two rows an image."""
    texts = I.routed_texts(fx.chart_images(spark, sf_dir), linear_scorer_factory(5, 64), {K.ROUTE_DEFAULT: xyxy_model}, route=lambda _: F.lit(K.ROUTE_DEFAULT))
    return I.submission(I.cleaned_xyxy(texts))
