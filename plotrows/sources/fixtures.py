"""Adapter from the driver tables to the domain tables (FIXTURES.md §1).

Each domain view exists twice, kept side by side so they cannot drift: a
Spark builder (``charts(spark, sf_dir)`` ...) and the equivalent DuckDB SQL in
``VIEW_SQL`` used by the oracle.  Everything is derived from the whole input
tables; ids only pick *how* a row is damaged, never whether it is kept.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotrows import constants as K
from plotrows.functions.numbers import let
from plotrows.functions.series import encode_xxyy, encode_xyxy
from plotrows.operators.series import attach_series

# this repository's stand-in: order priorities as chart classes
PRIORITY_TO_TYPE = {
    "1-URGENT": "line",
    "2-HIGH": "vertical_bar",
    "3-MEDIUM": "scatter",
    "4-NOT SPECIFIED": "dot",
    "5-LOW": "horizontal_bar",
}
WHITESPACE_RE = "[ \\t\\n\\r\\f\\x0B]+"
POINT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _type_case(col: str) -> F.Column:
    expr = None
    for prio, kind in PRIORITY_TO_TYPE.items():
        expr = (F.when(F.col(col) == prio, F.lit(kind)) if expr is None
                else expr.when(F.col(col) == prio, F.lit(kind)))
    # some charts have no class, some an empty one
    return F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 89 == 0, F.lit("")).otherwise(expr)


def _image_ext(key: str) -> F.Column:
    return F.when(F.col(key) % 13 == 0, F.lit(".png")).otherwise(F.lit(".jpg"))


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("image_id"),
        F.concat(F.lit("./train/images/"), F.col("o_orderkey").cast("string"), _image_ext("o_orderkey")).alias("image_path"),
        F.col("o_orderstatus").alias("source"),
        _type_case("o_orderpriority").alias("chart_type"),
    )


def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, n_points, gts): one grouping by chart; a point's position is its place in the sorted series."""
    li = table(spark, sf_dir, "lineitem")
    y = ((F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1) + F.col("l_tax")).cast("decimal(6,2)")
          * (F.lit(1) - F.col("l_discount")).cast("decimal(6,2)")).cast("decimal(28,6)").cast("string"))
    sort_key = [F.col(c) for c in POINT_ORDER]
    series = li.groupBy(F.col("l_orderkey").alias("image_id")).agg(
        F.sort_array(F.collect_list(F.struct(*sort_key, y.alias("y")))).alias("_points"))
    point = lambda p, i: F.struct((i + 1).cast("int").alias("pos"), p["l_linenumber"].cast("string").alias("x"), p["y"].alias("y"))
    return series.select("image_id", F.transform("_points", point).alias("gts"), F.size("_points").cast("long").alias("n_points"))


def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_series(spark, sf_dir).select("image_id", F.inline("gts"))


def charts_with_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """charts + ``gts`` (ordered series) + ``n_points``."""
    return attach_series(charts(spark, sf_dir), chart_series(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (charts_with_series(spark, sf_dir)
            .withColumn("label_xxyy", encode_xxyy("gts"))
            .withColumn("label_xyxy", encode_xyxy("gts")))


def extra_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names, flags and classes; labels are attached where a query selects them."""
    return charts(spark, sf_dir).select(
        F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"),
        F.when(F.col("image_id") % 10 == 0, 1).otherwise(0).alias("validation"),
        "chart_type",
    )


def damage_xxyy(label: F.Column, kind: F.Column) -> F.Column:
    """Model-output damage by kind 0..6 (FIXTURES.md §1)."""
    return (F.when(kind == 0, label)
            .when(kind == 1, F.replace(label, F.lit(K.XXYY_MIDDLE), F.lit(K.XXYY_MIDDLE_TIGHT)))
            .when(kind == 2, F.replace(label, F.lit(K.Y_END), F.lit("")))
            .when(kind == 3, F.replace(label, F.lit(K.X_START), F.lit("")))
            .when(kind == 4, F.regexp_replace(label, ";?[^;>]*<y_end>", "<y_end>"))
            .when(kind == 5, F.regexp_replace(label, "[^;>]*<y_end>", "nan<y_end>"))
            .otherwise(F.lit("")))


def damage_xyxy(label: F.Column, key: F.Column) -> F.Column:
    """xyxy damage: missing last y, N/A first x, a three-cell row, a thousands separator,
    blank rows, empty text; quoted separators, true/false words, a quote that is never closed."""
    kind, more = key % 7, key % 11
    return (F.when(more == 5, F.regexp_replace(label, "^([^|]*) \\| ", '"$1 | ""q"" <0x0A>r" | '))
            .when(more == 7, F.concat(F.lit("true | 1<0x0A>FALSE | 2<0x0A>True | "), F.regexp_replace(label, "^[^|]* \\| | <0x0A> .*$", "")))
            .when(more == 9, F.concat(F.lit('"'), label))
            .when(kind == 0, label)
            .when(kind == 1, F.regexp_replace(label, " \\| [^|]*$", ""))
            .when(kind == 2, F.regexp_replace(label, "^[^|]* \\| ", "N/A | "))
            .when(kind == 3, F.concat(label, F.lit(" | 9")))
            .when(kind == 4, F.regexp_replace(label, " \\| [^|]*$", " | 1,000"))
            .when(kind == 5, F.replace(label, F.lit(" <0x0A> "), F.lit(" <0x0A>  <0x0A> ")))
            .otherwise(F.lit("")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(
        "image_id", "image_path", "chart_type",
        damage_xxyy(F.col("label_xxyy"), F.col("image_id") % 7).alias("raw"))


def predictions_xyxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(
        "image_id", "image_path", "chart_type",
        damage_xyxy(F.col("label_xyxy"), F.col("image_id")).alias("raw"))


def chart_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing with decoded images: (image_path, px: 8 x 8 grey values from the series' hash)."""
    def pixels_of(h: F.Column) -> F.Column:
        code = lambda j: F.ascii(F.substr(h, j % 32 + 1, F.lit(1)))
        return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: (code(j) * (2 * j + 3) % 256).cast("double"))
    return labelled(spark, sf_dir).select("image_path", let(F.md5("label_xxyy"), pixels_of).alias("px"))


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 3).alias("run"),
        F.date_trunc("day", F.col("ts")).alias("epoch"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("metric"),
        F.col("value").cast("double").alias("value"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.aggregate(
            F.filter(F.col("embedding").cast("array<double>"), lambda v, i: i % 5 == c), F.lit(0.0),
            lambda acc, v: acc + v)).alias("logits"),
        (F.col("label") % 5).cast("int").alias("label"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("px"),
                    F.col("label").cast("int").alias("raw_label"))


def png(scanlines: F.Column, width: int, height: int) -> F.Column:
    """An RGB image file from its bytes (a filter byte before each row), in one stored block of up to 65,535 bytes."""
    size = height * (1 + 3 * width)
    number = lambda v, digits: F.lpad(F.hex(v), digits, "0")
    little = lambda v: f"{v & 255:02X}{v >> 8:02X}"

    def chunk(tag: str, data: F.Column) -> F.Column:
        body = F.concat(F.lit(tag.encode().hex().upper()), data)
        return F.concat(number((F.length(body) / 2 - 4).cast("long"), 8), body, number(F.crc32(F.unhex(body)), 8))

    sums = F.aggregate(scanlines, F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")), lambda s, v: F.struct(
        ((s["a"] + v) % 65521).alias("a"), ((s["b"] + s["a"] + v) % 65521).alias("b")), lambda s: s["b"].cast("long") * 65536 + s["a"])
    data = F.array_join(F.transform(scanlines, lambda v: number(v, 2)), "")
    block = F.concat(F.lit("780101" + little(size) + little(65535 - size)), data, number(sums, 8))
    header = F.lit(f"{width:08X}{height:08X}0802000000")
    return F.unhex(F.concat(F.lit("89504E470D0A1A0A"), chunk("IHDR", header), chunk("IDAT", block), chunk("IEND", F.lit(""))))


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): an 8 x 8 RGB image file for each row of ``pixels``."""
    def scanlines(g: F.Column) -> F.Column:
        pixel = lambda v: F.array(v, 255 - v, v * 7 % 256)
        row = lambda y: F.concat(F.array(F.lit(0)), F.flatten(F.transform(F.slice(g, y * 8 + 1, F.lit(8)), pixel)))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), row))

    grey = F.transform("px", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.rint((v + 1) * 127.5).cast("int"))))
    return pixels(spark, sf_dir).select("id", grey.alias("g")).select(
        F.concat(F.col("id").cast("string"), F.lit(".png")).alias("name"), png(scanlines(F.col("g")), 8, 8).alias("content"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"),
                    F.array_remove(F.split("text", WHITESPACE_RE, -1), "").alias("ids"))


# ---------------------------------------------------------------- DuckDB ----

_TYPE_CASE_SQL = "CASE o_orderpriority " + " ".join(
    f"WHEN '{p}' THEN '{t}'" for p, t in PRIORITY_TO_TYPE.items()) + " END"
_TYPE_CASE_SQL = f"CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN '' ELSE {_TYPE_CASE_SQL} END"

VIEW_SQL: dict[str, tuple[list[str], str]] = {
    "charts": ([], f"""
        SELECT o_orderkey AS image_id,
               './train/images/' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 13 = 0 THEN '.png' ELSE '.jpg' END AS image_path,
               o_orderstatus AS source,
               {_TYPE_CASE_SQL} AS chart_type
        FROM orders"""),
    "chart_points": ([], f"""
        SELECT l_orderkey AS image_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(POINT_ORDER)}) AS INTEGER) AS pos,
               CAST(l_linenumber AS VARCHAR) AS x,
               CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 + l_tax AS DECIMAL(6,2))
                    * CAST(1 - l_discount AS DECIMAL(6,2)) AS DECIMAL(28,6)) AS VARCHAR) AS y
        FROM lineitem"""),
    "chart_series": (["chart_points"], """
        SELECT image_id,
               string_agg(x, ';' ORDER BY pos) AS xs_text,
               string_agg(y, ';' ORDER BY pos) AS ys_text,
               string_agg(x || ' | ' || y, ' <0x0A> ' ORDER BY pos) AS xyxy_text,
               count(*) AS n_points
        FROM chart_points GROUP BY image_id"""),
    "labelled": (["charts", "chart_series"], """
        SELECT c.*, coalesce(s.n_points, 0) AS n_points,
               coalesce(s.xs_text, '') AS xs_text, coalesce(s.ys_text, '') AS ys_text,
               '<x_start>' || coalesce(s.xs_text, '') || '<x_end> <y_start>' || coalesce(s.ys_text, '') || '<y_end>' AS label_xxyy,
               coalesce(s.xyxy_text, '') AS label_xyxy
        FROM charts c LEFT JOIN chart_series s USING (image_id)"""),
    "extra_metadata": (["charts"], """
        SELECT CAST(image_id AS VARCHAR) || '.jpg' AS file_name,
               CASE WHEN image_id % 10 = 0 THEN 1 ELSE 0 END AS validation,
               chart_type
        FROM charts"""),
    "predictions": (["labelled"], """
        SELECT image_id, image_path, chart_type,
               CASE image_id % 7
                 WHEN 0 THEN label_xxyy
                 WHEN 1 THEN replace(label_xxyy, '<x_end> <y_start>', '<x_end><y_start>')
                 WHEN 2 THEN replace(label_xxyy, '<y_end>', '')
                 WHEN 3 THEN replace(label_xxyy, '<x_start>', '')
                 WHEN 4 THEN regexp_replace(label_xxyy, ';?[^;>]*<y_end>', '<y_end>')
                 WHEN 5 THEN regexp_replace(label_xxyy, '[^;>]*<y_end>', 'nan<y_end>')
                 ELSE '' END AS raw
        FROM labelled"""),
    "predictions_xyxy": (["labelled"], """
        SELECT image_id, image_path, chart_type,
               CASE image_id % 11 WHEN 5 THEN regexp_replace(label_xyxy, '^([^|]*) \\| ', '"\\1 | ""q"" <0x0A>r" | ')
                 WHEN 7 THEN 'true | 1<0x0A>FALSE | 2<0x0A>True | ' || regexp_replace(label_xyxy, '^[^|]* \\| | <0x0A> .*$', '', 'g')
                 WHEN 9 THEN '"' || label_xyxy ELSE
               CASE image_id % 7
                 WHEN 0 THEN label_xyxy
                 WHEN 1 THEN regexp_replace(label_xyxy, ' \\| [^|]*$', '')
                 WHEN 2 THEN regexp_replace(label_xyxy, '^[^|]* \\| ', 'N/A | ')
                 WHEN 3 THEN label_xyxy || ' | 9'
                 WHEN 4 THEN regexp_replace(label_xyxy, ' \\| [^|]*$', ' | 1,000')
                 WHEN 5 THEN replace(label_xyxy, ' <0x0A> ', ' <0x0A>  <0x0A> ')
                 ELSE '' END END AS raw
        FROM labelled"""),
    "chart_images": (["labelled"], """
        SELECT image_id, image_path,
               list_transform(range(64), lambda j: CAST((ascii(substr(md5(label_xxyy), CAST(j % 32 + 1 AS INTEGER), 1)) * (2 * j + 3)) % 256 AS DOUBLE)) AS px
        FROM labelled"""),
    "metric_log": ([], """
        SELECT user_id % 3 AS run, date_trunc('day', ts) AS epoch, event_id AS step,
               event_type AS metric, CAST(value AS DOUBLE) AS value
        FROM events"""),
    "scores": ([], """
        SELECT vec_id AS id, [list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda v, i: (i - 1) % 5 = c)) for c in range(5)] AS logits,
               CAST(label % 5 AS INTEGER) AS label
        FROM embeddings"""),
    "pixels": ([], """
        SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS px, CAST(label AS INTEGER) AS raw_label
        FROM embeddings"""),
    "tokens": ([], """
        SELECT doc_id AS id,
               list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda t: t <> '') AS ids
        FROM documents"""),
}


def with_views(names: list[str], body: str) -> str:
    """``WITH`` clause holding ``names`` (and what they need) in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEW_SQL[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n][1]})" for n in order)
    return f"WITH {ctes}\n{body}"
