"""T1-T4 image maths.

Decoding is Spark's built-in ``image`` source (executors, BGR bytes).  Channel reorder,
bilinear resize, scaling and HWC -> CHW are array expressions over the decoded bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotrows.functions.numbers import let


def byte_values(data) -> Column:
    """The bytes of a BINARY column as an array of 0..255, without leaving the JVM."""
    text = F.decode(F.col(data) if isinstance(data, str) else data, "ISO-8859-1")  # one character for each byte
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), F.ascii)).otherwise(F.array().cast("array<int>"))


def resize_taps(n_in: Column, n_out: int) -> Column:
    """Bilinear weights of one axis: per output place the two inputs and the share of the second.

    Half-pixel centres, clamped at the edges; the two axes are independent, so an image
    needs ``height + width`` of them, not one for each output value.
    """
    def tap(o: Column) -> Column:
        place = F.greatest(F.lit(0.0), F.least((n_in - 1).cast("double"), (o + 0.5) * (n_in / F.lit(float(n_out))) - 0.5))
        return let(place, lambda p: F.struct(F.floor(p).cast("int").alias("a"), F.least(F.floor(p) + 1, n_in - 1).cast("int").alias("b"), (p - F.floor(p)).alias("w")))
    return F.transform(F.sequence(F.lit(0), F.lit(n_out - 1)), tap)


def resize_plane(values: Column, height: int, width: int, out_h: int, out_w: int) -> Column:
    """T2 over one plane of values in row order."""
    def plane(parts: Column) -> Column:
        at = lambda i, j: F.get(parts["v"], i * width + j)
        value = lambda y, x: ((at(y["a"], x["a"]) * (1 - x["w"]) + at(y["a"], x["b"]) * x["w"]) * (1 - y["w"])
                              + (at(y["b"], x["a"]) * (1 - x["w"]) + at(y["b"], x["b"]) * x["w"]) * y["w"])
        return F.flatten(F.transform(parts["ys"], lambda y: F.transform(parts["xs"], lambda x: value(y, x))))
    return let(F.struct(values.alias("v"), resize_taps(F.lit(height), out_h).alias("ys"), resize_taps(F.lit(width), out_w).alias("xs")), plane)


def image_prep(df: DataFrame, out_h: int, out_w: int, mean: float = 0.5, std: float = 0.5,
               out: str = "tensor", to_rgb: bool = True) -> DataFrame:
    """Add ``out``, the CHW values of each decoded image row (path, height, width, channels, data).

    BGR bytes (any number of channels; the first three are reversed) -> RGB -> bilinear
    resize -> ``(v / 255 - mean) / std`` -> channel, row, column order.  All of it is
    array expressions.  A caller's own resize goes through ``transform_rows``.
    """
    height, width, channels = (F.col(c) for c in ("height", "width", "channels"))

    def tensor(parts: Column) -> Column:
        v, ys, xs = parts["v"], parts["ys"], parts["xs"]

        def value(c: Column, y: Column, x: Column) -> Column:
            own = F.when((channels >= 3) & (c < 3), 2 - c).otherwise(c) if to_rgb else c
            at = lambda i, j: F.get(v, (i * width + j) * channels + own)
            top = at(y["a"], x["a"]) * (1 - x["w"]) + at(y["a"], x["b"]) * x["w"]
            low = at(y["b"], x["a"]) * (1 - x["w"]) + at(y["b"], x["b"]) * x["w"]
            return ((top * (1 - y["w"]) + low * y["w"]) / 255.0 - mean) / std

        plane = lambda c: F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: value(c, y, x))))
        return F.flatten(F.transform(F.sequence(F.lit(0), channels - 1), plane))

    parts = F.struct(byte_values("data").alias("v"), resize_taps(height, out_h).alias("ys"), resize_taps(width, out_w).alias("xs"))
    return df.withColumn(out, let(parts, tensor))
