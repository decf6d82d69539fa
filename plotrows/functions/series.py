"""Series label grammars: encode, decode and clean as native column functions.

A series is ``ARRAY<STRUCT<pos:INT, x:STRING, y:STRING>>`` in order.  Two

* xxyy: ``<x_start>x1;x2<x_end> <y_start>y1;y2<y_end>``
* xyxy: ``x1 | y1 <0x0A> x2 | y2``

Everything here is built from higher-order functions, ``split``/``get`` and
regular expressions so it runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotrows import constants as K
from plotrows.functions.numbers import let, py_float, py_round, py_str, py_strip

SERIES_TYPE = "array<struct<pos:int,x:string,y:string>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _values(series, field: str) -> Column:
    """``[str(p[field]) for p in series]``; JSON null prints as ``None``."""
    return F.transform(_col(series), lambda p: F.coalesce(p[field], F.lit("None")))


def _join(arr: Column, sep: str) -> Column:
    return F.coalesce(F.array_join(arr, sep), F.lit(""))


# ---------------------------------------------------------------- encoders ---

def encode_xxyy_values(xs: Column, ys: Column) -> Column:
    return F.concat(F.lit(K.X_START), _join(xs, K.XXYY_VALUE_SEP), F.lit(K.XXYY_MIDDLE),
                    _join(ys, K.XXYY_VALUE_SEP), F.lit(K.Y_END))


def encode_xyxy_values(xs: Column, ys: Column) -> Column:
    pairs = F.arrays_zip(xs.alias("x"), ys.alias("y"))
    rows = F.transform(pairs, lambda p: F.concat(p["x"], F.lit(K.XYXY_CELL_SEP), p["y"]))
    return _join(rows, K.XYXY_ROW_SEP)


def encode_xxyy(series) -> Column:
    """Raw xxyy label."""
    return encode_xxyy_values(_values(series, "x"), _values(series, "y"))


def encode_xyxy(series) -> Column:
    """Raw xyxy label."""
    return encode_xyxy_values(_values(series, "x"), _values(series, "y"))


def round_value_text(v: Column, digits: int = 4) -> Column:
    """``str(round(float(v), digits))`` when ``v`` parses as a float, else ``v``."""
    return let(py_float(v), lambda f: F.when(f.isNotNull(), py_str(py_round(f, digits))).otherwise(v))


def digit_round_value_text(v: Column) -> Column:
    """Only text containing one '.'; integer part longer than 2 chars -> 2 dp, else 4 dp."""
    def body(f: Column) -> Column:
        one_dot = (F.size(F.split(v, "\\.")) == 2)
        int_part = F.substring_index(v, ".", 1)
        rounded = F.when(F.length(int_part) > 2, py_str(py_round(f, 2))).otherwise(py_str(py_round(f, 4)))
        return F.when(f.isNotNull() & one_dot, rounded).otherwise(v)
    return let(py_float(v), body)


def _rounded(values: Column, fold, digits: int, digit_aware: bool) -> Column:
    one = digit_round_value_text if digit_aware else (lambda v: round_value_text(v, digits))
    return F.when(_col(fold) == 0, values).otherwise(F.transform(values, one))


def encode_xxyy_rounded(series, fold, digits: int = 4, digit_aware: bool = False) -> Column:
    """E2 (and E4b with ``digit_aware``): fold 0 keeps raw values, other folds round."""
    xs = _rounded(_values(series, "x"), fold, digits, digit_aware)
    ys = _rounded(_values(series, "y"), fold, digits, digit_aware)
    return encode_xxyy_values(xs, ys)


def encode_xyxy_rounded(series, fold, digits: int = 4, digit_aware: bool = False) -> Column:
    """Xyxy with the same rounding rule."""
    xs = _rounded(_values(series, "x"), fold, digits, digit_aware)
    ys = _rounded(_values(series, "y"), fold, digits, digit_aware)
    return encode_xyxy_values(xs, ys)


def encode_bos(chart_type, body: Column) -> Column:
    """``<|BOS|><type>`` + label body."""
    return F.concat(F.lit(K.BOS_TOKEN), F.lit("<"), _col(chart_type), F.lit(">"), body)


def encode_label(series, chart_type, fold, label_type: str, compat: bool = False) -> Column:
    """P10: the label column for one of the four label formats.

    ``bos_xxyy`` uses the rounded xxyy encoder (folds other than 0 round); ``compat=True`` keeps the original
    quirk (D1) of the xyxy encoder there.  ``bos_xyxy`` is the unrounded xyxy
    text, the value the original finally keeps (D2).
    """
    if label_type == "xxyy":
        return encode_xxyy(series)
    if label_type == "xyxy":
        return encode_xyxy(series)
    if label_type == "bos_xxyy":
        body = encode_xyxy_rounded(series, fold) if compat else encode_xxyy_rounded(series, fold)
        return encode_bos(chart_type, body)
    if label_type == "bos_xyxy":
        return encode_bos(chart_type, encode_xyxy(series))
    raise ValueError(f"unknown label type {label_type!r}")


# ---------------------------------------------------------------- decoders ---

def decode_xxyy(raw) -> Column:
    """E5: ``STRUCT<xs: ARRAY<STRING>, ys: ARRAY<STRING>>``, NULL where the original raises.

    The middle separator is ``<x_end><y_start>`` when present anywhere, else
    ``<x_end> <y_start>``; a missing ``<y_end>`` is accepted.
    """
    r = _col(raw)
    parts = F.when(r.contains(K.XXYY_MIDDLE_TIGHT), F.split(r, K.XXYY_MIDDLE_TIGHT, -1)) \
        .otherwise(F.split(r, K.XXYY_MIDDLE, -1))

    def body(sides: Column) -> Column:
        x_side, y_side = F.get(sides, 0), F.get(sides, 1)
        ok = x_side.isNotNull() & y_side.isNotNull()
        return F.when(ok, F.struct(F.split(x_side, K.XXYY_VALUE_SEP, -1).alias("xs"),
                                   F.split(y_side, K.XXYY_VALUE_SEP, -1).alias("ys")))

    return let(parts, lambda p: body(F.array(F.get(F.split(F.get(p, 0), K.X_START, -1), 1),
                                             F.get(F.split(F.get(p, 1), K.Y_END, -1), 0))))


def with_decode_fallback(decoded: Column) -> Column:
    """E7 (xxyy): a failed decode becomes ``xs = ys = ['0']``."""
    zero = F.array(*[F.lit(v) for v in K.FAILED_SERIES])
    return F.struct(F.coalesce(decoded["xs"], zero).alias("xs"),
                    F.coalesce(decoded["ys"], zero).alias("ys"))


def clean_y_xxyy(v: Column) -> Column:
    """E8 y rule: float -> Python float text, NaN/inf -> 0; not a float: empty -> 0, else kept."""
    return let(py_float(v), lambda f: (
        F.when(f.isNotNull(),
               F.when(F.isnan(f) | (F.abs(f) == float("inf")), F.lit("0")).otherwise(py_str(f)))
        .when(F.length(v) == 0, F.lit("0"))
        .otherwise(v)))


def clean_x_xxyy(v: Column) -> Column:
    """E8 x rule: empty -> 0, else kept."""
    return F.when(F.length(v) == 0, F.lit("0")).otherwise(v)


def truncate_join(values: Column, n: Column) -> Column:
    """L4 + E10: first ``n`` values, each stripped, joined by ';'."""
    return _join(F.transform(F.slice(values, 1, n), py_strip), K.XXYY_VALUE_SEP)


def shorter_length(xs: Column, ys: Column) -> Column:
    return F.least(F.size(xs), F.size(ys))


# ---------------------------------------------------------------- xyxy -------

_NA_WORDS = [w for w in K.PANDAS_NA_WORDS]
# pandas' parser: integers and decimals may carry surrounding spaces; the
# missing-value words and inf/infinity only match exactly.
_INT_RE = "^ *[+-]?[0-9]+ *$"
_NUM_RE = "^( *[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)? *|[+-]?(?i:inf|infinity))$"


_BOOL_RE = "^(True|TRUE|true|False|FALSE|false)$"


def _type_column(cells: Column) -> Column:
    """pandas-style per-record column typing of raw cells (NULL = missing).

    all present and integer -> integer text, if all fit in 64 signed or all in 64
    unsigned bits, else the raw text; all present-or-missing numeric -> Python float
    text with missing as 'nan'; all present-or-missing true/false words -> True/False;
    otherwise the raw text with missing as 'nan'.
    """
    def body(cs: Column) -> Column:
        n_null = F.size(F.filter(cs, lambda c: c.isNull()))
        n_int = F.size(F.filter(cs, lambda c: c.rlike(_INT_RE)))
        n_num = F.size(F.filter(cs, lambda c: c.rlike(_NUM_RE)))
        n_bool = F.size(F.filter(cs, lambda c: c.rlike(_BOOL_RE)))
        n = F.size(cs)
        bare = lambda c: F.regexp_replace(c, "^ +| +$", "")
        whole = F.transform(cs, lambda c: bare(c).try_cast("decimal(38,0)"))
        low, high = F.array_min(whole), F.array_max(whole)
        fits = ~F.exists(whole, lambda d: d.isNull()) & (
            ((low >= F.lit(-(1 << 63)).cast("decimal(38,0)")) & (high < F.lit(1 << 62).cast("decimal(38,0)") * 2))
            | ((low >= 0) & (high < F.lit(1 << 62).cast("decimal(38,0)") * 4)))
        as_int = F.transform(whole, lambda d: d.cast("string"))
        as_float = F.transform(cs, lambda c: F.coalesce(py_str(bare(c).cast("double")), F.lit("nan")))
        as_bool = F.transform(cs, lambda c: F.coalesce(F.initcap(c), F.lit("nan")))
        as_text = F.transform(cs, lambda c: F.coalesce(c, F.lit("nan")))
        return (F.when((n_null == 0) & (n_int == n) & fits, as_int)
                .when((n_null == 0) & (n_int == n), as_text)
                .when(n_num + n_null == n, as_float)
                .when(n_bool + n_null == n, as_bool)
                .otherwise(as_text))
    return let(cells, body)


def _inexact(cells: Column) -> Column:
    """Does a numeric column that is no integer column hold a value that pandas may print otherwise?

    Values of 16 significant digits or more, or with exponents of three digits: its fast
    parser may miss the nearest float by a bit, and beside missing cells it keeps integers
    beyond 64 bits as text.
    """
    digits = lambda c: F.length(F.regexp_replace(F.regexp_replace(c, "[eE].*$|[^0-9eE]", ""), "^0+", ""))
    return ~F.exists(cells, lambda c: c.isNotNull() & ~c.rlike(_NUM_RE)) & F.exists(cells, lambda c: c.isNull() | ~c.rlike(_INT_RE)) \
        & F.exists(cells, lambda c: (digits(c) > 15) | c.rlike("[eE][+-]?[0-9]{3}"))


# pandas' tokenizer on tab-separated text: a cell that begins with a quote runs to the closing
# quote, doubled quotes inside it are one, and what follows the closing quote is literal
_QUOTED = '"([^"]*+(?:""[^"]*+)*+)"'
_CELL_RE = f"(?:{_QUOTED}[^\\t\\r\\n]*|[^\\t\\r\\n\"][^\\t\\r\\n]*|)(?:\\t|\\r\\n|\\n|\\r)"
_CELL_END, _ROW_END = "\x01", "\x02"


def xyxy_rows(text) -> Column:
    """The cells of every row, quotes removed; NULL where a quoted cell is never closed.

    The text is cut into cells with their terminators by one regular expression, whose
    matches must cover all of it; the terminators that are not inside quotes then become
    marks to split at.  Rows of nothing or spaces alone are skipped.  A text that holds the
    marks themselves (control characters 1 and 2) is NULL, too.
    """
    raw = _col(text)
    whole = F.concat(F.replace(F.replace(raw, F.lit(K.XYXY_NEWLINE), F.lit("\n")), F.lit(K.XYXY_CELL_SEP), F.lit("\t")), F.lit("\n"))

    def marked(token: Column) -> Column:
        return (F.when(token.endswith("\t"), F.concat(F.substr(token, F.lit(1), F.length(token) - 1), F.lit(_CELL_END)))
                .otherwise(F.regexp_replace(token, "(\r\n|\n|\r)\\z", _ROW_END)))

    def plain(cell: Column) -> Column:
        parts = f"(?s)^{_QUOTED}(.*)$"
        unquoted = F.concat(F.replace(F.regexp_extract(cell, parts, 1), F.lit('""'), F.lit('"')), F.regexp_extract(cell, parts, 2))
        return F.when(cell.startswith('"'), unquoted).otherwise(cell)

    def body(pair: Column) -> Column:
        t, tokens = pair["t"], pair["k"]
        covered = F.aggregate(tokens, F.lit(0), lambda n, k: n + F.length(k)) == F.length(t)
        lines = F.split(F.array_join(F.transform(tokens, marked), ""), _ROW_END, -1)
        rows = F.filter(F.slice(lines, 1, F.size(lines) - 1), lambda r: ~r.rlike("^ *$"))
        return F.when(covered & ~t.rlike("[\x01\x02]"), F.transform(rows, lambda r: F.transform(F.split(r, _CELL_END, -1), plain)))

    return let(whole, lambda t: let(F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(_CELL_RE), F.lit(0)).alias("k")), body))


def decode_xyxy(text) -> Column:
    """``STRUCT<xs, ys, inexact>`` or NULL where the original raises.

    Cells as in ``xyxy_rows``.  The first row fixes the width w (at least 2): the last two of
    w cells are x and y, earlier ones the index; a later row wider than w is a parse
    error, a narrower one leaves y (then x) missing.  ``inexact`` marks records whose numbers
    pandas may print otherwise (``_inexact``): they are those of ``float()``.
    """
    def norm(c: Column) -> Column:
        return F.when(c.isNull() | c.isin(*_NA_WORDS), F.lit(None).cast("string")).otherwise(c)

    def body(cells: Column) -> Column:
        # the first row fixes the width: extra leading cells become the index
        width = F.greatest(F.coalesce(F.size(F.get(cells, 0)), F.lit(2)), F.lit(2))
        bad = F.exists(cells, lambda c: F.size(c) > width)
        xs = F.transform(cells, lambda c: norm(F.get(c, width - 2)))
        ys = F.transform(cells, lambda c: norm(F.get(c, width - 1)))
        typed = let(F.struct(xs.alias("x"), ys.alias("y")), lambda p: F.struct(
            _type_column(p["x"]).alias("xs"), _type_column(p["y"]).alias("ys"), F.coalesce(_inexact(p["x"]) | _inexact(p["y"]), F.lit(False)).alias("inexact")))
        return F.when(cells.isNotNull() & ~bad, typed)

    return let(xyxy_rows(text), body)


def clean_xyxy_value(v: Column) -> Column:
    """A value that is not a float, or is NaN, becomes 0 (inf is kept)."""
    return let(py_float(v), lambda f: F.when(f.isNull() | F.isnan(f), F.lit("0")).otherwise(v))
