"""Python-compatible number parsing and printing as native Spark expressions.

The scripts normalise every value with ``str(v)`` and ``float(s)``.  Spark's
casts differ on both sides (``'1.5d'`` parses, ``1.2345678E7`` prints), so
these functions restate Python's rules with built-in expressions that stay
inside whole-stage codegen.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes (str.isspace over Latin-1 and the
# Unicode space separators).
_PY_SPACE = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
_STRIP_RE = f"^{_PY_SPACE}+|{_PY_SPACE}+$"
_DECIMAL_RE = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INF_RE = "^[+-]?(inf|infinity)$"
_NAN_RE = "^[+-]?nan$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: removes all leading/trailing whitespace (Spark's trim only removes spaces)."""
    return F.regexp_replace(_col(c), _STRIP_RE, "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element ``transform``).

    Inside higher-order-function lambdas Spark evaluates expressions without
    common-subexpression elimination, so a sub-tree used five times runs five
    times; binding it here runs it once.
    """
    return F.get(F.transform(F.array(value), body), 0)


def py_float(c) -> Column:
    """``float(s)`` or NULL where Python would raise.

    Accepts surrounding whitespace, single underscores between digits,
    ``nan``/``inf``/``infinity`` in any case with a sign; rejects Java-only
    forms such as ``1.5d``, ``0x10`` and ``1,000``.
    """
    def parse(t: Column) -> Column:
        low = F.lower(t)
        return (
            F.when(t.rlike(_DECIMAL_RE), t.cast("double"))
            .when(low.rlike(_NAN_RE), F.lit(float("nan")))
            .when(low.rlike(_INF_RE),
                  F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        )
    return let(F.regexp_replace(py_strip(c), "(?<=[0-9])_(?=[0-9])", ""), parse)


def py_str(c) -> Column:
    """``str(float)`` (Python ``repr``) of a DOUBLE column, natively.

    Where the exponent form applies, the fewest of 15, 16 or 17 digits that read
    back as the same number are taken: the platform's own text can have more.  (Only
    subnormal numbers, below 2.3e-308, may show more digits than Python's.)
    """
    def shortest_whole(d: Column) -> Column:
        """Digits of a whole number of 17 to 19 digits, rounded from its exact value."""
        exact = F.abs(d).cast("long").cast("decimal(38,0)")
        n = F.length(exact.cast("string"))

        def kept(digits: int) -> Column:
            out = exact
            for size in (17, 18, 19):
                out = F.when(n == size, F.bround(exact, digits - size).cast("decimal(38,0)")).otherwise(out)
            return out
        text = F.coalesce(*[F.when(kept(k).cast("double") == F.abs(d), kept(k)) for k in (15, 16)], kept(17)).cast("string")
        mant = F.regexp_replace(F.regexp_replace(text, "^(.)", "$1."), "\\.?0*$", "")
        return F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), mant, F.lit("e+"), (F.length(text) - 1).cast("string"))

    def fmt(d: Column) -> Column:
        a = F.abs(d)
        java = d.cast("string")
        # plain positional text between 1e-4 and 1e16 via DECIMAL, trailing zeros cut
        dec = d.cast("decimal(38,20)").cast("string")
        dec = F.regexp_replace(F.regexp_replace(dec, "0+$", ""), "\\.$", ".0")
        # exponent form: 1.5E-7 -> 1.5e-07, 1.0E16 -> 1e+16
        tries = [F.format_string(f"%.{p - 1}e", d) for p in (15, 16)]
        best = F.coalesce(*[F.when(t.cast("double") == d, t) for t in tries], F.format_string("%.16e", d))
        mant = F.regexp_replace(F.regexp_replace(F.substring_index(best, "e", 1), "0+$", ""), "\\.$", "")
        exp = F.substring_index(best, "e", -1).cast("int")
        exp_txt = F.concat(F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
                           F.when(F.abs(exp) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(exp).cast("string"))
        sci = F.concat(mant, F.lit("e"), exp_txt)
        return (
            F.when(d.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(d), F.lit("nan"))
            .when(d == float("inf"), F.lit("inf"))
            .when(d == float("-inf"), F.lit("-inf"))
            .when(d == 0, java)
            .when((a >= 1e-3) & (a < 1e7), java)
            .when((a >= 1e-4) & (a < 1e16), dec)
            .when((a >= 1e16) & (a < 9.2233720368547e18), shortest_whole(d))
            .otherwise(sci)
        )
    return let(_col(c).cast("double"), fmt)


def fixed_text(c, digits: int) -> Column:
    """``f"{v:.nf}"``: half-even on the exact binary value, as Python rounds.

    Digits beyond a double's precision (from about 1e11 at n = 4) are zeros.
    """
    d = _col(c).cast("double")
    text = F.replace(F.format_number(d, digits), F.lit(","), F.lit(""))
    # the formatter takes the number next to half a unit for a tie; the nearest double lies above or below it
    half = 0.5 * 10.0 ** -digits
    up = Fraction(half) > Fraction(1, 2 * 10 ** digits)
    unit = f"{10.0 ** -digits:.{digits}f}"
    return (F.when(d == half, F.lit(unit if up else f"{0:.{digits}f}"))
            .when(d == -half, F.lit(f"-{unit}" if up else f"{-0.0:.{digits}f}")).otherwise(text))


def py_round(c, digits: int) -> Column:
    """``round(x, n)`` with Python's rule, correctly rounded from the exact binary value.

    NaN and infinities pass through.
    """
    d = _col(c).cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), d).otherwise(fixed_text(d, digits).cast("double"))


def argmax(arr) -> Column:
    """0-based index of the first maximum (``np.argmax``); NaN counts as largest."""
    a = _col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(arr) -> Column:
    """Max-subtracted softmax of an ARRAY<DOUBLE>."""
    a = _col(arr).cast("array<double>")
    m = F.array_max(a)
    e = F.transform(a, lambda v: F.exp(v - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / total)
