"""Column functions: every function takes and returns ``pyspark.sql.Column``."""

from plotrows.functions.numbers import (  # noqa: F401
    argmax, py_float, py_round, fixed_text, py_str, py_strip, softmax,
)
