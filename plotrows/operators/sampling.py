"""Reproducible shuffles, head, shuffle-then-limit, mini-batches.

Shuffles are orders by a seeded hash (``hash_order_key``), never ``rand()``:
the same rows come out in the same order on re-runs, under a different
partition count, and after a lost executor recomputes a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotrows.operators.ordering import hash_order_key, ordered_scan

def shuffle(df: DataFrame, key_cols: Sequence[str], seed: int = 42, rank_col: str = "shuffle_rank") -> DataFrame:
    """L1: every row with its 0-based position in the seeded shuffle order."""
    order = [hash_order_key(key_cols, seed), *[F.col(k) for k in key_cols]]
    return ordered_scan(df, order_by=order, rank_col=rank_col)


def head_n(df: DataFrame, order_by: Sequence, n: int, rank_col: str = "rank") -> DataFrame:
    """L2: the first few rows in order, with their 0-based rank -- a display of tiny ``n``.

    A per-partition top-k; for a result of any size take ``first_n``.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    top = df.orderBy(*cols).limit(n)
    return top.withColumn(rank_col, (F.row_number().over(Window.orderBy(*cols)) - 1).cast("long"))


def first_n(df: DataFrame, order_by: Sequence, n: int, rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows in order, with their 0-based rank, for any ``n``: a filter on the distributed position."""
    ranked = ordered_scan(df, order_by=list(order_by), rank_col=rank_col)
    return ranked.filter(F.col(rank_col) < n)


def shuffle_limit(df: DataFrame, key_cols: Sequence[str], n: int, seed: int = 42,
                  rank_col: str = "shuffle_rank") -> DataFrame:
    """L3: ``sample(frac=1)`` then the first ``n`` rows, reproducibly."""
    order = [hash_order_key(key_cols, seed), *[F.col(k) for k in key_cols]]
    return first_n(df, order, n, rank_col)


def batch_assign(df: DataFrame, order_by: Sequence, batch_size: int, pos_col: str = "pos",
                 batch_col: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``batch_size`` rows in order (the last one may be short)."""
    ranked = ordered_scan(df, order_by=list(order_by), rank_col=pos_col)
    return ranked.withColumn(batch_col, F.floor(F.col(pos_col) / batch_size).cast("long"))
