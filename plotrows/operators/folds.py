"""Stratified k-fold assignment, F6: positional split.

Ordered variant (W1): classes are ranked by first appearance in the row
order; class ``c`` with ``n_c`` rows starting at offset ``s_c`` of the
class-sorted list gets ``a(c, i) = n_c div k + [((i - s_c) mod k) < n_c mod k]``
rows in fold ``i``; its rows, in order, fill fold 0, then fold 1, ... .  This is
the round-robin allocation of the usual stratified k-fold splitter.

Shuffled variant (W2): the same fold sizes, with rows ranked inside their
class by a seeded hash instead of the stored order (reproducible, not the
splitter's own RNG stream).

Plan: one skew-safe ordered scan for the in-class rank, one small aggregate
for class sizes, and a NULL-safe join with the classes' fold ends (one row per
class; AQE broadcasts it while it is small).  NULL and '' are two classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotrows.operators.ordering import hash_order_key, ordered_scan


def fold_bounds(class_stats: DataFrame, class_col: str, k: int) -> DataFrame:
    """(class, ends): the row counts up to each fold's end, from (class, n, first) -- ``first`` orders classes."""
    w = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    stats = class_stats.withColumn("_s", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    size = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (
        F.floor(F.col("_n") / k) + F.when(F.pmod(i - F.col("_s"), F.lit(k)) < F.pmod(F.col("_n"), F.lit(k)), 1).otherwise(0)))
    ends = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.aggregate(
        F.slice("_sizes", F.lit(1), i), F.lit(0).cast("long"), lambda acc, v: acc + v))
    return stats.withColumn("_sizes", size).select(F.col(class_col).alias("_bcls"), ends.alias("_ends"))


def stratified_kfold(df: DataFrame, class_col: str, order_by: Sequence[str], k: int = 10,
                     shuffle: bool = False, seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """Add ``fold_col`` (0..k-1).  ``order_by`` is the explicit row order."""
    order = list(order_by)
    # one order column keeps this a hash aggregate; a struct minimum needs a sort aggregate
    first = F.min(order[0]) if len(order) == 1 else F.min(F.struct(*order))
    stats = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    bounds = fold_bounds(stats, class_col, k)
    if shuffle:
        in_class = [hash_order_key(order, seed), *order]
    else:
        in_class = order
    ranked = ordered_scan(df, order_by=in_class, group_by=[class_col], rank_col="_r")
    joined = ranked.join(bounds, F.col(class_col).eqNullSafe(F.col("_bcls")), "inner")
    fold = F.size(F.filter("_ends", lambda e: e <= F.col("_r"))).cast("int")
    return joined.withColumn(fold_col, fold).drop("_bcls", "_ends", "_r")


def positional_split(df: DataFrame, order_by: Sequence[str], frac: float = 0.95,
                     col: str = "split") -> DataFrame:
    """the first ``int(n * frac) + 1`` rows in order are 'train', the rest 'valid'."""
    n = df.count()
    cut = int(n * frac) + 1
    ranked = ordered_scan(df, order_by=list(order_by), rank_col="_p")
    return ranked.withColumn(col, F.when(F.col("_p") < cut, "train").otherwise("valid")).drop("_p")
