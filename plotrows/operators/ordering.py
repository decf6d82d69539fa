"""Skew-safe ordered numbering and running aggregates.

``row_number()`` over a window partitioned by a few keys runs one task per
key: with five chart classes, fold numbering would use five tasks however
large the corpus, and one hot run or chart would sit in a single task.  The
operator here never puts a whole group in one task:

1. range-partition on (group keys, order keys) and sort inside each
   partition -- the sampled boundaries split a hot group over many balanced
   partitions -- then cut the lineage with a reliable checkpoint so the
   boundaries cannot move if a lost executor forces a recompute;
2. number rows inside each partition with ``monotonically_increasing_id``
   (partition index in the high bits, position in the low bits): no shuffle;
3. summarise each (partition, group) to one row (count, first position, and
   sum/min/max for running aggregates) and turn those into carries with a
   window per group ordered by partition -- at most one row per partition per
   group, so bounded by the partition count for any single group;
4. add the carries back with a join on (partition, group); AQE broadcasts the
   carry table if it is small.

Running sums and exclusive running min/max additionally need a window over
(partition, group) -- a balanced key, never a whole group.  Running sums are
taken in DECIMAL(38, ``SUM_SCALE``), so they do not depend on how rows fell
into partitions.  Every scan goes this way, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotrows.session import reliable_checkpoint

SUM_SCALE = 12  # decimals of running sums


def _names(cols: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def ordered_scan(
    df: DataFrame,
    order_by: Sequence,
    group_by: Sequence[str] = (),
    rank_col: str = "rank",
    sums: Sequence[str] = (),
    prev_mins: Sequence[str] = (),
    prev_maxs: Sequence[str] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Add a 0-based ``rank_col`` (position in ``order_by`` within ``group_by``),
    inclusive running sums ``cum_<c>`` for ``sums``, and *exclusive* running
    min/max ``prev_min_<c>``/``prev_max_<c>`` (over earlier rows of the group).

    ``order_by`` must be a total order within a group (add a unique key as the
    last tie-breaker); NULL group keys form one group.  Pass narrow rows: they
    are written to the checkpoint folder once.
    """
    group_by = list(group_by)
    sort_cols = [*[F.col(g) for g in group_by], *_names(order_by)]
    # Without an explicit count the range exchange is sized by AQE (coalesced to
    # the advisory partition size); merged neighbours stay contiguous ranges.
    ranged = (df.repartitionByRange(num_partitions, *sort_cols) if num_partitions
              else df.repartitionByRange(*sort_cols))
    pid = F.spark_partition_id().cast("long")
    ranged = (ranged.sortWithinPartitions(*sort_cols)
              .withColumn("_pid", pid)
              .withColumn("_lpos", F.monotonically_increasing_id() - F.shiftleft(pid, 33)))
    ranged = reliable_checkpoint(ranged)

    exact = {c: F.col(c).cast(f"decimal(38,{SUM_SCALE})") for c in sums}
    keys = ["_pid", *group_by]
    summary_aggs = [F.count(F.lit(1)).alias("_n"), F.min("_lpos").alias("_first")]
    summary_aggs += [F.sum(exact[c]).alias(f"_s_{c}") for c in sums]
    summary_aggs += [F.min(c).alias(f"_m_{c}") for c in prev_mins]
    summary_aggs += [F.max(c).alias(f"_x_{c}") for c in prev_maxs]
    summary = ranged.groupBy(*keys).agg(*summary_aggs)
    w_carry = Window.partitionBy(*group_by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "_first",
        F.coalesce(F.sum("_n").over(w_carry), F.lit(0)).alias("_cn"),
        *[F.coalesce(F.sum(f"_s_{c}").over(w_carry), F.lit(0)).alias(f"_cs_{c}") for c in sums],
        *[F.min(f"_m_{c}").over(w_carry).alias(f"_cm_{c}") for c in prev_mins],
        *[F.max(f"_x_{c}").over(w_carry).alias(f"_cx_{c}") for c in prev_maxs],
    )

    local = ranged
    if sums or prev_mins or prev_maxs:
        w_local = Window.partitionBy(*keys).orderBy("_lpos")
        w_incl = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        w_excl = w_local.rowsBetween(Window.unboundedPreceding, -1)
        for c in sums:
            local = local.withColumn(f"_lsum_{c}", F.sum(exact[c]).over(w_incl))
        for c in prev_mins:
            local = local.withColumn(f"_lmin_{c}", F.min(c).over(w_excl))
        for c in prev_maxs:
            local = local.withColumn(f"_lmax_{c}", F.max(c).over(w_excl))

    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    out = local.join(carry, same, "inner")
    out = out.withColumn(rank_col, (F.col("_lpos") - F.col("_first") + F.col("_cn")).cast("long"))
    for c in sums:
        out = out.withColumn(f"cum_{c}", (F.col(f"_lsum_{c}") + F.col(f"_cs_{c}")).cast("double"))
    for c in prev_mins:
        out = out.withColumn(f"prev_min_{c}", F.least(f"_lmin_{c}", f"_cm_{c}"))
    for c in prev_maxs:
        out = out.withColumn(f"prev_max_{c}", F.greatest(f"_lmax_{c}", f"_cx_{c}"))
    drop = ["_pid", "_lpos", "_first", "_cn", *[f"_k_{k}" for k in keys]]
    drop += [f"_lsum_{c}" for c in sums] + [f"_cs_{c}" for c in sums]
    drop += [f"_lmin_{c}" for c in prev_mins] + [f"_cm_{c}" for c in prev_mins]
    drop += [f"_lmax_{c}" for c in prev_maxs] + [f"_cx_{c}" for c in prev_maxs]
    return out.drop(*drop)


def global_position(df: DataFrame, order_by: Sequence, col: str = "pos") -> DataFrame:
    """0-based dense position of every row in ``order_by`` (no single-task window)."""
    return ordered_scan(df, order_by, (), rank_col=col)


def hash_order_key(key_cols: Sequence[str], seed: int) -> Column:
    """Reproducible shuffle order: ``md5(key || ':' || seed)``.

    Replaces ``sample(frac=1)`` / ``rand()``: the same rows always land in the
    same order whatever the partitioning, so re-runs and recomputes agree.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key_cols]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))
