"""loss/accuracy rollups, running means, best-so-far.

All rollups are ordinary aggregations with partial (map-side) combine; the
ordered ones (running mean, best so far, batches) go through the skew-safe
``ordered_scan`` so one long run never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotrows import constants as K
from plotrows.functions.numbers import fixed_text, let
from plotrows.operators.ordering import ordered_scan


def epoch_loss(samples: DataFrame, group_by: Sequence[str], order_by: Sequence[str], value: str,
               batch_size: int) -> DataFrame:
    """A4: sample -> batch -> epoch.

    ``mean_of_batches`` = sum of batch means / max(number of batches, 1)
    (the original's unweighted average, D10); ``sample_mean`` weights every
    sample equally.  Without groups an empty input reports 0.
    """
    g = list(group_by)
    ranked = ordered_scan(samples, order_by=list(order_by), group_by=g, rank_col="_r")
    batches = (ranked.groupBy(*g, F.floor(F.col("_r") / batch_size).alias("_b"))
               .agg(F.avg(value).alias("_bm"), F.count(F.lit(1)).alias("_bn"), F.sum(value).alias("_bs")))
    return batches.groupBy(*g).agg(
        F.coalesce(F.sum("_bn"), F.lit(0)).alias("n_samples"),
        F.count(F.lit(1)).alias("n_batches"),
        F.coalesce(F.avg("_bm"), F.lit(0.0)).alias("mean_of_batches"),
        F.coalesce(F.sum("_bs") / F.sum("_bn"), F.lit(0.0)).alias("sample_mean"),
    )


def running_mean(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str], value: str,
                 every: int = 50) -> DataFrame:
    """Running mean of ``value`` per group in order; ``reported`` marks every ``every``-th step."""
    out = ordered_scan(df, order_by=list(order_by), group_by=list(group_by), rank_col="_r", sums=[value])
    return (out.withColumn("running_mean", F.col(f"cum_{value}") / (F.col("_r") + 1))
            .withColumn("reported", ((F.col("_r") + 1) % every) == 0)
            .withColumn("step_index", F.col("_r")).drop("_r", f"cum_{value}"))


def best_so_far(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str], metric: str,
                higher_is_better: bool = False, initial: float | None = None,
                out: str = "is_best") -> DataFrame:
    """Strict improvement over every earlier row of the group (ties keep the earlier one).

    Initial best is 1e5 for losses and -1 for accuracies, as in the original.
    """
    if higher_is_better:
        init = K.INITIAL_BEST_ACCURACY if initial is None else initial
        s = ordered_scan(df, order_by=list(order_by), group_by=list(group_by), rank_col="_r", prev_maxs=[metric])
        flag = F.col(metric) > F.coalesce(F.col(f"prev_max_{metric}"), F.lit(init))
        return s.withColumn(out, flag).drop("_r", f"prev_max_{metric}")
    init = K.INITIAL_BEST_LOSS if initial is None else initial
    s = ordered_scan(df, order_by=list(order_by), group_by=list(group_by), rank_col="_r", prev_mins=[metric])
    flag = F.col(metric) < F.coalesce(F.col(f"prev_min_{metric}"), F.lit(init))
    return s.withColumn(out, flag).drop("_r", f"prev_min_{metric}")


def accuracy(df: DataFrame, pred: str, label: str, group_by: Sequence[str] = (), percent: bool = False) -> DataFrame:
    """A5: correct / total, optionally x100 (validation reporting)."""
    hit = (F.col(pred) == F.col(label)).cast("long")
    acc = F.sum(hit) / F.count(F.lit(1))
    return df.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("correct"),
        (acc * 100 if percent else acc).alias("accuracy"))


def array_moments(arr) -> list[Column]:
    """(n, sum) of an ARRAY<DOUBLE>."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return [F.size(a).cast("long"), F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)]


def batch_moments(df: DataFrame, arr: str, batch: str) -> DataFrame:
    """Per-batch mean and *sample* std over every value of every row's array.

    A row gives (n, mean, squared deviations from it); a batch, whose rows are bounded,
    merges these in pairs, which stays exact where sums of squares would cancel.  Rows
    without values count for nothing; the std of fewer than two values is NULL.
    """
    zero = F.lit(0.0)
    mean = F.aggregate(arr, zero, lambda acc, v: acc + v) / F.size(arr)
    row = let(mean, lambda m: F.struct(F.size(arr).cast("double").alias("n"), m.alias("mean"),
                                       F.aggregate(arr, zero, lambda acc, v: acc + (v - m) * (v - m)).alias("m2")))
    rows = df.where(F.size(arr) > 0).select(batch, row.alias("_row"))

    def merge(acc: Column, r: Column) -> Column:
        n, d = acc["n"] + r["n"], r["mean"] - acc["mean"]
        return F.struct(n.alias("n"), (acc["mean"] + d * (r["n"] / n)).alias("mean"),
                        (acc["m2"] + r["m2"] + d * d * (acc["n"] * r["n"] / n)).alias("m2"))

    start = F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("m2"))
    merged = rows.groupBy(batch).agg(F.aggregate(F.array_sort(F.collect_list("_row")), start, merge).alias("_all"))
    return merged.select(batch, F.col("_all.mean").alias("batch_mean"),
                         F.when(F.col("_all.n") > 1, F.sqrt(F.col("_all.m2") / (F.col("_all.n") - 1))).alias("batch_std"))


def standard_score(v: Column, mean: Column, std: Column) -> Column:
    """(v - mean) / std; 0 in a batch whose values are all equal, or that has one value only."""
    return F.when(std > 0, (v - mean) / std).otherwise(F.lit(0.0))


def standardize(df: DataFrame, arr: str, batch: str, out: str | None = None) -> DataFrame:
    """T5: subtract the batch mean and divide by the batch std (joined back on the batch id)."""
    stats = batch_moments(df, arr, batch)
    j = df.join(stats, batch)
    return j.withColumn(out or arr, F.transform(arr, lambda v: standard_score(v, F.col("batch_mean"), F.col("batch_std"))))


def row_count_guard(left: DataFrame, right: DataFrame, expected: int | None = None,
                    strict: bool = False) -> DataFrame:
    """Both listings' counts in one row; ``strict`` raises inside the job on mismatch."""
    tagged = (left.select(F.lit(1).alias("_l"), F.lit(0).alias("_r"))
              .unionByName(right.select(F.lit(0).alias("_l"), F.lit(1).alias("_r"))))
    row = tagged.agg(F.sum("_l").cast("long").alias("n_left"), F.sum("_r").cast("long").alias("n_right"))
    row = row.select(F.coalesce("n_left", F.lit(0).cast("long")).alias("n_left"),
                     F.coalesce("n_right", F.lit(0).cast("long")).alias("n_right"))
    ok = F.col("n_left") == F.col("n_right")
    if expected is not None:
        ok = ok & (F.col("n_left") == expected)
    row = row.withColumn("counts_match", ok)
    if strict:
        row = row.withColumn("counts_match", F.when(ok, ok).otherwise(
            F.raise_error(F.lit("row-count guard failed")).cast("boolean")))
    return row


def timestamp_text(c) -> Column:
    """``strftime("%Y-%m-%d %H:%M:%S")``."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def fixed4(c) -> Column:
    """``f"{v:.4f}"`` (``fixed_text``)."""
    return fixed_text(c, 4)


def checkpoint_registry(epochs: DataFrame, run: str, epoch_order: str, loss: str, train_loss: str,
                        prefix: str = "model") -> DataFrame:
    """Every epoch's file path, named by the training loss, and the best-so-far
    path, named by the validation loss ``loss``, when that strictly improves.

    One ordered scan gives both the epoch index within the run and the best
    loss of the earlier epochs.
    """
    s = ordered_scan(epochs, order_by=[epoch_order], group_by=[run], rank_col="epoch_idx", prev_mins=[loss])
    s = s.withColumn("is_best", F.col(loss) < F.coalesce(F.col(f"prev_min_{loss}"), F.lit(K.INITIAL_BEST_LOSS)))

    def name(kind: str, value: str) -> Column:
        return F.concat(F.lit(f"{kind}{prefix}_run_"), F.col(run).cast("string"), F.lit("_epoch_"),
                        F.col("epoch_idx").cast("string"), F.lit("_loss_"), fixed4(value), F.lit(".bin"))
    path, best_path = name("", train_loss), name("best_", loss)
    return (s.withColumn("path", path).withColumn("best_path", F.when(F.col("is_best"), best_path))
            .drop(f"prev_min_{loss}"))


def value_counts(df: DataFrame, col: str, rank_col: str = "rank") -> DataFrame:
    """A2: count per value, nulls dropped, ranked by count descending then value.

    The rank comes from the skew-safe ordered scan over the aggregated table,
    so a high-cardinality column never funnels through one window task.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return ordered_scan(counts, order_by=[F.col("n").desc(), F.col(col)], rank_col=rank_col)
