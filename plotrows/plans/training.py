"""Q4-Q6 and M4: train/valid preparation, extra-corpus sample, classifier and validation evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotrows import constants as K
from plotrows.operators import metrics as M
from plotrows.operators.folds import stratified_kfold
from plotrows.operators.sampling import batch_assign, shuffle_limit
from plotrows.operators.ordering import hash_order_key, ordered_scan
from plotrows.operators.scoring import softmax_ce
from plotrows.plans.corpus import charts_with_folds
from plotrows.sources import fixtures as fx

EXCLUDED_TYPES = ["scatter", "horizontal_bar"]


def not_in(column: str, values) -> Column:
    """``~isin`` that keeps NULL, as the original's mask does."""
    return ~F.coalesce(F.col(column).isin(*values), F.lit(False))


def train_valid_prep(spark: SparkSession, sf_dir: str, batch_size: int = 8, seed: int = K.SEED) -> DataFrame:
    """Q4: fold != 0 train (shuffled), fold 0 valid (stored order), both without the excluded types; batched.

    Both splits are numbered by one grouped ordered scan: the train rows order
    by the seeded hash, the valid rows by ``image_id`` (the hash column is NULL
    for them), so one shuffle serves both.
    """
    f = charts_with_folds(spark, sf_dir).filter(not_in("chart_type", EXCLUDED_TYPES))
    f = f.withColumn("split", F.when(F.col("fold") != 0, "train").otherwise("valid"))
    shuffled = F.when(F.col("split") == "train", hash_order_key(["image_id"], seed))
    ranked = ordered_scan(f.withColumn("_h", shuffled), order_by=[F.col("_h"), F.col("image_id")],
                          group_by=["split"], rank_col="pos")
    return ranked.select("image_id", "split", "pos",
                         F.floor(F.col("pos") / batch_size).cast("long").alias("batch_id"))


def extra_sample(spark: SparkSession, sf_dir: str, n: int = 80_000, seed: int = K.SEED,
                 exclude: tuple[str, ...] = ("scatter",), only: str | None = None) -> DataFrame:
    """Q5: validation = 0 rows (minus ``exclude``, or only class ``only``: F7), shuffled,
    first ``n``; validation = 1 rows of the same classes kept whole."""
    m = fx.extra_metadata(spark, sf_dir)
    m = m.filter(F.col("chart_type") == only) if only else m.filter(not_in("chart_type", exclude))
    train = shuffle_limit(m.filter(F.col("validation") == 0), ["file_name"], n, seed)
    valid = m.filter(F.col("validation") == 1).withColumn("shuffle_rank", F.lit(None).cast("long"))
    cols = ["file_name", "chart_type", "shuffle_rank"]
    return (train.select(*cols).withColumn("split", F.lit("train"))
            .unionByName(valid.select(*cols).withColumn("split", F.lit("valid"))))


def rule_logits(z: Column, epoch: Column, n_classes: int = 5, n_features: int = 64) -> Column:
    """Linear test scorer: logit_c = sum_j z[j] * (((c*13 + j*7 + epoch*5) % 11) - 5) / 10."""
    # the weights repeat every 11 epochs: one constant, indexed by the epoch
    weights = F.lit([[[(((c * 13 + j * 7 + e * 5) % 11) - 5) / 10.0 for j in range(n_features)] for c in range(n_classes)] for e in range(11)])
    own = F.get(weights, (epoch % 11).cast("int"))
    return F.transform(own, lambda w: F.aggregate(F.zip_with(z, w, lambda v, x: v * x), F.lit(0.0), lambda acc, v: acc + v))


def classifier_eval(spark: SparkSession, sf_dir: str, epochs: int = 5, batch_size: int = 64) -> DataFrame:
    """Q6: F4 -> P3 -> T3 -> T5 -> T6 -> A4 -> A5 -> W4 over the validation rows, one scorer per epoch."""
    px = fx.pixels(spark, sf_dir).filter(F.col("id") % 10 == 0)
    # ids alone go through the numbering; the arrays join back
    batches = batch_assign(px.select("id"), [F.col("id")], batch_size).select("id", "batch_id")
    valid = px.select(
        "id", (F.col("raw_label") % 5).cast("int").alias("label"),
        F.transform("px", lambda v: (v / 255.0 - 0.5) / 0.5).alias("xn")).join(batches, "id")
    z = M.standardize(valid, "xn", "batch_id", out="z")
    per_epoch = z.select("id", "label", "batch_id", "z",
                         F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    lg = per_epoch.withColumn("logits", rule_logits(F.col("z"), F.col("epoch")))
    t6 = softmax_ce("logits", "label")
    scored = lg.select("epoch", "batch_id", "label", t6["ce"].alias("ce"), t6["pred"].alias("pred"))
    batches = scored.groupBy("epoch", "batch_id").agg(F.avg("ce").alias("bm"),
                                                       F.sum((F.col("pred") == F.col("label")).cast("long")).alias("hit"),
                                                       F.count(F.lit(1)).alias("bn"))
    ep = batches.groupBy("epoch").agg(
        F.round(F.sum("bm") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("loss"),
        F.round(F.sum("hit") * 100.0 / F.sum("bn"), 6).alias("accuracy"))
    best = M.best_so_far(ep, [], ["epoch"], "accuracy", higher_is_better=True)
    return best.select(F.col("epoch").cast("int").alias("epoch"), "loss", "accuracy", "is_best")


def validation_loss(spark: SparkSession, sf_dir: str, chart_type: str = "scatter", batch_size: int = 8) -> DataFrame:
    """M4: one class, fold 0, per-sample CE -> batch means -> epoch (both averages, D10)."""
    s = fx.scores(spark, sf_dir).withColumn(
        "chart_type", F.get(F.array(*[F.lit(n) for n in K.CHART_TYPES]), F.col("label")))
    folds = stratified_kfold(s.select("id", "chart_type"), "chart_type", ["id"], k=10)
    chosen = folds.filter((F.col("chart_type") == chart_type) & (F.col("fold") == 0)).select("id")
    v = s.join(chosen, "id", "left_semi")
    t6 = softmax_ce("logits", "label")
    v = v.select("id", t6["ce"].alias("ce"))
    out = M.epoch_loss(v, [], ["id"], "ce", batch_size)
    return out.select("n_samples", "n_batches", F.round("mean_of_batches", 6).alias("mean_of_batches"),
                      F.round("sample_mean", 6).alias("sample_mean"))
