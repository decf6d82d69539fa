"""Registered training-side queries: splits, batches, shuffles, losses, accuracy, registry."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from plotrows import constants as K
from plotrows.functions.numbers import argmax
from plotrows.operators import metrics as M
from plotrows.operators.folds import positional_split
from plotrows.operators.hooks import collate_batches, transform_rows
from plotrows.operators.sampling import batch_assign, head_n, shuffle, shuffle_limit
from plotrows.operators.scoring import softmax_ce
from plotrows.plans import training as TR
from plotrows.plans.catalog import register
from plotrows.plans.corpus import charts_with_folds
from plotrows.plans.sqlparts import folds_ctes, md5_key
from plotrows.sources import fixtures as fx


def _head(names: list[str]) -> str:
    return fx.with_views(names, "SELECT 1").replace("\nSELECT 1", "")


_FOLDS = _head(["charts"]) + "," + folds_ctes("charts", "chart_type", "image_id", 10, "folds10") + """,
cf AS (SELECT c.image_id, c.chart_type, f.fold FROM charts c JOIN folds10 f USING (image_id))
"""

SAMPLE_N = 80_000   # the original's extra-corpus sample size
SHORT_N = 1_000     # a limit that bites at every scale of the tables


@register("split_sizes", sql=_FOLDS + """
SELECT count(*) AS n_total,
       count(*) FILTER (WHERE fold <> 0 AND coalesce(chart_type NOT IN ('scatter', 'horizontal_bar'), true)) AS n_train,
       count(*) FILTER (WHERE fold = 0 AND coalesce(chart_type NOT IN ('scatter', 'horizontal_bar'), true)) AS n_valid
FROM cf""")
def q_split_sizes(spark, sf_dir):
    f = charts_with_folds(spark, sf_dir)
    keep = TR.not_in("chart_type", TR.EXCLUDED_TYPES)
    return f.agg(F.count(F.lit(1)).alias("n_total"),
                 F.count_if((F.col("fold") != 0) & keep).alias("n_train"),
                 F.count_if((F.col("fold") == 0) & keep).alias("n_valid"))


@register("train_valid_prep", sql=_FOLDS + f""",
tr AS (SELECT image_id, 'train' AS split,
              row_number() OVER (ORDER BY {md5_key('image_id')}, image_id) - 1 AS pos
       FROM cf WHERE fold <> 0 AND coalesce(chart_type NOT IN ('scatter', 'horizontal_bar'), true)),
va AS (SELECT image_id, 'valid' AS split, row_number() OVER (ORDER BY image_id) - 1 AS pos
       FROM cf WHERE fold = 0 AND coalesce(chart_type NOT IN ('scatter', 'horizontal_bar'), true))
SELECT image_id, split, pos, pos // 8 AS batch_id FROM (SELECT * FROM tr UNION ALL SELECT * FROM va)""")
def q_train_valid_prep(spark, sf_dir):
    return TR.train_valid_prep(spark, sf_dir)


_EXTRA_SQL = _head(["extra_metadata"]) + f""",
tr AS (SELECT file_name, chart_type, row_number() OVER (ORDER BY {md5_key('file_name')}, file_name) - 1 AS shuffle_rank
       FROM extra_metadata WHERE validation = 0 AND {{keep}})
SELECT file_name, chart_type, shuffle_rank, 'train' AS split FROM tr WHERE shuffle_rank < {{n}}
UNION ALL
SELECT file_name, chart_type, CAST(NULL AS BIGINT), 'valid' FROM extra_metadata
WHERE validation = 1 AND {{keep}}"""


@register("extra_sample", sql=_EXTRA_SQL.format(n=SAMPLE_N, keep="chart_type IS DISTINCT FROM 'scatter'"))
def q_extra_sample(spark, sf_dir):
    return TR.extra_sample(spark, sf_dir, SAMPLE_N)


@register("extra_sample_short", sql=_EXTRA_SQL.format(n=SHORT_N, keep="chart_type IS DISTINCT FROM 'scatter'"))
def q_extra_sample_short(spark, sf_dir):
    """Q5 with a limit below the number of rows at every scale."""
    return TR.extra_sample(spark, sf_dir, SHORT_N)


@register("single_class_sample", sql=_EXTRA_SQL.format(n=100, keep="chart_type = 'horizontal_bar'"))
def q_single_class_sample(spark, sf_dir):
    """the extra sample of one class."""
    return TR.extra_sample(spark, sf_dir, 100, only="horizontal_bar")


@register("flag_split", sql=fx.with_views(["extra_metadata"], """
SELECT file_name, validation, chart_type, CASE WHEN validation = 0 THEN 'train' ELSE 'valid' END AS split
FROM extra_metadata WHERE chart_type IS DISTINCT FROM 'scatter' AND validation IN (0, 1)"""))
def q_flag_split(spark, sf_dir):
    m = fx.extra_metadata(spark, sf_dir)
    m = m.filter(TR.not_in("chart_type", ["scatter"]) & F.col("validation").isin(0, 1))
    return m.select("file_name", "validation", "chart_type",
                    F.when(F.col("validation") == 0, "train").otherwise("valid").alias("split"))


@register("positional_split", sql=fx.with_views(["charts"], """
SELECT image_id, CASE WHEN row_number() OVER (ORDER BY image_id) <= CAST(floor(count(*) OVER () * 0.95) AS BIGINT) + 1
                      THEN 'train' ELSE 'valid' END AS split
FROM charts"""))
def q_positional_split(spark, sf_dir):
    c = fx.charts(spark, sf_dir).select("image_id")
    return positional_split(c, [F.col("image_id")], 0.95)


@register("shuffle", sql=fx.with_views(["charts"], f"""
SELECT image_id, row_number() OVER (ORDER BY {md5_key('image_id')}, image_id) - 1 AS shuffle_rank FROM charts"""))
def q_shuffle(spark, sf_dir):
    return shuffle(fx.charts(spark, sf_dir).select("image_id"), ["image_id"], K.SEED)


@register("head_n", sql=fx.with_views(["charts"], """
SELECT image_id, chart_type, row_number() OVER (ORDER BY image_id) - 1 AS rank FROM charts ORDER BY image_id LIMIT 5"""))
def q_head_n(spark, sf_dir):
    return head_n(fx.charts(spark, sf_dir).select("image_id", "chart_type"), ["image_id"], 5)


@register("shuffle_limit", sql=fx.with_views(["charts"], f"""
SELECT * FROM (SELECT image_id, row_number() OVER (ORDER BY {md5_key('image_id')}, image_id) - 1 AS shuffle_rank
               FROM charts) WHERE shuffle_rank < {SHORT_N}"""))
def q_shuffle_limit(spark, sf_dir):
    return shuffle_limit(fx.charts(spark, sf_dir).select("image_id"), ["image_id"], SHORT_N, K.SEED)


@register("batch_assign", sql=fx.with_views(["charts"], f"""
SELECT image_id, pos, pos // 8 AS batch_id FROM
  (SELECT image_id, row_number() OVER (ORDER BY {md5_key('image_id')}, image_id) - 1 AS pos FROM charts)"""))
def q_batch_assign(spark, sf_dir):
    from plotrows.operators.ordering import hash_order_key
    c = fx.charts(spark, sf_dir).select("image_id")
    return batch_assign(c, [hash_order_key(["image_id"], K.SEED), F.col("image_id")], 8) \
        .select("image_id", "pos", "batch_id")


@register("rowcount_guard", sql="""
SELECT (SELECT count(*) FROM orders) AS n_left,
       (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_right,
       (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS counts_match""")
def q_rowcount_guard(spark, sf_dir):
    annotations = fx.charts(spark, sf_dir).select("image_id")
    images = fx.table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return M.row_count_guard(annotations, images)


_ML_EPOCH = "strftime(epoch, '%Y-%m-%d')"


@register("epoch_loss", sql=fx.with_views(["metric_log"], f""",
r AS (SELECT *, (row_number() OVER (PARTITION BY run, epoch, metric ORDER BY step) - 1) // 8 AS b FROM metric_log),
bt AS (SELECT run, epoch, metric, b, avg(value) AS bm, count(*) AS bn, sum(value) AS bs FROM r GROUP BY run, epoch, metric, b)
SELECT run, {_ML_EPOCH} AS epoch, metric, CAST(sum(bn) AS BIGINT) AS n_samples, count(*) AS n_batches,
       round(sum(bm) / greatest(count(*), 1), 9) AS mean_of_batches, round(sum(bs) / sum(bn), 9) AS sample_mean
FROM bt GROUP BY run, epoch, metric""".replace("\n,", ",", 1)).replace("FROM events),\nr AS", "FROM events)\n, r AS"))
def q_epoch_loss(spark, sf_dir):
    ml = fx.metric_log(spark, sf_dir)
    out = M.epoch_loss(ml, ["run", "epoch", "metric"], ["step"], "value", 8)
    return out.select("run", F.date_format("epoch", "yyyy-MM-dd").alias("epoch"), "metric", "n_samples",
                      "n_batches", F.round("mean_of_batches", 9).alias("mean_of_batches"),
                      F.round("sample_mean", 9).alias("sample_mean"))


@register("running_loss", sql=fx.with_views(["metric_log"], f"""
SELECT run, {_ML_EPOCH} AS epoch, step,
       row_number() OVER w - 1 AS step_index,
       round(avg(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS running_mean,
       row_number() OVER w % 50 = 0 AS reported
FROM metric_log WINDOW w AS (PARTITION BY run, epoch ORDER BY step)"""))
def q_running_loss(spark, sf_dir):
    ml = fx.metric_log(spark, sf_dir)
    out = M.running_mean(ml, ["run", "epoch"], ["step"], "value", every=50)
    return out.select("run", F.date_format("epoch", "yyyy-MM-dd").alias("epoch"), "step", "step_index",
                      F.round("running_mean", 9).alias("running_mean"), "reported")


_EPOCHS_SQL = fx.with_views(["metric_log"], "SELECT 1").replace("\nSELECT 1", "") + """,
e AS (SELECT run, epoch, round(avg(value), 6) AS loss, round(max(value), 6) AS train_loss FROM metric_log GROUP BY run, epoch),
eb AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) - 1 AS epoch_idx,
              loss < coalesce(min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100000.0) AS is_best
       FROM e)
"""


def _epochs(spark, sf_dir):
    ml = fx.metric_log(spark, sf_dir)
    return ml.groupBy("run", "epoch").agg(F.round(F.avg("value"), 6).alias("loss"), F.round(F.max("value"), 6).alias("train_loss"))


@register("best_epochs", sql=_EPOCHS_SQL + f"SELECT run, {_ML_EPOCH} AS epoch, loss, is_best FROM eb")
def q_best_epochs(spark, sf_dir):
    b = M.best_so_far(_epochs(spark, sf_dir), ["run"], ["epoch"], "loss")
    return b.select("run", F.date_format("epoch", "yyyy-MM-dd").alias("epoch"), "loss", "is_best")


@register("checkpoint_registry", sql=_EPOCHS_SQL + f"""
SELECT run, epoch_idx, strftime(epoch, '%Y-%m-%d %H:%M:%S') AS epoch, loss, train_loss, is_best,
       'model_run_' || run || '_epoch_' || epoch_idx || '_loss_' || printf('%.4f', train_loss) || '.bin' AS path,
       CASE WHEN is_best THEN 'best_model_run_' || run || '_epoch_' || epoch_idx || '_loss_' || printf('%.4f', loss) || '.bin' END AS best_path
FROM eb""")
def q_checkpoint_registry(spark, sf_dir):
    reg = M.checkpoint_registry(_epochs(spark, sf_dir), "run", "epoch", "loss", "train_loss")
    return reg.select("run", "epoch_idx", M.timestamp_text("epoch").alias("epoch"), "loss", "train_loss", "is_best",
                      "path", "best_path")


@register("accuracy", sql=fx.with_views(["scores"], """
SELECT CASE WHEN id % 10 = 0 THEN 'valid' ELSE 'train' END AS split, count(*) AS n,
       CAST(sum(CASE WHEN list_position(logits, list_max(logits)) - 1 = label THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(sum(CASE WHEN list_position(logits, list_max(logits)) - 1 = label THEN 1 ELSE 0 END) * 1.0 / count(*)
             * CASE WHEN id % 10 = 0 THEN 100 ELSE 1 END, 6) AS accuracy
FROM scores GROUP BY 1, id % 10 = 0""".replace("GROUP BY 1, id % 10 = 0", "GROUP BY split, (id % 10 = 0)")))
def q_accuracy(spark, sf_dir):
    s = fx.scores(spark, sf_dir).select(
        F.when(F.col("id") % 10 == 0, "valid").otherwise("train").alias("split"), argmax("logits").alias("pred"), "label")
    a = M.accuracy(s, "pred", "label", ["split"])
    scale = F.when(F.col("split") == "valid", F.lit(100.0)).otherwise(F.lit(1.0))
    return a.select("split", "n", "correct", F.round(F.col("accuracy") * scale, 6).alias("accuracy"))


@register("batch_standardize", sql=fx.with_views(["pixels"], """
, b AS (SELECT id, px, (row_number() OVER (ORDER BY id) - 1) // 64 AS batch_id FROM pixels),
st AS (SELECT batch_id, avg(v) AS mean, stddev_samp(v) AS std FROM (SELECT batch_id, unnest(px) AS v FROM b) GROUP BY batch_id)
SELECT b.id, b.batch_id, round(st.mean, 6) AS batch_mean, round(st.std, 6) AS batch_std,
       round(CASE WHEN st.std > 0 THEN (list_sum(px) / len(px) - st.mean) / st.std ELSE 0 END, 6) AS z_mean
FROM b JOIN st USING (batch_id)""").replace("\n\n, b AS", ", b AS").replace("embeddings)\n, b AS", "embeddings), b AS"))
def q_batch_standardize(spark, sf_dir):
    px = fx.pixels(spark, sf_dir).select("id", "px")
    px = px.join(batch_assign(px.select("id"), [F.col("id")], 64).select("id", "batch_id"), "id")
    stats = M.batch_moments(px, "px", "batch_id")
    n, s1 = M.array_moments("px")
    j = px.select("id", "batch_id", (s1 / n).alias("_m")).join(stats, "batch_id")
    return j.select("id", "batch_id", F.round("batch_mean", 6).alias("batch_mean"),
                    F.round("batch_std", 6).alias("batch_std"),
                    F.round(M.standard_score(F.col("_m"), F.col("batch_mean"), F.col("batch_std")), 6).alias("z_mean"))


@register("pixel_normalize", sql=fx.with_views(["pixels"], """
SELECT id, CAST(len(xn) AS BIGINT) AS n, round(list_sum(xn) / len(xn), 6) AS mean,
       round(list_min(xn), 6) AS min_value, round(list_max(xn), 6) AS max_value,
       md5(array_to_string(list_transform(xn, lambda v: CAST(floor(v * 1000000) AS BIGINT)), ',')) AS values_md5
FROM (SELECT id, list_transform(px, lambda v: (v / 255.0 - 0.5) / 0.5) AS xn FROM pixels)"""))
def q_pixel_normalize(spark, sf_dir):
    px = fx.pixels(spark, sf_dir)
    xn = F.transform("px", lambda v: (v / 255.0 - 0.5) / 0.5)
    n, s1 = M.array_moments(xn)
    return px.select("id", n.alias("n"), F.round(s1 / n, 6).alias("mean"),
                     F.round(F.array_min(xn), 6).alias("min_value"), F.round(F.array_max(xn), 6).alias("max_value"),
                     F.md5(F.array_join(F.transform(xn, lambda v: F.floor(v * 1000000).cast("string")), ",")).alias("values_md5"))


@register("softmax_ce", sql=fx.with_views(["scores"], """
SELECT id, label, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred,
       round(exp(logits[label + 1] - m) / s, 6) AS p_label,
       round(ln(s) + m - logits[label + 1], 6) AS ce,
       round(exp(logits[2] - m) / s, 6) AS p1
FROM (SELECT *, list_max(logits) AS m,
             list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))) AS s FROM scores)"""))
def q_softmax_ce(spark, sf_dir):
    s = fx.scores(spark, sf_dir)
    t6 = softmax_ce("logits", "label")
    return s.select("id", "label", t6["pred"].alias("pred"), F.round(t6["p_label"], 6).alias("p_label"),
                    F.round(t6["ce"], 6).alias("ce"), F.round(t6["p1"], 6).alias("p1"))


_PAD = K.MAX_LABEL_TOKENS


@register("pad_truncate", sql=fx.with_views(["tokens"], f"""
SELECT id, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(least(len(ids), {_PAD}) AS BIGINT) AS n_kept,
       CAST(greatest({_PAD} - len(ids), 0) AS BIGINT) AS n_pad, len(ids) > {_PAD} AS truncated,
       coalesce(ids[1], '{K.PAD_TOKEN}') AS first_token,
       CASE WHEN len(ids) >= {_PAD} THEN ids[{_PAD}] ELSE '{K.PAD_TOKEN}' END AS last_token,
       md5(array_to_string(list_concat(ids[1:{_PAD}], list_transform(range({_PAD} - len(ids)), lambda i: '{K.PAD_TOKEN}')), ' ')) AS padded_md5
FROM tokens"""))
def q_pad_truncate(spark, sf_dir):
    t = fx.tokens(spark, sf_dir)
    padded = F.slice(F.concat("ids", F.array_repeat(F.lit(K.PAD_TOKEN), _PAD)), 1, _PAD)
    return t.select("id", F.size("ids").cast("long").alias("n_tokens"),
                    F.least(F.size("ids"), F.lit(_PAD)).cast("long").alias("n_kept"),
                    F.greatest(F.lit(_PAD) - F.size("ids"), F.lit(0)).cast("long").alias("n_pad"),
                    (F.size("ids") > _PAD).alias("truncated"),
                    F.get(padded, 0).alias("first_token"), F.get(padded, _PAD - 1).alias("last_token"),
                    F.md5(F.array_join(padded, " ")).alias("padded_md5"))


@register("collate", sql=_head(["tokens"]) + f""",
b AS (SELECT id, list_slice(ids, 1, {_PAD}) AS kept, (row_number() OVER (ORDER BY id) - 1) // 8 AS batch_id FROM tokens),
p AS (SELECT *, list_concat(kept, list_transform(range({_PAD} - len(kept)), lambda i: '{K.PAD_TOKEN}')) AS padded FROM b)
SELECT batch_id, count(*) AS n_rows, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids_text,
       CAST(max(len(kept)) AS BIGINT) AS max_kept, CAST(sum(len(kept)) AS BIGINT) AS total_kept,
       md5(string_agg(array_to_string(padded, ' '), '|' ORDER BY id)) AS padded_md5
FROM p GROUP BY batch_id""")
def q_collate(spark, sf_dir):
    """A caller's collate function for every batch; ids alone are numbered, the kept tokens join back."""
    t = fx.tokens(spark, sf_dir)
    batches = batch_assign(t.select("id"), [F.col("id")], 8).select("id", "batch_id")
    rows = t.select("id", F.slice("ids", 1, _PAD).alias("kept")).join(batches, "id")
    return collate_batches(rows, pad_collate, "batch_id", ["id"], ["kept"],
                           "n_rows long, ids_text string, max_kept long, total_kept long, padded_md5 string", max_rows=8)


def pad_collate():
    """A collate function as a caller would write it: every row padded to the same length, digested."""
    def call(rows):
        ids, kept = rows["id"].to_pylist(), rows["kept"].to_pylist()
        padded = "|".join(" ".join(k + [K.PAD_TOKEN] * (_PAD - len(k))) for k in kept)
        return {"n_rows": [len(ids)], "ids_text": [",".join(map(str, ids))], "max_kept": [max(map(len, kept))],
                "total_kept": [sum(map(len, kept))], "padded_md5": [hashlib.md5(padded.encode()).hexdigest()]}
    return call


@register("row_transform", sql=_head(["pixels"]) + """
SELECT id, CASE WHEN raw_label % 5 = 3 THEN 'ValueError: no augmentation for this label' END AS error,
       CASE WHEN raw_label % 5 <> 3 THEN list_max(px) - list_min(px) END AS contrast,
       CASE WHEN raw_label % 5 <> 3 THEN md5(array_to_string(list_transform(range(64), lambda j:
            CAST(floor(px[(j // 8) * 8 + 8 - j % 8] * 1000000) AS BIGINT)), ',')) END AS flipped_md5
FROM pixels""")
def q_row_transform(spark, sf_dir):
    """2.12: a caller's per-row transform; the rows it rejects go to ``error``."""
    px = fx.pixels(spark, sf_dir)
    out = transform_rows(px, mirror_transform, ["px", "raw_label"], "flipped array<double>, contrast double")
    text = F.array_join(F.transform("flipped", lambda v: F.floor(v * 1000000).cast("string")), ",")
    return out.select("id", "error", "contrast", F.when(F.col("error").isNull(), F.md5(text)).alias("flipped_md5"))


def mirror_transform():
    """An augmentation as a caller would write it: 8 x 8 images mirrored, one label refused."""
    def call(batch):
        if any(v % 5 == 3 for v in batch["raw_label"].to_pylist()):
            raise ValueError("no augmentation for this label")
        px = np.stack(batch["px"].to_numpy(zero_copy_only=False)).reshape(-1, 8, 8)
        return {"flipped": list(px[:, :, ::-1].reshape(-1, 64)), "contrast": px.max((1, 2)) - px.min((1, 2))}
    return call


_SCORE_CLASS = "[" + ", ".join(f"'{n}'" for n in K.CHART_TYPES) + "][label + 1]"


@register("validation_loss", sql=_head(["scores"]) + """,
sc AS (SELECT id, logits, label, """ + _SCORE_CLASS + """ AS chart_type FROM scores),""" +
          folds_ctes("sc", "chart_type", "id", 10, "sf").lstrip("\n") + """,
v AS (SELECT s.id, ln(list_sum(list_transform(s.logits, lambda x: exp(x - list_max(s.logits))))) + list_max(s.logits) - s.logits[s.label + 1] AS ce
      FROM sc s JOIN sf f USING (id) WHERE s.chart_type = 'scatter' AND f.fold = 0),
vb AS (SELECT ce, (row_number() OVER (ORDER BY id) - 1) // 8 AS b FROM v),
bt AS (SELECT b, avg(ce) AS bm, count(*) AS bn, sum(ce) AS bs FROM vb GROUP BY b)
SELECT CAST(sum(bn) AS BIGINT) AS n_samples, count(*) AS n_batches,
       round(sum(bm) / greatest(count(*), 1), 6) AS mean_of_batches, round(sum(bs) / sum(bn), 6) AS sample_mean FROM bt""")
def q_validation_loss(spark, sf_dir):
    return TR.validation_loss(spark, sf_dir)


def _rule_logits_sql(z: str, epoch: str) -> str:
    return (f"list_transform(range(5), lambda c: list_sum(list_transform(range(64), lambda j: "
            f"{z}[j + 1] * ((((c * 13 + j * 7 + {epoch} * 5) % 11) - 5) / 10.0))))")


@register("classifier_eval", sql=_head(["pixels"]) + f""",
v AS (SELECT id, CAST(raw_label % 5 AS INTEGER) AS label,
             list_transform(px, lambda x: (x / 255.0 - 0.5) / 0.5) AS xn,
             (row_number() OVER (ORDER BY id) - 1) // 64 AS batch_id
      FROM pixels WHERE id % 10 = 0),
st AS (SELECT batch_id, avg(x) AS mean, stddev_samp(x) AS std FROM (SELECT batch_id, unnest(xn) AS x FROM v) GROUP BY batch_id),
z AS (SELECT v.id, v.label, v.batch_id, list_transform(v.xn, lambda x: CASE WHEN st.std > 0 THEN (x - st.mean) / st.std ELSE 0 END) AS z
      FROM v JOIN st USING (batch_id)),
ep AS (SELECT z.*, unnest(range(5)) AS epoch FROM z),
lg AS (SELECT id, label, batch_id, epoch, {_rule_logits_sql('z', 'epoch')} AS logits FROM ep),
sc AS (SELECT epoch, batch_id, label,
              ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) + list_max(logits) - logits[label + 1] AS ce,
              list_position(logits, list_max(logits)) - 1 AS pred FROM lg),
bt AS (SELECT epoch, batch_id, avg(ce) AS bm, sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS hit, count(*) AS bn
       FROM sc GROUP BY epoch, batch_id),
e AS (SELECT epoch, round(sum(bm) / greatest(count(*), 1), 6) AS loss, round(sum(hit) * 100.0 / sum(bn), 6) AS accuracy
      FROM bt GROUP BY epoch)
SELECT CAST(epoch AS INTEGER) AS epoch, loss, accuracy,
       accuracy > coalesce(max(accuracy) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS is_best
FROM e""")
def q_classifier_eval(spark, sf_dir):
    return TR.classifier_eval(spark, sf_dir)
