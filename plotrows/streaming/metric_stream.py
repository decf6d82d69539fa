"""Incremental epoch rollups over an append-only metric log.

The original appends one (metric, value) record per step to a tracker and
averages per epoch.  Here the metric log is a Parquet folder that writers
append to (``sinks.append_metrics``); a streaming query folds each new file
into per-(run, epoch, metric) state -- count, sum, min, max -- and upserts
the rollup through ``foreachBatch``.  The state is one row per (run, epoch, metric),
as large as the rollup itself; it has no watermark, so a late or resumed run's rows
always count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

METRIC_SCHEMA = T.StructType([
    T.StructField("run", T.LongType()),
    T.StructField("epoch", T.TimestampNTZType()),
    T.StructField("step", T.LongType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def epoch_rollup_stream(spark: SparkSession, log_dir: str,
                        schema: T.StructType = METRIC_SCHEMA) -> DataFrame:
    """Streaming (run, epoch, metric) -> n, sum, min, max, sample_mean."""
    src = spark.readStream.schema(schema).parquet(log_dir)
    return (src.groupBy("run", "epoch", "metric")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
                 F.min("value").alias("min_value"), F.max("value").alias("max_value"))
            .withColumn("sample_mean", F.col("total") / F.col("n")))


def start_rollup(spark: SparkSession, log_dir: str, out_dir: str, checkpoint_dir: str,
                 available_now: bool = True) -> StreamingQuery:
    """Run the rollup into an append-only Parquet table, one folder per micro-batch.

    ``update`` mode emits only the groups a batch changed; each batch writes
    them to ``out_dir/batch_id=<n>`` (overwriting that folder, so a replayed
    batch is idempotent).  ``read_rollup`` keeps the latest row per key.
    """
    rollup = epoch_rollup_stream(spark, log_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    writer = (rollup.writeStream.outputMode("update").foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_rollup(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current rollup: the row from the latest batch for each (run, epoch, metric)."""
    t = spark.read.parquet(out_dir)
    keys = ["run", "epoch", "metric"]
    vals = [c for c in t.columns if c not in keys + ["batch_id"]]
    latest = t.groupBy(*keys).agg(F.max_by(F.struct(*vals), "batch_id").alias("r"))
    return latest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in vals])
