"""Streams: latency percentiles by time window, and daily bars kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latency(rows: DataFrame, when: str, value: str, by: list[str], width: str = "5 minutes", late: str | None = None) -> DataFrame:
    """by, start, n, p50, p95, p99 of tumbling windows. With `late`, rows of a stream that come later than that are left out and windows are closed."""
    rows = rows.withWatermark(when, late) if late else rows
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    found = rows.groupBy(F.window(when, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return found.select(*by, F.col("w.start").alias("start"), "n", *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("p50", "p95", "p99"))])


def keep_daily_bars(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Start a query that recomputes the days which new files touch and replaces their partitions; a repeated batch writes the same rows.

    Days that a batch touches are few; they prune the second read of the source.
    """

    def refresh(batch: DataFrame, _: int) -> None:
        days = batch.select(F.to_date("ts").alias("day")).distinct()
        rows = spark.read.schema(schema).parquet(source).withColumn("day", F.to_date("ts")).join(days, "day", "left_semi")
        bars = rows.groupBy("day", "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))
        bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)

    schema = spark.read.parquet(source).schema
    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
