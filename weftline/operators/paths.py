"""Signatures of return paths, robust scaling, and summaries over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.ranges import cut, quantiles


def signature(series: DataFrame, by: str, blocks: int = 48, when: str = "trade_date", r: str = "ret") -> DataFrame:
    """block, n, mean, z of each series: means of chronological blocks of equal length, scaled within the series (null where they don't vary)."""
    own = Window.partitionBy(by)
    placed = series.withColumn("block", F.floor((F.row_number().over(own.orderBy(when)) - 1) * blocks / F.count(F.lit(1)).over(own)).cast("int"))
    means = placed.groupBy(by, "block").agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"))
    return means.withColumn("z", F.try_divide(F.col("mean") - F.avg("mean").over(own), F.stddev_pop("mean").over(own)))


def ordered_mean(series: DataFrame, by: str, name: str, when: str = "trade_date", r: str = "ret") -> DataFrame:
    """by and the mean of each series, summed in its order: however rows are dealt, equal series have equal means to the last digit."""
    so_far = Window.partitionBy(by).orderBy(when).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("_mean", F.avg(r).over(so_far)).groupBy(by).agg(F.max_by("_mean", when).alias(name))


def monthly_path(monthly: DataFrame, by: str, value: str, months: int = 24) -> DataFrame:
    """by, last (its last month), path (values of the `months` months that end there, null where there is none) and fingerprint of each series. monthly: by, month (its first day), value; a month once."""
    ends = monthly.groupBy(by).agg(F.max("month").alias("last"))
    place = F.months_between("last", "month").cast("int")
    held = monthly.join(ends, by).withColumn("_place", place).filter(F.col("_place") < months)
    found = held.groupBy(by, "last").agg(F.map_from_entries(F.collect_list(F.struct("_place", value))).alias("_m"))
    path = F.transform(F.sequence(F.lit(months - 1), F.lit(0), F.lit(-1)), lambda k: F.try_element_at("_m", k))
    text = F.array_join(F.transform(path, lambda x: F.when(x.isNotNull(), F.format_string("%.6f", x + 0.0)).otherwise("-")), "|")
    return found.select(by, "last", path.alias("path"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16).alias("fingerprint"))


def robust_scale(rows: DataFrame, column: str, bound: float = 3.0) -> DataFrame:
    """(x - median) / (1.4826 MAD), clipped; median and MAD are exact and come to the driver as two numbers."""
    rows = cut(rows)
    x = F.col(column)
    number = lambda v: F.lit(v).cast("double")
    middle = number(quantiles(rows.select(column), [], column, {"q": 0.5}).first()["q"])
    spread = number(quantiles(rows.select(F.abs(x - middle).alias("_away")), [], "_away", {"q": 0.5}).first()["q"])
    scaled = F.try_divide(x - middle, 1.4826 * spread)
    return rows.withColumn(column, F.when(scaled.isNotNull(), F.least(F.greatest(scaled, F.lit(-bound)), F.lit(bound))))


def fold_summary(folds: DataFrame, by: str, score: str) -> DataFrame:
    """folds, least, median, mean and dispersion of the fold scores of each candidate."""
    return folds.groupBy(by).agg(F.count(score).alias("folds"), F.min(score).alias("least"), F.percentile(score, F.lit(0.5)).alias("median"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("dispersion"))
