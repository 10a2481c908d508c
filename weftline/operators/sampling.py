"""Sessions and rows picked for a model, and the scales of its features and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.windows import average_rank, clip, day
from weftline.sources.panel import calendar


def latest_sessions(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the n latest sessions."""
    last = panel.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n)
    return panel.join(last, "trade_date", "left_semi")


def even_sessions(panel: DataFrame, keep: int) -> DataFrame:
    """Rows of `keep` sessions spread evenly from the first to the last: place floor(i * (n - 1) / (keep - 1)); all of them where there aren't more, the first one for keep = 1."""
    if keep <= 0:
        return panel.limit(0)
    days = calendar(panel).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    steps = max(keep - 1, 1)
    # The last i with floor(i * (n - 1) / steps) <= place, and whether it lands on the place itself.
    i = F.floor(F.try_divide((F.col("market_session_index") + 1) * steps - 1, F.col("_n") - 1))
    lands = F.floor(F.least(i, F.lit(keep - 1)) * (F.col("_n") - 1) / steps) == F.col("market_session_index")
    picked = days.filter((F.col("_n") <= keep) | (F.col("market_session_index") == 0) | ((F.lit(keep) > 1) & lands))
    return panel.join(picked.select("trade_date"), "trade_date", "left_semi")


def clipped_zscores(panel: DataFrame, columns: list[str], bound: float | None = 3.0) -> DataFrame:
    """Columns replaced by their session's z-scores, held within the bound."""
    for c in columns:
        z = (F.col(c) - F.avg(c).over(day())) / (F.stddev_samp(c).over(day()) + 1e-12)
        panel = panel.withColumn(c, z if bound is None else clip(z, F.lit(-abs(bound)), F.lit(abs(bound))))
    return panel


def centred_rank(panel: DataFrame, column: str, name: str, missing: float | None = None) -> DataFrame:
    """Add average rank / (rows of the session + 1) - 0.5; `missing` in place of null."""
    ranked = average_rank(F.col(column)) / (F.count(F.lit(1)).over(day()) + 1) - 0.5
    return panel.withColumn(name, ranked if missing is None else F.coalesce(ranked, F.lit(missing)))


def common_sessions(series: DataFrame, by: str, when: str = "trade_date") -> DataFrame:
    """Rows of the sessions that every series has."""
    series_count = series.select(by).distinct().agg(F.count(F.lit(1)).alias("_all"))
    held = series.select(by, when).distinct().groupBy(when).agg(F.count(F.lit(1)).alias("_has"))
    shared = held.join(series_count, F.col("_has") == F.col("_all")).select(when)
    return series.join(shared, when, "left_semi")
