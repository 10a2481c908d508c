"""Vector back-test: target weights at signal dates, gross returns, turnover and costs, all set-wise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.panel import finite


def money(x: Column) -> Column:
    """Rounded half-up to cents."""
    return F.round(x.cast("decimal(38,10)"), 2)


def fees_a_share(side: Column, value: Column, day: Column) -> Column:
    """Commission 0.02 %, stamp duty on sales (0.1 %, 0.05 % from 2023-08-28), transfer fee (0.002 %, 0.001 % from 2022-04-29), each rounded to cents."""
    stamp = F.when(side == "sell", value * F.when(day < F.lit("2023-08-28").cast("date"), 0.001).otherwise(0.0005)).otherwise(0.0)
    transfer = value * F.when(day < F.lit("2022-04-29").cast("date"), 0.00002).otherwise(0.00001)
    return money(value * 0.0002) + money(stamp) + money(transfer)


def fees_us(quantity: Column, value: Column) -> Column:
    """0.005 a share, at least 1 and at most 1 % of the value, rounded to cents."""
    return money(F.least(F.greatest(quantity * 0.005, F.lit(1.0)), value * 0.01))


def impact(model: str, share: Column, base: float, scale: float) -> Column:
    """Price impact as a fraction, from the order's share of volume."""
    return {"fixed": F.lit(base), "linear": base + scale * share, "square_root": base + scale * F.sqrt(F.greatest(share, F.lit(0.0)))}[model]


def signal_rows(panel: DataFrame, horizon: int, universe: int) -> DataFrame:
    """Rows of every horizon-th session of the market that are in the universe and have a finite factor."""
    sessions = panel.select("trade_date").distinct().withColumn("session", F.row_number().over(Window.orderBy("trade_date")) - 1)
    rows = panel.join(sessions, "trade_date").filter(F.col("session") % horizon == 0).withColumn("period", (F.col("session") / horizon).cast("long"))
    return rows.filter((F.col("univ_rank") <= universe) & finite(F.col("factor")))


def target_weights(rows: DataFrame, fraction: float, short: bool) -> DataFrame:
    """ts_code, trade_date, period, weight, label: equal weights of the best max(1, floor(n * fraction)) and, if short, the worst as many."""
    day = Window.partitionBy("trade_date")
    n = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(day) * fraction))
    rows = rows.withColumn("k", n).withColumn("best", F.row_number().over(day.orderBy(F.desc("factor"), "ts_code"))).withColumn("worst", F.row_number().over(day.orderBy(F.asc("factor"), F.desc("ts_code"))))
    weight = F.when(F.col("best") <= F.col("k"), 1.0 / F.col("k"))
    if short:
        weight = weight.when(F.col("worst") <= F.col("k"), -1.0 / F.col("k"))
    return rows.withColumn("weight", weight).filter("weight is not null").select("ts_code", "trade_date", "period", "weight", "label")


def period_returns(weights: DataFrame) -> DataFrame:
    """trade_date, period, gross, turnover (sum of absolute changes against the period before, entries and exits included), n. Missing labels earn nothing."""
    after = weights.select("ts_code", (F.col("period") + 1).alias("period"), F.col("weight").alias("old"))
    both = weights.select("ts_code", "period", "weight", "label").join(after, ["ts_code", "period"], "full")
    found = both.groupBy("period").agg(F.sum(F.coalesce(F.col("weight") * F.col("label"), F.lit(0.0))).alias("gross"), F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("turnover"), F.count("weight").alias("n"))
    days = weights.select("period", "trade_date").distinct()
    return found.join(days, "period")


def vector_backtest(panel: DataFrame, horizon: int, fraction: float = 0.2, universe: int = 500, short: bool = False, costs_bps: tuple[float, ...] = (0.0, 5.0, 10.0, 20.0)) -> DataFrame:
    """trade_date, cost_bps, gross, turnover, net, benchmark for each period and cost. Needs `factor`, univ_rank and fwd_h."""
    rows = signal_rows(panel, horizon, universe).withColumnRenamed(f"fwd_{horizon}", "label")
    benchmark = rows.groupBy("trade_date").agg(F.avg("label").alias("benchmark"))
    periods = period_returns(target_weights(rows, fraction, short)).join(benchmark, "trade_date", "left")
    scenarios = periods.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs_bps])))
    return scenarios.withColumn("net", F.col("gross") - F.col("turnover") * F.col("cost_bps") / 10_000).select("trade_date", "cost_bps", "n", "gross", "turnover", "net", "benchmark")


def training_direction(ics: DataFrame, layer: str = "TRAIN") -> DataFrame:
    """One row: direction -1 if the training layer's mean rank IC is negative, else 1."""
    return ics.filter(F.col("layer") == layer).agg(F.when(F.avg("rank_ic") < 0, -1).otherwise(1).alias("direction"), F.avg("rank_ic").alias("mean"))
