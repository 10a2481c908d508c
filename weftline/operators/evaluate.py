"""Cross-sectional evaluation of a factor: information coefficients, quantiles, legs, turnover, and what sums them up."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.windows import average_rank, day, history, safe_corr
from weftline.sources.panel import LAYERS, calendar, finite, purged

#: Least standard deviation of a session's factor, as a share of its mean size plus one (fixed value).
LEAST_SPREAD = 1e-10


def evaluation_rows(panel: DataFrame, horizon: int, universe: int | None = None, embargo: int = 5, direction: int = 1) -> DataFrame:
    """Rows with a finite factor and label that pass purge and embargo, every horizon-th session of a layer, with pct (factor's rank share), label_rank and eligible_n (rows of the session with a factor).

    A session on which the factor hardly varies has no ranks and is left out. Needs with_universe, with_labels and a column `factor`. Sessions count by the layer's calendar, so a factor's gaps don't shift the sample.
    """
    rows = purged(panel, horizon, embargo, LAYERS)
    seq = Window.partitionBy("layer").orderBy("trade_date")
    sessions = panel.filter(F.col("layer") != "NONE").select("layer", "trade_date").distinct().withColumn("seq", F.row_number().over(seq))
    rows = rows.join(sessions, ["layer", "trade_date"]).filter((F.col("seq") - 1) % horizon == 0)
    if universe is not None:
        rows = rows.filter(F.col("univ_rank") <= universe)
    rows = rows.withColumn("factor", F.col("factor") * direction).withColumnRenamed(f"fwd_{horizon}", "label").filter(finite(F.col("factor")))
    rows = rows.withColumn("_spread", F.stddev_samp("factor").over(day())).withColumn("_level", F.avg(F.abs("factor")).over(day())).withColumn("eligible_n", F.count(F.lit(1)).over(day()))
    rows = rows.filter((F.col("_spread") > (F.col("_level") + 1) * LEAST_SPREAD) & finite(F.col("label"))).drop("_spread", "_level")
    return rows.withColumn("n_day", F.count(F.lit(1)).over(day())).withColumn("pct", average_rank(F.col("factor")) / F.col("n_day")).withColumn("label_rank", average_rank(F.col("label")))


def with_deciles(rows: DataFrame, bins: int = 10) -> DataFrame:
    """decile = ceil(pct * bins), from 1 to bins."""
    return rows.withColumn("decile", F.least(F.greatest(F.ceil(F.col("pct") * bins), F.lit(1)), F.lit(bins)).cast("int"))


def decile_table(rows: DataFrame) -> DataFrame:
    return with_deciles(rows).groupBy("layer", "decile").agg(F.avg("label").alias("mean_return"), F.count(F.lit(1)).alias("n"))


def daily_ic(rows: DataFrame, least: int = 50) -> DataFrame:
    """ic and rank_ic by layer and session with at least `least` rows; null where a side doesn't vary."""
    return (
        rows.groupBy("layer", "trade_date").agg(safe_corr(F.col("factor"), F.col("label")).alias("ic"), safe_corr(F.col("pct"), F.col("label_rank")).alias("rank_ic"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    )


def ic_summary(ics: DataFrame, horizon: int, by: str = "layer", column: str = "rank_ic") -> DataFrame:
    """mean, std, annual ICIR and share of positive sessions."""
    c = F.col(column)
    return ics.groupBy(by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.avg((c > 0).cast("double")).alias("positive")).withColumn("icir", F.try_divide("mean", "std") * sqrt(252 / horizon))


def legs(rows: DataFrame, fraction: float = 0.2, short: bool = True) -> DataFrame:
    """Add weight: +1/n for the top fraction by pct, -1/n for the bottom one if short, 0 between; n counts the leg on its day."""
    long_leg, short_leg = F.col("pct") >= 1 - fraction, (F.col("pct") <= fraction) if short else F.lit(False)
    size = lambda leg: F.sum(leg.cast("double")).over(day())
    return rows.withColumn("weight", F.when(long_leg, 1.0 / size(long_leg)).when(short_leg, -1.0 / size(short_leg)).otherwise(0.0))


def daily_portfolio(rows: DataFrame, horizon: int) -> DataFrame:
    """gross return and turnover by layer and session. An entity's earlier weight counts only if it is of the session `horizon` earlier; weights that left the rows count as sold."""
    by_entity = Window.partitionBy("layer", "ts_code").orderBy("trade_date")
    rows = rows.withColumn("old", F.when(F.lag("seq").over(by_entity) == F.col("seq") - horizon, F.lag("weight").over(by_entity)).otherwise(0.0))
    daily = rows.groupBy("layer", "trade_date", "seq").agg(
        F.sum(F.col("weight") * F.col("label")).alias("gross"), F.sum(F.abs("weight")).alias("exposure"), F.sum(F.abs(F.col("weight") - F.col("old"))).alias("changed"), F.sum(F.abs("old")).alias("matched"), F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy("layer").orderBy("trade_date")
    left = F.coalesce(F.lag("exposure").over(before), F.lit(0.0)) - F.col("matched")
    return daily.withColumn("turnover", F.col("changed") + F.greatest(left, F.lit(0.0))).select("layer", "trade_date", "n", "gross", "turnover")


def nearest(x: Column, q: float, *by: str) -> Column:
    """The value of x at place round(q * (n - 1)) of its group's order, on that row alone (null on others)."""
    group = Window.partitionBy(*by)
    place = F.row_number().over(group.orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull() & (place == F.round((F.count(x).over(group) - 1) * q).cast("int") + 1), x)


def daily_evaluation(rows: DataFrame, horizon: int, short: bool = True, capital: float = 1e6, least: int = 50) -> DataFrame:
    """By layer and session with `least` rows or more: ic, rank_ic, n, eligible_n, coverage, benchmark, long, short and gross return, turnover, participation.

    participation is the larger of two shares of a day's amount for the capital: the 95 % quantile over the rows' weight changes, and what sold-out weights need at the
    5 % quantile of amounts (quantiles take the nearest value). Needs legs(); rows have amount, label_entry_date and label_exit_date_<horizon>.
    """
    by_entity = Window.partitionBy("layer", "ts_code").orderBy("trade_date")
    rows = rows.withColumn("old", F.when(F.lag("seq").over(by_entity) == F.col("seq") - horizon, F.lag("weight").over(by_entity)).otherwise(0.0))
    paid = F.when(F.col("amount") > 0, F.abs(F.col("weight") - F.col("old")) * capital / F.col("amount"))
    rows = rows.withColumn("_paid", paid).withColumn("_p95", nearest(F.col("_paid"), 0.95, "layer", "trade_date")).withColumn("_p05", nearest(F.col("amount"), 0.05, "layer", "trade_date"))
    w, label = F.col("weight"), F.col("label")
    daily = rows.groupBy("layer", "trade_date").agg(
        safe_corr(F.col("factor"), label).alias("ic"), safe_corr(F.col("pct"), F.col("label_rank")).alias("rank_ic"), F.count(F.lit(1)).alias("n"), F.max("eligible_n").alias("eligible_n"),
        F.min("label_entry_date").alias("entry"), F.max(f"label_exit_date_{horizon}").alias("exit"), F.avg(label).alias("benchmark"),
        F.coalesce(F.sum(F.when(w > 0, w * label)), F.lit(0.0)).alias("long_return"), F.coalesce(F.sum(F.when(w < 0, -w * label)), F.lit(0.0)).alias("short_return"),
        F.sum(F.abs(w)).alias("_exposure"), F.sum(F.abs(w - F.col("old"))).alias("_changed"), F.sum(F.abs("old")).alias("_matched"), F.sum((w != 0).cast("long")).alias("_held"), F.max("_p95").alias("_p95"), F.max("_p05").alias("_p05"),
    )
    before = Window.partitionBy("layer").orderBy("trade_date")
    sold = F.greatest(F.coalesce(F.lag("_exposure").over(before), F.lit(0.0)) - F.col("_matched"), F.lit(0.0))
    daily = daily.withColumn("_sold", sold).withColumn("turnover", F.col("_changed") + F.col("_sold"))
    leaving = F.col("_sold") * capital / (F.greatest(F.col("_held"), F.lit(1)) * F.when(F.col("_p05") > 0, F.col("_p05")))
    daily = daily.withColumn("participation", F.greatest(F.coalesce("_p95", F.lit(0.0)), F.coalesce(leaving, F.lit(0.0)))).withColumn("coverage", F.col("n") / F.col("eligible_n"))
    gross = F.col("long_return") - F.col("short_return") if short else F.col("long_return")
    return daily.withColumn("gross", gross).withColumn("era", F.year("trade_date")).filter(F.col("n") >= least).drop("_exposure", "_changed", "_matched", "_held", "_p95", "_p05", "_sold")


def layer_metrics(daily: DataFrame, horizon: int, costs: tuple[float, ...] = (0.0, 5.0, 15.0), by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """A row for each group of daily_evaluation (by layer, or layer and era) and cost in basis points: sessions, IC, its ratio and share of positive sessions, coverage, turnover, participation, and the net return's mean, Sharpe ratio and drawdown."""
    net = daily.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs]))).withColumn("net", F.col("gross") - F.col("turnover") * F.col("cost_bps") / 10000)
    past = Window.partitionBy(*by, "cost_bps").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    net = net.withColumn("_nav", F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 + F.col("net")))).over(past)))
    net = net.withColumn("_down", 1 - F.col("_nav") / F.greatest(F.lit(1.0), F.max("_nav").over(past)))
    year = 252 / horizon
    return net.groupBy(*by, "cost_bps").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rank_ic").alias("ic"), (F.try_divide(F.avg("rank_ic"), F.stddev_samp("rank_ic")) * sqrt(year)).alias("icir"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive"),
        F.avg("coverage").alias("coverage"), F.avg("turnover").alias("turnover"), F.max("participation").alias("participation"), (F.avg("net") * year).alias("annual_net"),
        (F.try_divide(F.avg("net"), F.stddev_samp("net")) * sqrt(year)).alias("sharpe"), F.max("_down").alias("max_drawdown"),
    )


def hashed(text: Column, modulus: int) -> Column:
    """A number below modulus from the text's MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % modulus


def signal_sketch(rows: DataFrame, buckets: int = 32) -> DataFrame:
    """Mean centred rank by layer and hashed bucket of (entity, session): a short signature of a factor's signal."""
    bucket = hashed(F.concat_ws("/", F.col("ts_code").cast("string"), F.col("trade_date").cast("string")), buckets).cast("int")
    return rows.groupBy("layer", bucket.alias("bucket")).agg(F.avg(F.col("pct") - 0.5).alias("signal"), F.count(F.lit(1)).alias("n"))


def preflight(panel: DataFrame) -> DataFrame:
    """By session: rows, finite factors, distinct ones, spread; the first look at a factor."""
    x = F.when(finite(F.col("factor")), F.col("factor"))
    return panel.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.count(x).alias("n_finite"), F.count_distinct(x).alias("n_distinct"), F.stddev_samp(x).alias("std"), F.avg(F.abs(x)).alias("mean_abs"))


def preflight_decision(daily: DataFrame, coverage: float = 0.02, sessions: int = 8, distinct: int = 3) -> DataFrame:
    """One row: coverage, usable sessions, and whether the factor is worth a full evaluation."""
    usable = (F.col("n_distinct") >= distinct) & (F.col("std") > F.greatest(F.lit(1e-10), F.col("mean_abs") * 1e-10))
    found = daily.agg(F.try_divide(F.sum("n_finite").cast("double"), F.sum("n")).alias("coverage"), F.sum(usable.cast("long")).alias("usable"))
    return found.withColumn("passes", (F.col("coverage") >= coverage) & (F.col("usable") >= sessions))


def sampled_entities(panel: DataFrame, modulus: int) -> DataFrame:
    """One entity in `modulus` by hash, with its whole history."""
    return panel.filter(hashed(F.col("ts_code").cast("string"), modulus) == 0)


def factor_correlations(panel: DataFrame, names: list[str]) -> DataFrame:
    """a, b, correlation: mean over sessions of the rank correlation of each pair of factor columns."""
    for n in names:
        panel = panel.withColumn(f"r_{n}", average_rank(F.col(n)))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    daily = panel.groupBy("trade_date").agg(*[safe_corr(F.col(f"r_{a}"), F.col(f"r_{b}")).alias(f"{a}|{b}") for a, b in pairs])
    long = daily.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("c")) for a, b in pairs])).alias("x"))
    return long.groupBy("x.a", "x.b").agg(F.avg("x.c").alias("correlation"), F.count("x.c").alias("n"))


def previous_close(panel: DataFrame) -> DataFrame:
    """Each entity's last known close on every session of the market (carried forward over its pauses; null before its first).

    Each row is copied to the sessions up to the entity's next row, so the rows that come out are made from their own source.
    """
    at = F.col("market_session_index")
    sessions = calendar(panel)
    own = panel.select("ts_code", "trade_date", "close").join(sessions, "trade_date").withColumn("close", F.last("close", ignorenulls=True).over(history().rowsBetween(Window.unboundedPreceding, 0)))
    until = F.coalesce(F.lead(at).over(history()), F.lit(sessions.count()))
    own = own.withColumn("_until", F.greatest(at, until - 1)).withColumn("_first", F.row_number().over(history()) == 1)
    # The first row also makes the sessions before it.
    own = own.select("ts_code", "close", at.alias("_own"), F.explode(F.sequence(F.when(F.col("_first"), 0).otherwise(at), F.col("_until"))).alias("_at"))
    return own.join(sessions, F.col("_at") == at).select("ts_code", "trade_date", F.when(F.col("_at") >= F.col("_own"), F.col("close")).alias("close"))
