"""Statistics of return series: one row per period, groups in a column, all as aggregates and windows."""

from __future__ import annotations

from math import sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def growth(r: Column) -> Column:
    """Log of a period's growth, floored so that a total loss stays finite."""
    return F.log(F.greatest(F.lit(1e-9), 1 + r))


def with_nav(series: DataFrame, by: str, when: str = "trade_date", r: str = "ret") -> DataFrame:
    """Add nav, peak (at least 1) and drawdown."""
    past = Window.partitionBy(by).orderBy(when).rowsBetween(Window.unboundedPreceding, 0)
    series = series.withColumn("nav", F.exp(F.sum(growth(F.col(r))).over(past)))
    return series.withColumn("peak", F.greatest(F.lit(1.0), F.max("nav").over(past))).withColumn("drawdown", 1 - F.col("nav") / F.col("peak"))


def series_stats(series: DataFrame, by: str, periods_a_year: float, when: str = "trade_date", r: str = "ret") -> DataFrame:
    """n, final_nav, annual return and volatility, sharpe, sortino, max_drawdown, calmar, win_rate, mean of the worst 5 %."""
    x = F.col(r)
    order = Window.partitionBy(by).orderBy(x, when)
    rows = with_nav(series.filter(x.isNotNull()), by, when, r).withColumn("place", F.row_number().over(order)).withColumn("n_all", F.count(F.lit(1)).over(Window.partitionBy(by)))
    worst = F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n_all") * 0.05))
    found = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.exp(F.sum(growth(x))).alias("final_nav"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2.0)))).alias("downside"),
        F.max("drawdown").alias("max_drawdown"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(worst, x)).alias("tail_mean"),
    )
    year = periods_a_year
    return (
        found.withColumn("annual_return", F.pow("final_nav", F.lit(year) / F.col("n")) - 1)
        .withColumn("annual_volatility", F.col("std") * sqrt(year))
        .withColumn("sharpe", F.try_divide("mean", "std") * sqrt(year))
        .withColumn("sortino", F.try_divide("mean", "downside") * sqrt(year))
        .withColumn("calmar", F.try_divide("annual_return", "max_drawdown"))
        .drop("mean", "std", "downside")
    )


def newey_west(series: DataFrame, by: str, lags: int, when: str = "trade_date", r: str = "ret", least: int = 30) -> DataFrame:
    """Mean with Bartlett-weighted long-run error: n, mean, se, t, p (two-sided). Groups with fewer than `least` periods have no error; without any error t is 0."""
    x = F.col(r)
    order = Window.partitionBy(by).orderBy(when)
    rows = series.filter(x.isNotNull()).withColumn("dev", x - F.avg(x).over(Window.partitionBy(by)))
    for k in range(1, lags + 1):
        rows = rows.withColumn(f"p{k}", F.col("dev") * F.lag("dev", k).over(order))
    found = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.sum(F.col("dev") * F.col("dev")).alias("s0"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(1, lags + 1)])
    long_run = F.col("s0") + sum([2 * (1 - k / (lags + 1)) * F.col(f"s{k}") for k in range(1, lags + 1)], F.lit(0.0))
    se = F.when(F.col("n") >= least, F.sqrt(F.greatest(long_run, F.lit(0.0))) / F.col("n"))
    t = F.when(F.col("se") > 1e-15, F.col("mean") / F.col("se")).when(F.col("se").isNotNull(), 0.0)
    return found.withColumn("se", se).withColumn("t", t).select(by, "n", "mean", "se", "t", (2 * (1 - normal_cdf(F.abs("t")))).alias("p"))


def confidence_bounds(series: DataFrame, by: str, lags: int, confidence: float = 0.95, **more) -> DataFrame:
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    found = newey_west(series, by, lags, **more)
    return found.withColumn("lower", F.col("mean") - z * F.col("se")).withColumn("upper", F.col("mean") + z * F.col("se"))


def moments(series: DataFrame, by: str, r: str = "ret") -> DataFrame:
    """n, sharpe of a period, skew and (raw) kurtosis from centred sums."""
    x = F.col(r)
    rows = series.filter(x.isNotNull()).withColumn("dev", x - F.avg(x).over(Window.partitionBy(by)))
    d = F.col("dev")
    found = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.sum(d * d).alias("m2"), F.sum(d * d * d).alias("m3"), F.sum(d * d * d * d).alias("m4"))
    var = F.col("m2") / F.col("n")
    return found.select(by, "n", F.try_divide("mean", F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("sharpe"), F.try_divide(F.col("m3") / F.col("n"), F.pow(var, F.lit(1.5))).alias("skew"), F.try_divide(F.col("m4") / F.col("n"), var * var).alias("kurtosis"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by the error function's rational approximation (absolute error below 1.5e-7), as a column expression."""
    x = F.abs(z) / sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)


def probabilistic_sharpe(series: DataFrame, by: str, benchmark: float = 0.0, r: str = "ret") -> DataFrame:
    """Probability that the true Sharpe ratio is above the benchmark, given skew and kurtosis."""
    m = moments(series, by, r)
    s = F.col("sharpe")
    spread = F.sqrt(F.greatest(1 - F.col("skew") * s + (F.col("kurtosis") - 1) / 4 * s * s, F.lit(1e-12)))
    return m.withColumn("psr", normal_cdf((s - benchmark) * F.sqrt(F.col("n") - 1) / spread))


def market_model(series: DataFrame, by: str, r: str = "ret", market: str = "market") -> DataFrame:
    """beta, correlation and alpha against a market series; null where the market doesn't vary."""
    a, b = F.col(r), F.col(market)
    rows = series.filter(a.isNotNull() & b.isNotNull())
    found = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("cov"), F.var_pop(b).alias("var"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"))
    found = found.withColumn("beta", F.try_divide("cov", "var")).withColumn("correlation", F.try_divide("cov", F.col("sa") * F.col("sb")))
    return found.withColumn("alpha", F.col("ma") - F.col("beta") * F.col("mb")).select(by, "n", "beta", "correlation", "alpha")


def benjamini_hochberg(tests: DataFrame, p: str = "p", key: str = "id") -> DataFrame:
    """Add q: the smallest false discovery rate at which a test is found. Tests are factors, a few thousand rows."""
    order = Window.orderBy(F.col(p).asc_nulls_last(), key)
    rows = tests.withColumn("place", F.row_number().over(order))
    n = F.count(p).over(Window.partitionBy(F.lit(1)))
    raw = F.when(F.col(p).isNotNull(), F.col(p) * n / F.col("place"))
    return rows.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(raw).over(order.rowsBetween(0, Window.unboundedFollowing))))).drop("place")


def monthly(series: DataFrame, by: str, when: str = "trade_date", r: str = "ret") -> DataFrame:
    """Compounded return by month."""
    return series.groupBy(by, F.date_trunc("month", F.col(when)).cast("date").alias("month")).agg((F.exp(F.sum(growth(F.col(r)))) - 1).alias("ret"), F.count(F.lit(1)).alias("n"))


def rolling_months(series: DataFrame, by: str, months: int, least: int, when: str = "trade_date", r: str = "ret") -> DataFrame:
    """At each group's month ends: compounded return and Sharpe of the `months` months before, where they hold `least` periods.

    Each row is sent to the month ends that it counts for, so the join is an equality and a row is copied `months` times at most.
    """
    rows = series.withColumn("month", F.date_trunc("month", F.col(when)).cast("date"))
    ends = rows.groupBy(by, "month").agg(F.max(when).alias("month_end"))
    sent = rows.select(by, F.col(when).alias("day"), F.col(r).alias("x"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(months)), lambda k: F.add_months(F.col("month"), k))).alias("month"))
    joined = sent.join(ends, [by, "month"]).filter((F.col("day") <= F.col("month_end")) & (F.col("day") > F.add_months("month_end", -months)))
    found = joined.groupBy(by, "month_end").agg(F.count(F.lit(1)).alias("n"), (F.exp(F.sum(growth(F.col("x")))) - 1).alias("ret"), F.try_divide(F.avg("x"), F.stddev_samp("x")).alias("sharpe"))
    return found.filter(F.col("n") >= least)


def volatility_target(series: DataFrame, by: str, target: float, window: int = 60, low: float = 0.25, high: float = 1.5, when: str = "trade_date", r: str = "ret") -> DataFrame:
    """Add scale, the exposure for a volatility target from the `window` periods before the current one (1 while there are fewer), and scaled."""
    past = Window.partitionBy(by).orderBy(when)
    vol = F.when(F.count(r).over(past.rowsBetween(-(window - 1), 0)) == window, F.stddev_samp(r).over(past.rowsBetween(-(window - 1), 0)) * sqrt(252))
    scale = F.coalesce(F.least(F.greatest(F.try_divide(F.lit(target), vol), F.lit(low)), F.lit(high)), F.lit(1.0))
    return series.withColumn("own_scale", scale).withColumn("scale", F.lag("own_scale", 1, 1.0).over(past)).withColumn("scaled", F.col(r) * F.col("scale")).drop("own_scale")


def regime(series: DataFrame, by: str, window: int = 60, when: str = "trade_date", r: str = "ret") -> DataFrame:
    """Add on: whether the compounded return of the `window` periods before was positive (1 while there are fewer)."""
    past = Window.partitionBy(by).orderBy(when)
    last = past.rowsBetween(-(window - 1), 0)
    state = F.when(F.count(r).over(last) == window, (F.sum(growth(F.col(r))).over(last) > 0).cast("int")).otherwise(1)
    return series.withColumn("own_state", state).withColumn("on", F.lag("own_state", 1, 1).over(past)).drop("own_state")


def rolling_sharpe(series: DataFrame, by: str, window: int = 252, when: str = "trade_date", r: str = "ret") -> DataFrame:
    """q10, median, q90 and share of positive values of the annual Sharpe ratio of every full window, by series; 0 for a series without any."""
    last = Window.partitionBy(by).orderBy(when).rowsBetween(-(window - 1), 0)
    spread = F.stddev_samp(r).over(last)
    rows = series.filter(F.col(r).isNotNull()).withColumn("_s", F.when((F.count(F.lit(1)).over(last) == window) & (spread > 1e-15), F.avg(r).over(last) / spread * sqrt(252)))
    found = rows.groupBy(by).agg(F.count("_s").alias("n"), *[F.percentile("_s", q).alias(name) for name, q in (("q10", 0.1), ("median", 0.5), ("q90", 0.9))], F.avg((F.col("_s") > 0).cast("double")).alias("positive"))
    return found.fillna(0.0, ["q10", "median", "q90", "positive"])


def path_returns(navs: DataFrame, by: str, when: str = "trade_date", nav: str = "nav") -> DataFrame:
    """Add ret: the return that a net asset value shows since the one before; before the first it was 1."""
    return navs.withColumn("ret", F.col(nav) / F.lag(nav, 1, 1.0).over(Window.partitionBy(by).orderBy(when)) - 1)


def walk_forward(series: DataFrame, folds: list[tuple[str, str, str, str, str]], value: str, when: str = "trade_date") -> DataFrame:
    """fold, part (train or valid), n, mean, std, positive of a value by session. folds: (name, train start, train end, valid start, valid end); a session counts in every part that holds it."""
    parts = [(name, part, a, b) for name, t0, t1, v0, v1 in folds for part, a, b in (("train", t0, t1), ("valid", v0, v1))]
    held = F.array(*[F.when(F.col(when).between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.struct(F.lit(name).alias("fold"), F.lit(part).alias("part"))) for name, part, a, b in parts])
    rows = series.filter(F.col(value).isNotNull()).select(value, F.explode(F.array_compact(held)).alias("_at"))
    x = F.col(value)
    return rows.groupBy("_at.fold", "_at.part").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg((x > 0).cast("double")).alias("positive"))
