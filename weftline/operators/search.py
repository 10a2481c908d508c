"""Weight search, allocation and overfitting measures."""

from __future__ import annotations

from itertools import combinations
from math import e, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.windows import average_rank, day, safe_corr


def simplex(n: int, steps: int) -> list[tuple[float, ...]]:
    """All non-negative weights in multiples of 1 / steps that add up to 1."""
    return [tuple((b - a - 1) / steps for a, b in zip((-1, *bars), (*bars, steps + n - 1), strict=True)) for bars in combinations(range(steps + n - 1), n - 1)]


def weight_scores(spark: SparkSession, rows: DataFrame, components: list[str], label: str, steps: int = 4) -> DataFrame:
    """candidate, weights, mean_ic, ir of every weighting of component ranks. rows: trade_date, ts_code, components, label.

    Candidates are columns of one pass (a few hundred at most), so the panel is read and ranked once and no row is copied for a candidate.
    """
    grid = simplex(len(components), steps)
    for c in components:
        rows = rows.withColumn(f"r_{c}", average_rank(F.col(c)) / F.count(c).over(day()))
    scores = [sum(F.col(f"r_{c}") * w for c, w in zip(components, weights, strict=True)) for weights in grid]
    daily = rows.groupBy("trade_date").agg(*[safe_corr(s, F.col(label)).alias(f"c{i}") for i, s in enumerate(scores)])
    long = daily.select(F.explode(F.array(*[F.struct(F.lit(i).alias("candidate"), F.array(*[F.lit(w) for w in weights]).alias("weights"), F.col(f"c{i}").alias("ic")) for i, weights in enumerate(grid)])).alias("x")).select("x.*")
    return long.groupBy("candidate", "weights").agg(F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("ir"), F.count("ic").alias("n"))


def covariance(series: DataFrame, name: str, when: str, r: str) -> DataFrame:
    """a, b, cov, n over common periods for each pair of names with a <= b; names are a portfolio's, a hundred at most."""
    left, right = (series.select(F.col(name).alias(x), F.col(when).alias("_t"), F.col(r).alias(f"_{x}")) for x in ("a", "b"))
    return left.join(right, "_t").filter("a <= b").groupBy("a", "b").agg(F.covar_samp("_a", "_b").alias("cov"), F.count(F.lit(1)).alias("n"))


def rolling_correlation(series: DataFrame, name: str, when: str, r: str, window: int, least: int) -> DataFrame:
    """a, b, when, n, correlation of each pair of names with a < b over the last `window` common periods, null below `least` of them or without spread; names are a portfolio's sleeves.

    A period's values are gathered by period (a value a sleeve) and paired there, so no series is joined with another.
    """
    days = series.groupBy(when).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(r).alias("r")))).alias("_s"))
    paired = days.select(when, F.posexplode("_s").alias("_i", "_a"), "_s").select(when, "_a", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("_b"))
    rows = paired.select(F.col("_a.n").alias("a"), F.col("_b.n").alias("b"), when, F.col("_a.r").alias("_x"), F.col("_b.r").alias("_y")).filter("_x is not null and _y is not null")
    last = Window.partitionBy("a", "b").orderBy(when).rowsBetween(-(window - 1), 0)
    n = F.count(F.lit(1)).over(last)
    return rows.withColumn("n", n).withColumn("correlation", F.when(n >= least, safe_corr(F.col("_x"), F.col("_y"), last))).drop("_x", "_y")


def risk_budget(cov: pd.DataFrame, shrink: float = 0.2, cap: float = 0.25, rounds: int = 200) -> dict:
    """Weights that carry equal risk under a covariance shrunk to its diagonal, by cyclic coordinate descent, capped; from covariance()'s collected rows."""
    names = sorted({*cov["a"], *cov["b"]})
    at = {n: i for i, n in enumerate(names)}
    s = np.zeros((len(names), len(names)))
    for a, b, c in zip(cov["a"], cov["b"], cov["cov"], strict=True):
        s[at[a], at[b]] = s[at[b], at[a]] = c
    s = (1 - shrink) * s + shrink * np.diag(np.diag(s))
    x = 1 / np.sqrt(np.diag(s))
    for _ in range(rounds):
        for i in range(len(x)):
            rest = s[i] @ x - s[i, i] * x[i]
            x[i] = (-rest + sqrt(rest * rest + 4 * s[i, i] / len(x))) / (2 * s[i, i])
    w = x / x.sum()
    for _ in range(len(w)):
        if (over := w > cap + 1e-12).any() and cap * len(w) > 1:
            free = ~over & (w < cap)
            spare = (w[over] - cap).sum()
            w[over] = cap
            w[free] += spare * w[free] / w[free].sum()
    return dict(zip(names, w.tolist(), strict=True))


def block_bootstrap(spark: SparkSession, series: list[float], paths: int, block: int, seed: int) -> DataFrame:
    """path, total: compounded return of circular moving-block resamples. Each path has its own seed, so the result doesn't depend on partitions."""
    data, n = np.array(series), len(series)

    def run(batches):
        for batch in batches:
            out = []
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                starts = rng.integers(0, n, -(-n // block))
                at = (starts[:, None] + np.arange(block)).ravel()[:n] % n
                out.append((int(i), float(np.prod(1 + data[at]) - 1)))
            yield pd.DataFrame(out, columns=["path", "total"])

    return spark.range(paths).mapInPandas(run, "path long, total double")


def overfit_probability(matrix: DataFrame, trial: str, when: str, r: str, blocks: int = 8) -> DataFrame:
    """splits, below: of all halvings of the periods into blocks, the share where the best trial in one half is below the median in the other.

    Block sums are one aggregate; the halvings (70 for 8 blocks) join them by block.
    """
    order = Window.partitionBy(trial).orderBy(when)
    placed = matrix.withColumn("block", F.floor((F.row_number().over(order) - 1) * blocks / F.count(F.lit(1)).over(Window.partitionBy(trial))).cast("int"))
    sums = placed.groupBy(trial, "block").agg(F.sum(r).alias("s"), F.sum(F.col(r) * F.col(r)).alias("q"), F.count(F.lit(1)).alias("n"))
    spark = matrix.sparkSession
    halves = spark.createDataFrame([(k, b, b in half) for k, half in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)], "split int, block int, inside boolean")
    found = sums.join(F.broadcast(halves), "block").groupBy("split", trial, "inside").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    sharpe = F.try_divide(F.col("s") / F.col("n"), F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0)), F.lit(0.0))))
    wide = found.withColumn("v", sharpe).groupBy("split", trial).agg(F.max(F.when(F.col("inside"), F.col("v"))).alias("inner_v"), F.max(F.when(~F.col("inside"), F.col("v"))).alias("outer_v"))
    split = Window.partitionBy("split")
    ranked = wide.withColumn("first", F.row_number().over(split.orderBy(F.desc_nulls_last("inner_v"), trial))).withColumn("place", F.rank().over(split.orderBy(F.asc_nulls_first("outer_v")))).withColumn("m", F.count(F.lit(1)).over(split))
    return ranked.filter("first = 1").agg(F.count(F.lit(1)).alias("splits"), F.avg((F.col("place") / (F.col("m") + 1) <= 0.5).cast("double")).alias("below"))


def expected_best_sharpe(trials: int, variance: float) -> float:
    """Expected largest Sharpe ratio of that many trials without skill."""
    if trials < 2:
        return 0.0
    z, euler = NormalDist().inv_cdf, 0.5772156649015329
    return sqrt(variance) * ((1 - euler) * z(1 - 1 / trials) + euler * z(1 - 1 / (trials * e)))


def effective_trials(pairs: DataFrame, names: int, correlation: str = "correlation") -> DataFrame:
    """One row, trials and effective: the participation ratio of a correlation matrix's eigenvalues, from the correlations of its pairs. Eigenvalues sum to the number of names, and their squares to the sum of all squared entries."""
    squares = names + 2 * F.coalesce(F.sum(F.col(correlation) * F.col(correlation)), F.lit(0.0))
    return pairs.agg(F.lit(names).alias("trials"), (F.lit(float(names)) * names / squares).alias("effective"))


def information(rows: DataFrame, by: str, name: str) -> DataFrame:
    """by, n, names, entropy (in nats), effective (its exponential): how evenly a group's rows are spread over names."""
    counts = rows.groupBy(by, name).agg(F.count(F.lit(1)).alias("_c"))
    found = counts.groupBy(by).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("names"), F.sum(F.col("_c") * F.log("_c")).alias("_s"))
    return found.withColumn("entropy", F.log("n") - F.col("_s") / F.col("n")).withColumn("effective", F.exp("entropy")).drop("_s")
