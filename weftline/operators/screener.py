"""Screener: the k best and worst entities of one session by a weighted sum of factor ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.catalog import ROOT_YEAR
from weftline.functions.windows import average_rank, day, history
from weftline.plans.compiler import factors
from weftline.sources.panel import finite


def execution_inputs(panel: DataFrame, window: int = 20) -> DataFrame:
    """Add prev_close, adv_prev (mean volume of the rows before), atr_pct (mean true range over close) and vol_prev (annual deviation of the returns before)."""
    before, recent = history().rowsBetween(-window, -1), history().rowsBetween(-(window - 1), 0)
    close = F.lag("close").over(history())
    panel = panel.withColumn("prev_close", close).withColumn("ret_1", F.try_divide("close", "prev_close") - 1)
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close")))
    panel = panel.withColumn("true_range", reach).withColumn("adv_prev", F.avg("vol").over(before))
    atr = F.when(F.count("true_range").over(recent) >= max(2, window // 2), F.avg("true_range").over(recent))
    vol = F.when(F.count("ret_1").over(before) >= 5, F.stddev_samp("ret_1").over(before) * ROOT_YEAR)
    return panel.withColumn("atr_pct", F.try_divide(atr, F.abs("close"))).withColumn("vol_prev", vol)


def screen(panel: DataFrame, terms: list[tuple[str, float, int]], as_of: str, k: int = 10, side: str = "both", universe: int | None = None) -> DataFrame:
    """ts_code, side, place, score and rank_1.. of the chosen entities on the last session at or before as_of.

    terms: (expression, weight, direction). Ranks are taken over the whole market before rows with a missing factor go; the universe filter comes
    after the ranks. Of `both` sides the top has (k + 1) // 2 and the bottom, which never repeats the top, the rest.
    """
    panel = panel.filter(F.col("trade_date") <= F.lit(as_of).cast("date"))
    names = [f"factor_{i}" for i in range(1, len(terms) + 1)]
    wide = factors(panel, {n: text for n, (text, _, _) in zip(names, terms, strict=True)})
    last = wide.agg(F.max("trade_date").alias("trade_date"))
    wide = wide.join(F.broadcast(last), "trade_date")
    for i, (n, (_, _, direction)) in enumerate(zip(names, terms, strict=True), 1):
        x = F.when(finite(F.col(n)), F.col(n) * (1 if direction >= 0 else -1))
        wide = wide.withColumn(f"rank_{i}", average_rank(x) / F.count(x).over(day()))
    whole = reduce(lambda a, b: a & b, [F.col(f"rank_{i}").isNotNull() for i in range(1, len(terms) + 1)])
    rows = wide.filter(whole)
    if universe is not None:
        rows = rows.filter(F.col("univ_rank") <= universe)
    total = sum(abs(w) for _, w, _ in terms)
    rows = rows.withColumn("score", sum(F.col(f"rank_{i}") * (w / total) for i, (_, w, _) in enumerate(terms, 1)))
    rows = rows.select("ts_code", "score", *[f"rank_{i}" for i in range(1, len(terms) + 1)])
    head = {"top": k, "bottom": 0, "both": (k + 1) // 2}[side]
    top = rows.orderBy(F.desc("score"), "ts_code").limit(head)
    bottom = rows.join(top.select("ts_code"), "ts_code", "left_anti").orderBy("score", F.desc("ts_code")).limit(k - head)
    placed = lambda df, name, order: df.withColumn("side", F.lit(name)).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # noqa: E731  at most k rows
    return placed(top, "top", [F.desc("score"), F.col("ts_code")]).unionByName(placed(bottom, "bottom", [F.col("score"), F.desc("ts_code")]))
