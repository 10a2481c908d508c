"""Candidates of ledger back-tests: what each configuration picks on its rebalance sessions, and the quotes that it needs."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.windows import history

__all__ = ["Run", "asdict", "candidates"]


@dataclass(frozen=True)
class Run:
    """One configuration."""

    run_id: str
    every: int = 5  # sessions between rebalances
    positions: int = 20
    universe: int = 500
    direction: int = 1


def candidates(panel: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows that runs need: a run's picks on its rebalance sessions (by the factor of the session before), and all quotes of entities it ever picks."""
    p = panel.withColumn("signal", F.lag("factor").over(history()))
    sessions = panel.select("trade_date").distinct().withColumn("session", F.row_number().over(Window.orderBy("trade_date")) - 1)
    p = p.join(sessions, "trade_date").select("ts_code", "trade_date", "session", "open", "close", "vol", "signal", "univ_rank")
    both = p.join(F.broadcast(runs))  # a row per run: runs are configurations
    rank = Window.partitionBy("run_id", "trade_date").orderBy((F.col("signal") * F.col("direction")).desc_nulls_last(), "ts_code")
    eligible = F.col("signal").isNotNull() & (F.col("univ_rank") <= F.col("universe")) & (F.col("session") % F.col("every") == 0)
    ranked = both.withColumn("eligible", eligible)
    picks = ranked.filter("eligible").withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= F.col("positions")).select("run_id", "ts_code", "trade_date", F.lit(True).alias("picked"))
    held = picks.select("run_id", "ts_code").distinct()
    quotes = ranked.join(held, ["run_id", "ts_code"], "left_semi").join(picks, ["run_id", "ts_code", "trade_date"], "left")
    return quotes.select("run_id", "trade_date", "session", "ts_code", "open", "close", "vol", F.coalesce("picked", F.lit(False)).alias("picked"))
