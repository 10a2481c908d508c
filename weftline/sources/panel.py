"""Panels: tables keyed by (ts_code, trade_date), one row per entity and session.

`load_panel` reads a hive-partitioned Parquet panel with a checked contract; `supplier_panel` and `user_panel` derive
panels from the star-schema tables. `with_universe` and `with_labels` add liquidity rank, era, layer and forward returns.
Everything is lazy; sorting is left to the windows that need an order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("ts_code", "trade_date")
#: Columns that every panel has.
REQUIRED = ("ts_code", "trade_date", "open", "high", "low", "close", "vol", "amount")
HORIZONS = (1, 5, 10, 20)


class SchemaContractError(ValueError):
    """A panel lacks columns that it must have."""


@dataclass(frozen=True)
class Layer:
    name: str
    start: str
    end: str


#: Ranges that fit the star-schema tables; layers are in order and don't overlap.
LAYERS = (Layer("TRAIN", "1995-01-01", "1997-12-31"), Layer("VALID", "1998-01-01", "1999-06-30"), Layer("HOLDOUT", "1999-07-01", "2000-06-30"), Layer("VAULT", "2000-07-01", "2001-12-31"))


@dataclass(frozen=True)
class PanelSpec:
    """What load_panel checks and fills in."""

    required: tuple[str, ...] = REQUIRED
    optional: tuple[str, ...] = ()
    quality: tuple[str, ...] = ("valid_bar", "is_common_stock")
    layers: tuple[Layer, ...] = field(default=LAYERS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def load_panel(spark: SparkSession, path: str, spec: PanelSpec = PanelSpec(), years: tuple[int, ...] | None = None) -> DataFrame:
    """Read, check and complete a panel: contract, quality filters, defaults for raw prices, adjustment and tradability, vwap. years: which partitions (trade_year) to read."""
    frame = spark.read.option("mergeSchema", "false").parquet(path)
    frame = frame if years is None else frame.filter(F.col("trade_year").isin(*years))
    have = set(frame.columns)
    if missing := [c for c in spec.required if c not in have]:
        raise SchemaContractError(f"columns missing: {', '.join(missing)}")
    if flags := [F.coalesce(F.col(c), F.lit(False)) for c in spec.quality if c in have]:
        frame = frame.filter(reduce(lambda a, b: a & b, flags))
    wanted = list(dict.fromkeys([*spec.required, *(c for c in spec.optional if c in have), *(c for c in ("name", "raw_open", "raw_high", "raw_low", "raw_close", "adjustment_factor", "adj_factor", "can_buy_open_proxy", "can_sell_open_proxy") if c in have)]))
    frame = frame.select(*wanted)
    for c in ("open", "high", "low", "close"):
        frame = frame.withColumn(f"raw_{c}", F.coalesce(F.col(f"raw_{c}"), F.col(c)) if f"raw_{c}" in have else F.col(c))
    factor = [F.col(c).cast("double") for c in ("adjustment_factor", "adj_factor") if c in have]
    frame = frame.withColumn("adjustment_factor", F.coalesce(*factor, F.lit(1.0)))
    for c in ("can_buy_open_proxy", "can_sell_open_proxy"):
        frame = frame.withColumn(c, F.coalesce(F.col(c), F.lit(True)) if c in have else F.lit(True))
    return frame.withColumn("vwap", F.try_divide("amount", "vol"))


def panel_points(spark: SparkSession, path: str, points: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Rows of a stored panel at points (ts_code, trade_date): only the partitions of the points' years are read. Points that repeat give a row once."""
    points = points.select(*KEY).distinct()
    years = tuple(r["y"] for r in points.select(F.year("trade_date").alias("y")).distinct().filter("y is not null").collect())  # a panel has few years
    return load_panel(spark, path, spec, years or (0,)).join(points, list(KEY), "left_semi")


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by week from lineitem. Open and close are the first and last unit price in a total order of the week's lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    lines = lines.withColumn("p", F.col("l_extendedprice") / F.col("l_quantity")).withColumn("o", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))
    bars = lines.groupBy(F.col("l_suppkey").alias("ts_code"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("trade_date")).agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("l_quantity").cast("double").alias("vol"), F.round(F.sum("l_extendedprice"), 2).alias("amount")
    )
    return bars.withColumn("vwap", F.col("amount") / F.col("vol"))


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User by day from events."""
    events = table(spark, sf_dir, "events").filter("value is not null").withColumn("o", F.struct("ts", "event_id"))
    return events.groupBy(F.col("user_id").alias("ts_code"), F.to_date("ts").alias("trade_date")).agg(
        F.min_by("value", "o").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "o").alias("close"), F.count(F.lit(1)).cast("double").alias("vol"), F.round(F.sum("value"), 4).alias("amount")
    )


def calendar(panel: DataFrame) -> DataFrame:
    """One row per session with its dense index from 0. Sessions are few, so one task numbers them."""
    days = panel.select("trade_date").distinct()
    return days.withColumn("market_session_index", F.row_number().over(Window.orderBy("trade_date")) - 1)


def layer_of(day: Column, layers: tuple[Layer, ...] = LAYERS) -> Column:
    out = F.lit("NONE")
    for layer in reversed(layers):
        out = F.when(day.between(F.lit(layer.start).cast("date"), F.lit(layer.end).cast("date")), layer.name).otherwise(out)
    return out


def with_universe(panel: DataFrame, layers: tuple[Layer, ...] = LAYERS, window: int = 60, least: int = 20, decimals: int | None = None) -> DataFrame:
    """Add amt60 (mean amount of 60 sessions, 20 at least), univ_rank (1 = most liquid on the day), era (year) and layer.

    decimals: amounts have no more of them. They are then summed as whole numbers, so that equal means are equal to the last digit and tie.
    """
    last = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(-(window - 1), 0)
    n, mean = F.count("amount").over(last), F.avg("amount").over(last)
    if decimals is not None:
        mean = F.sum(F.round(F.col("amount") * 10**decimals).cast("long")).over(last) / (n * 10**decimals)
    panel = panel.withColumn("amt60", F.when(n >= least, mean))
    day = Window.partitionBy("trade_date").orderBy(F.col("amt60").desc_nulls_last(), "ts_code")
    return (
        panel.withColumn("univ_rank", F.when(F.col("amt60").isNotNull(), F.row_number().over(day)))
        .withColumn("era", F.year("trade_date"))
        .withColumn("layer", layer_of(F.col("trade_date"), layers))
    )


def with_labels(panel: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Add market_session_index, label_entry_date, and for each h label_exit_date_h and fwd_h: enter at the open of the next market session, leave at the open h sessions later.

    Dates come from the market's calendar, not from the entity's next row, so a missing or non-positive quote gives a null return.
    The calendar is a small table (a row a session) and is broadcast by Spark when it is below the session's threshold. Quotes are found in a
    range of exactly one session of the entity's own rows, so that one sort serves all horizons. An entity with two rows in a session fails.
    """
    days = Window.orderBy("trade_date")
    cal = calendar(panel).withColumn("label_entry_date", F.lead("trade_date", 1).over(days))
    for h in horizons:
        cal = cal.withColumn(f"label_exit_date_{h}", F.lead("trade_date", h + 1).over(days))
    at = lambda k: Window.partitionBy("ts_code").orderBy("market_session_index").rangeBetween(k, k)
    quote = F.when((F.col("open") > 0) & finite(F.col("open")), F.col("open"))
    quote = F.when(F.count(F.lit(1)).over(at(0)) == 1, quote).otherwise(F.raise_error(F.lit("an entity has several rows in one session")).cast("double"))
    out = panel.join(cal, "trade_date", "left").withColumn("_quote", quote).withColumn("_entry", F.max("_quote").over(at(1)))
    for h in horizons:
        out = out.withColumn(f"fwd_{h}", F.max("_quote").over(at(h + 1)) / F.col("_entry") - 1)
    return out.drop("_quote", "_entry")


def require_unique(frame: DataFrame, keys: list[str]) -> DataFrame:
    """frame, checked to have one row per key (a many-to-one join's right side)."""
    if frame.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"rows repeat a key of {', '.join(keys)}")
    return frame


def purged(panel: DataFrame, horizon: int, embargo: int = 5, layers: tuple[Layer, ...] = LAYERS) -> DataFrame:
    """Rows of a layer from its `embargo`-th session on whose label ends inside the layer. Needs with_universe and with_labels."""
    sessions = panel.select("layer", "trade_date").distinct().withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy("trade_date")) - 1)
    end = F.lit(None).cast("date")
    for layer in layers:
        end = F.when(F.col("layer") == layer.name, F.lit(layer.end).cast("date")).otherwise(end)
    joined = panel.join(sessions, ["layer", "trade_date"])
    return joined.filter((F.col("layer") != "NONE") & (F.col("place") >= embargo) & (F.col(f"label_exit_date_{horizon}") <= end))
