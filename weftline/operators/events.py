"""Event study of overnight gaps: events, buckets, grids, years, and greedy cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.ranges import cut, quantiles
from weftline.functions.windows import history
from weftline.sources.panel import calendar

#: Lower bounds of the gap buckets, in fractions of the close before.
EDGES = (-0.5, -0.2, -0.05, 0.0, 0.05, 0.2, 0.5)


def gap_events(panel: DataFrame, horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """gap = open over the entity's last close - 1, calendar_idx, and fwd_h: from this open to the open h of the entity's rows later, where that is h market sessions later."""
    p = panel.join(calendar(panel), "trade_date").withColumnRenamed("market_session_index", "calendar_idx").withColumn("before", F.lag("close").over(history()))
    for h in horizons:
        exact = F.lead("calendar_idx", h).over(history()) == F.col("calendar_idx") + h
        p = p.withColumn(f"fwd_{h}", F.when(exact, F.lead("open", h).over(history()) / F.col("open") - 1))
    return p.filter("before is not null").withColumn("gap", F.col("open") / F.col("before") - 1)


def bucket(gap) -> F.Column:
    out = F.lit(0)
    for i, edge in enumerate(EDGES, 1):
        out = F.when(gap >= edge, i).otherwise(out)
    return out


def bucket_table(events: DataFrame, h: int) -> DataFrame:
    x = F.col(f"fwd_{h}")
    rows = cut(events.select("ts_code", bucket(F.col("gap")).alias("bucket"), x))
    found = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ts_code").alias("entities"), F.avg(x).alias("mean"), F.avg((x > 0).cast("double")).alias("win_rate"))
    return found.join(quantiles(rows, ["bucket"], f"fwd_{h}", {"median": 0.5}), "bucket", "left")


def group_summary(events: DataFrame, by: str, h: int) -> DataFrame:
    """n, mean, std, quantiles and t of a horizon's returns."""
    x = F.col(f"fwd_{h}")
    rows = cut(events.filter(x.isNotNull() & F.col(by).isNotNull()).select(by, x))
    found = rows.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    found = found.withColumn("t", F.try_divide("mean", F.try_divide("std", F.sqrt("n"))))
    return found.join(quantiles(rows, [by], f"fwd_{h}", {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}), by)


def grid(events: DataFrame, thresholds: tuple[float, ...], horizons: tuple[int, ...]) -> DataFrame:
    """threshold, sign, horizon, n, mean: one conditional pass over the events for all cells."""
    cells = [(t, sign, h) for t in thresholds for sign in (-1, 1) for h in horizons]
    hit = lambda t, sign: F.col("gap") * sign >= t
    one = events.agg(*[f(F.when(hit(t, s), F.col(f"fwd_{h}"))).alias(f"{name}{i}") for i, (t, s, h) in enumerate(cells) for name, f in (("n", F.count), ("m", F.avg))])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("sign"), F.lit(h).alias("horizon"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean")) for i, (t, s, h) in enumerate(cells)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def cooldown(events: DataFrame, sessions: int) -> DataFrame:
    """Events of each entity picked greedily: one counts if more than `sessions` sessions passed since the last that counted.

    Entities are streamed in order within partitions, so an entity's history is never held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, last = None, None
        for batch in batches:
            keep = []
            for code, idx in zip(batch["ts_code"], batch["calendar_idx"], strict=True):
                if code != entity:
                    entity, last = code, None
                keep.append(last is None or idx - last > sessions)
                last = idx if keep[-1] else last
            yield batch[keep]

    ordered = events.repartition("ts_code").sortWithinPartitions("ts_code", "calendar_idx")
    return ordered.mapInPandas(run, events.schema)


def spacing(events: DataFrame) -> DataFrame:
    """Add sessions until the entity's next event."""
    return events.withColumn("next_in", F.lead("calendar_idx").over(Window.partitionBy("ts_code").orderBy("calendar_idx")) - F.col("calendar_idx"))
