"""Running results along an order by sorted ranges, so that no group sits in one task, and lineage cuts.

Rows are sorted into ranges of about RANGE_ROWS by group and order; a range may hold several groups and a group many ranges. A window inside (range, group)
gives a range's own part, a row per (group, range) says what the range hands on, a window over these few rows what came before it, and a join by
(group, range) adds it. Rows that tie in group and order stay in one range, so an order should end in something that parts them.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1 << 18
#: Rows by count up to which a table is broadcast.
BROADCAST = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, where all are one machine, may do without."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, path: str) -> DataFrame:
    """df from a Parquet table of its own at path. In loops: a checkpoint hands its constraints on, which multiply from round to round."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows by count; else as it is, for a shuffled join. For cut tables."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def in_ranges(rows: DataFrame, by: list[str], order: list[Column], range_rows: int | None = None) -> DataFrame:
    """rows (cut, or cheap to count) with _range, the number of their sorted range; written."""
    n = max(1, -(-rows.count() // (range_rows or RANGE_ROWS)))
    ranged = rows.repartitionByRange(n, *[F.col(b).asc_nulls_first() for b in by], *order) if n > 1 else rows.repartition(1)
    return cut(ranged.withColumn("_range", F.spark_partition_id()))


def with_before(ranged: DataFrame, by: list[str], state: Column, before, name: str) -> DataFrame:
    """Add `name` to rows in ranges: before(_state) over the states of the earlier ranges of the row's group. state: an aggregate of a range's rows of a group."""
    states = ranged.groupBy(*by, "_range").agg(state.alias("_state"))
    earlier = Window.partitionBy(*[F.col(b) for b in by]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = {c: f"_{c}_of" for c in [*by, "_range"]}
    handed = few(cut(states.select(*[F.col(c).alias(k) for c, k in keys.items()], before(F.col("_state")).over(earlier).alias(name))))
    same = reduce(lambda a, b: a & b, [ranged[c].eqNullSafe(handed[k]) for c, k in keys.items()])
    return ranged.join(handed, same).drop(*keys.values())


def running_sum(rows: DataFrame, by: list[str], order: list[Column], value: str, name: str, range_rows: int | None = None) -> DataFrame:
    """Add the sum of value from its group's first row in order up to each row."""
    ranged = in_ranges(rows, by, order, range_rows)
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = with_before(ranged.withColumn(name, F.sum(value).over(inside)), by, F.sum(value), F.sum, "_before")
    return found.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before", "_range")


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "place", range_rows: int | None = None) -> DataFrame:
    """Add each row's place in its group's order, from 0."""
    found = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), by, order, "_one", name, range_rows)
    return found.withColumn(name, F.col(name) - 1).drop("_one")


def carried(rows: DataFrame, by: list[str], order: list[Column], value: str, name: str, range_rows: int | None = None) -> DataFrame:
    """Add the last value that isn't null, from its group's first row in order up to each row."""
    ranged = in_ranges(rows, by, order, range_rows)
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn(name, F.last(value, ignorenulls=True).over(inside)).withColumn("_place", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)))
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col("_place")))
    found = with_before(ranged, by, last, lambda s: F.last(s, ignorenulls=True), "_before")
    return found.withColumn(name, F.coalesce(name, "_before")).drop("_before", "_place", "_range")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], range_rows: int | None = None) -> DataFrame:
    """by, then a column for each share: its exact quantile with linear interpolation, as percentile gives it.

    Equal values are counted first, so that neither a frequent value nor a large group meets in one task. Groups without a value are left out.
    """
    counts = cut(rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_count")))
    sizes = counts.groupBy(*[F.col(b).alias(f"_{b}_of") for b in by]).agg(F.sum("_count").alias("_size"))
    ends = running_sum(counts, by, [F.col("_value")], "_count", "_end", range_rows)
    if by:
        sizes = few(cut(sizes))
        ends = ends.join(sizes, reduce(lambda a, b: a & b, [ends[b].eqNullSafe(sizes[f"_{b}_of"]) for b in by]))
    else:
        ends = ends.withColumn("_size", F.lit(sizes.first()["_size"]).cast("long"))
    at = {name: F.lit(float(share)) * (F.col("_size") - 1) for name, share in shares.items()}
    holds = lambda place: F.when((F.col("_end") - F.col("_count") <= place) & (place < F.col("_end")), F.col("_value").cast("double"))
    parts = [agg for name, h in at.items() for agg in (F.max(holds(F.floor(h))).alias(f"_low_{name}"), F.max(holds(F.ceil(h))).alias(f"_high_{name}"), F.max(h - F.floor(h)).alias(f"_part_{name}"))]
    found = ends.groupBy(*by).agg(*parts)
    whole = [(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n) for n in shares]
    return found.select(*by, *whole)
