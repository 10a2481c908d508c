"""Joins and set operations that analytics over panels and registries need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.ranges import carried, cut

#: Rows of one group, both sides together, up to which it is sorted in one task.
GROUP_ROWS = 1 << 20


def asof_join(left: DataFrame, right: DataFrame, by: str, when: str, value: str) -> DataFrame:
    """left with the last `value` of right at or before its time, by group.

    Both sides are merged in one sorted pass (union and a running last value), so no pair of rows is built. At equal times the right side counts.
    Where a group has more than GROUP_ROWS rows, the pass goes over sorted ranges, each of which hands its last value on, so that a hot group is spread over many tasks.
    """
    a = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(1).alias("_side"))
    b = right.select(*[F.col(c) if c in (by, when) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(value).alias("_value"), F.lit(0).alias("_side"))
    both = a.unionByName(b)
    if (both.groupBy(by).count().agg(F.max("count")).first()[0] or 0) > GROUP_ROWS:
        both = carried(cut(both), [by], [F.col(when).asc(), F.col("_side").asc()], "_value", "_last").drop("_value").withColumnRenamed("_last", "_value")
    else:
        past = Window.partitionBy(by).orderBy(when, "_side").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_value", F.last("_value", ignorenulls=True).over(past))
    return both.filter("_side = 1").drop("_side").withColumnRenamed("_value", value)


def range_join(rows: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Rows with the integer ranges that hold them: ranges are cut at multiples of width, so the join is an equality on the cell."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return rows.withColumn("_cell", F.floor(F.col(at) / width)).join(cells, "_cell").filter(F.col(at).between(F.col(low), F.col(high))).drop("_cell")


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def shortest_of(rows: DataFrame, identity: str, text: str, origin: str) -> DataFrame:
    """One row per identity: its shortest text (first by code point among equals) and all origins."""
    return rows.groupBy(identity).agg(F.min_by(text, F.struct(F.length(text), F.col(text))).alias(text), F.array_sort(F.collect_set(origin)).alias("origins"), F.count(F.lit(1)).alias("n"))


def page(rows: DataFrame, seq: str, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit - 1 by a stored dense sequence number: a filter that the scan can use, not a sort."""
    return rows.filter((F.col(seq) >= offset) & (F.col(seq) < offset + limit))


def concentration(rows: DataFrame, by: str) -> DataFrame:
    """One row: Herfindahl index of the groups' sizes, and the effective number of groups."""
    sizes = rows.groupBy(by).count()
    total = sizes.agg(F.sum("count").alias("total"))
    return sizes.join(F.broadcast(total)).agg(F.sum(F.pow(F.col("count") / F.col("total"), F.lit(2.0))).alias("hhi")).withColumn("effective", 1 / F.col("hhi"))


def regime_blend(a: DataFrame, b: DataFrame, regime: DataFrame, keys: list[str], when: str, value: str) -> DataFrame:
    """a's value where the day's regime is on, else b's; keys are unique on both sides. The regime is a row a session."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return both.join(regime.select(when, "on"), when, "left").select(*keys, F.when(F.col("on") == 1, F.col("_a")).otherwise(F.col("_b")).alias(value))
