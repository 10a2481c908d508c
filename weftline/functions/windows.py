"""Windows of a panel, and expressions that more than one function needs."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Place of a row among its entity's rows; the compiler adds it where a function asks for it.
ROW = "_row"


def history():
    return Window.partitionBy("ts_code").orderBy("trade_date")


def last(w: int):
    return history().rowsBetween(-(w - 1), 0)


def day(*more: Column):
    return Window.partitionBy("trade_date", *more)


def full(x: Column, w: int, value: Column) -> Column:
    """value where all of the last w rows have an x, else null."""
    return F.when(F.count(x).over(last(w)) == w, value)


def values(x: Column, w: int) -> Column:
    """Array of the last w values, oldest first; nulls are NaN, so that places hold."""
    return F.collect_list(F.coalesce(x, F.lit(float("nan")))).over(last(w))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def average_rank(x: Column, *groups: Column) -> Column:
    """Rank of x on its day (1 = smallest) with ties sharing the mean of their places; null for null."""
    ties = F.count(F.lit(1)).over(day(*groups, x))
    place = F.rank().over(day(*groups).orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), place + (ties - 1) / 2)


def safe_corr(x: Column, y: Column, over=None) -> Column:
    """Pearson correlation of complete pairs; null where a side doesn't vary (F.corr divides by zero there)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    on = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return F.try_divide(on(F.covar_pop(a, b)), on(F.stddev_pop(a)) * on(F.stddev_pop(b)))
