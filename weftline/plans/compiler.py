"""From expression trees to DataFrame plans.

A call that stands on another window gets that window as a staged column, so every distinct sub-expression is computed once however
many factors share it; Catalyst merges stages with the same partitioning into one shuffle. A plan alternates between windows by entity and
by day as the expression does.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.catalog import FUNCTIONS, TINY
from weftline.functions.windows import ROW, history
from weftline.plans.expression import Node, parse, required_history
from weftline.sources.panel import KEY, finite

#: Functions that take values that aren't finite as missing (fixed values).
CLEANED = {
    "ts_corr_v2", "ts_beta", "ts_residual", "ts_mean_if", "ts_count", "ts_median", "ts_mad", "ts_robust_zscore", "ts_bars_since", "ts_streak", "ts_decay_linear", "ts_ewm", "ts_drawdown",
    "winsor_mad", "cs_residual", "group_rank", "group_zscore",
}


def clean(x: Column) -> Column:
    return F.when(finite(x), x)


class Plan:
    """Columns added to a panel, one for each distinct windowed sub-expression."""

    def __init__(self, panel: DataFrame):
        self.frame, self.staged, self.own = panel, {}, set(panel.columns)

    def column(self, node: Node) -> Column:
        if node.kind == "number":
            return F.lit(node.value)
        if node.kind == "field":
            c = F.col(node.name).cast("double")
            return F.when(~F.isnan(c), c)
        if node.kind == "negate":
            return -self.column(node.args[0])
        if node.kind != "call":
            x, y = (self.column(a) for a in node.args)
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y + TINY)}[node.kind]()
        f = FUNCTIONS[node.name]
        if f.kind == "row":
            args = [self.column(a) for a in node.args]
            return f.build(*([clean(args[0]), *args[1:]] if node.name == "where" else args))
        if node not in self.staged:
            if f.row and ROW not in self.frame.columns:
                self.frame = self.frame.withColumn(ROW, F.row_number().over(history()))
            args = [clean(self.stage(a)) if node.name in CLEANED and a.kind != "number" else self.stage(a) for a in node.args]
            name = f"_s{len(self.staged)}"
            self.frame = self.frame.withColumn(name, f.build(*args, *node.literals))
            self.staged[node] = name
        return F.col(self.staged[node])

    def stage(self, node: Node) -> Column:
        """A window's argument: a staged column unless it is a number."""
        if node.kind == "number":
            return F.lit(node.value)
        c = self.column(node)
        if node not in self.staged:
            name = f"_s{len(self.staged)}"
            self.frame = self.frame.withColumn(name, c)
            self.staged[node] = name
        return F.col(self.staged[node])


def factors(panel: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """The panel with one column for each named expression; sub-expressions they share are computed once."""
    fields = [c for c, kind in panel.dtypes if c not in KEY and kind != "string"] + [c for c in ("ts_code",) if dict(panel.dtypes)[c] in ("int", "bigint")]
    plan = Plan(panel)
    named = {name: plan.column(parse(text, fields)) for name, text in expressions.items()}
    keep = [c for c in panel.columns if c not in named]
    return plan.frame.select(*keep, *[c.alias(name) for name, c in named.items()])


def factor(panel: DataFrame, expression: str, name: str = "factor") -> DataFrame:
    return factors(panel, {name: expression})


def with_history(panel: DataFrame, expression: str, start: date | str, end: date | str) -> DataFrame:
    """Rows that the expression's values from start to end can depend on: nothing after end, and of each entity's earlier rows the last ones that its look-back counts, however long it paused."""
    fields = [c for c in panel.columns if c not in KEY]
    need = required_history(parse(expression, fields))
    bounded = panel.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    inside = F.col("trade_date") >= F.lit(start).cast("date")
    back = Window.partitionBy("ts_code").orderBy(F.desc("trade_date"))
    before = bounded.filter(~inside).withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= need).drop("_back")
    return bounded.filter(inside).unionByName(before)
