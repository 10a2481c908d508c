"""The functions of the expression language, each as a builder of Spark columns.

A builder gets the compiled arguments (columns) and literal arguments (numbers), in order, and returns a column. All windows
over time are strict: a result needs as many valid rows as the window is long. Kinds: "row" (no window), "time" (window over an
entity's rows), "day" (window over a session's rows).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.windows import ROW, average_rank, clip, day, full, history, last, values

#: Fixed values of the language.
TINY, LOG_TINY, MAD_SCALE, WINSOR, MOST_WINDOW = 1e-12, 1e-9, 1.4826, 2.5, 252


@dataclass(frozen=True)
class Function:
    name: str
    kind: str
    columns: int
    build: Callable[..., Column]
    literals: tuple[str, ...] = ()  # "window" (1..252), "unit" (0..1), "width" (0 < k <= 20)
    least_window: int = 1
    reach: int = 0  # rows before a window's first that are read
    row: bool = False  # needs the ROW column
    proposed: bool = True


FUNCTIONS: dict[str, Function] = {}


def register(name: str, kind: str, columns: int, literals: tuple[str, ...] = (), **more):
    """Add a function to the language: the extension point for own operators."""

    def add(build: Callable[..., Column]) -> Callable[..., Column]:
        FUNCTIONS[name] = Function(name, kind, columns, build, literals, **more)
        return build

    return add


W = ("window",)
truth = lambda c: F.when(c.isNotNull(), (c != 0).cast("double"))

# Rows.
register("log", "row", 1)(lambda x: F.log(F.abs(x) + LOG_TINY))
register("abs", "row", 1)(lambda x: F.abs(x))
register("sign", "row", 1)(lambda x: F.signum(x))
register("maximum", "row", 2)(lambda x, y: F.greatest(x, y))
register("minimum", "row", 2)(lambda x, y: F.least(x, y))
register("gt", "row", 2)(lambda x, y: (x > y).cast("double"))
register("lt", "row", 2)(lambda x, y: (x < y).cast("double"))
register("where", "row", 3)(lambda c, a, b: F.when(c.isNull(), None).when(c != 0, a).otherwise(b))

# Time: shifts and moments.
register("delay", "time", 1, W, reach=1)(lambda x, w: F.lag(x, w).over(history()))
register("returns", "time", 1, W, reach=1)(lambda x, w: x / (F.lag(x, w).over(history()) + TINY) - 1)
register("ts_delta", "time", 1, W, reach=1)(lambda x, w: x - F.lag(x, w).over(history()))
register("ts_mean", "time", 1, W)(lambda x, w: full(x, w, F.avg(x).over(last(w))))
register("ts_std", "time", 1, W)(lambda x, w: full(x, w, F.stddev_samp(x).over(last(w))))
register("ts_sum", "time", 1, W)(lambda x, w: full(x, w, F.sum(x).over(last(w))))
register("ts_min", "time", 1, W)(lambda x, w: full(x, w, F.min(x).over(last(w))))
register("ts_max", "time", 1, W)(lambda x, w: full(x, w, F.max(x).over(last(w))))
register("ts_quantile", "time", 1, ("window", "unit"))(lambda x, w, q: full(x, w, F.percentile(x, F.lit(q)).over(last(w))))
register("ts_median", "time", 1, W)(lambda x, w: full(x, w, F.percentile(x, F.lit(0.5)).over(last(w))))
register("ts_drawdown", "time", 1, W)(lambda x, w: (lambda p: full(p, w, p / F.max(p).over(last(w)) - 1))(F.when(x > 0, x)))


@register("ts_rank", "time", 1, W)
def ts_rank(x: Column, w: int) -> Column:
    """Share of the window's values that aren't above the current one."""
    return full(x, w, F.size(F.filter(values(x, w), lambda v: v <= x)) / w)


@register("ts_corr", "time", 2, W, proposed=False)
def ts_corr(x: Column, y: Column, w: int) -> Column:
    """The older correlation, kept to replay old expressions: population covariance over sample deviations."""
    mean = lambda c: full(c, w, F.avg(c).over(last(w)))
    std = lambda c: full(c, w, F.stddev_samp(c).over(last(w)))
    return (mean(x * y) - mean(x) * mean(y)) / (std(x) * std(y) + TINY)


# Time: straight lines through the window, t = 1..w.
def line(x: Column, w: int) -> tuple[Column, float]:
    """Sum of products of deviations of x and t, and sum of squares of t's."""
    return F.covar_pop(x, F.col(ROW).cast("double")).over(last(w)) * w, w * (w * w - 1) / 12


def slope(x: Column, w: int) -> Column:
    products, squares = line(x, w)
    return products / (squares + TINY)


@register("ts_slope", "time", 1, W, least_window=2, row=True)
def ts_slope(x: Column, w: int) -> Column:
    return full(x, w, slope(x, w))


@register("ts_rsquare", "time", 1, W, least_window=2, row=True)
def ts_rsquare(x: Column, w: int) -> Column:
    products, squares = line(x, w)
    return full(x, w, products * products / (squares * F.var_pop(x).over(last(w)) * w + TINY))


@register("ts_resi", "time", 1, W, least_window=2, row=True)
def ts_resi(x: Column, w: int) -> Column:
    """Current value minus the line's value at t = w."""
    return full(x, w, x - F.avg(x).over(last(w)) - slope(x, w) * ((w - 1) / 2))


@register("ts_argmax", "time", 1, W)
def ts_argmax(x: Column, w: int) -> Column:
    v = values(x, w)
    return full(x, w, F.array_position(v, F.array_max(v)).cast("double"))


@register("ts_argmin", "time", 1, W)
def ts_argmin(x: Column, w: int) -> Column:
    v = values(x, w)
    return full(x, w, F.array_position(v, F.array_min(v)).cast("double"))


# Time: two series. Only rows with both count as valid.
def pair(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


@register("ts_corr_v2", "time", 2, W, least_window=2)
def ts_corr_v2(x: Column, y: Column, w: int) -> Column:
    a, b = pair(x, y)
    r = F.try_divide(F.covar_pop(a, b).over(last(w)), F.stddev_pop(a).over(last(w)) * F.stddev_pop(b).over(last(w)))
    return full(a, w, clip(r, F.lit(-1.0), F.lit(1.0)))


@register("ts_beta", "time", 2, W, least_window=2)
def ts_beta(y: Column, x: Column, w: int) -> Column:
    b, a = pair(y, x)
    return full(a, w, F.try_divide(F.covar_pop(b, a).over(last(w)), F.var_pop(a).over(last(w))))


@register("ts_residual", "time", 2, W, least_window=2)
def ts_residual(y: Column, x: Column, w: int) -> Column:
    """Residual of the current row; one within rounding of zero is zero."""
    b, a = pair(y, x)
    beta = F.try_divide(F.covar_pop(b, a).over(last(w)), F.var_pop(a).over(last(w)))
    left = (b - F.avg(b).over(last(w))) - beta * (a - F.avg(a).over(last(w)))
    scale = F.greatest(F.abs(b), F.abs(F.avg(b).over(last(w))), F.abs(beta * a), F.lit(1.0))
    return full(a, w, F.when(F.abs(left) <= F.lit(32 * 2.0**-52) * scale, 0.0).otherwise(left))


# Time: conditions. A condition holds where it isn't zero; a missing one isn't false.
@register("ts_mean_if", "time", 2, W)
def ts_mean_if(x: Column, c: Column, w: int) -> Column:
    a, b = pair(x, c)
    return full(a, w, F.try_divide(F.sum(F.when(b != 0, a).otherwise(0.0)).over(last(w)), F.sum(truth(b)).over(last(w))))


@register("ts_count", "time", 1, W)
def ts_count(c: Column, w: int) -> Column:
    return full(c, w, F.sum(truth(c)).over(last(w)))


@register("ts_bars_since", "time", 1, W, row=True)
def ts_bars_since(c: Column, w: int) -> Column:
    row = F.col(ROW)
    return full(c, w, (row - F.max(F.when(c != 0, row)).over(last(w))).cast("double"))


@register("ts_streak", "time", 1, W, row=True)
def ts_streak(c: Column, w: int) -> Column:
    row = F.col(ROW)
    return full(c, w, (row - F.coalesce(F.max(F.when(c == 0, row)).over(last(w)), row - w)).cast("double"))


# Time: weights and robust spread.
@register("ts_decay_linear", "time", 1, W, row=True)
def ts_decay_linear(x: Column, w: int) -> Column:
    """Weights 1..w, the newest heaviest."""
    row = F.col(ROW)
    return full(x, w, (F.sum(x * row).over(last(w)) - F.sum(x).over(last(w)) * (row - w)) / (w * (w + 1) / 2))


@register("ts_ewm", "time", 1, W)
def ts_ewm(x: Column, w: int) -> Column:
    """Weights (1 - alpha) ** age with alpha = 2 / (w + 1) inside the window, normalised."""
    keep = 1 - 2 / (w + 1)
    weights = [keep ** (w - 1 - i) for i in range(w)]
    products = F.zip_with(values(x, w), F.array(*[F.lit(v) for v in weights]), lambda a, b: a * b)
    return full(x, w, F.aggregate(products, F.lit(0.0), lambda s, v: s + v) / sum(weights))


def middle(a: Column, w: int) -> Column:
    s = F.array_sort(a)
    return (F.get(s, F.lit((w - 1) // 2)) + F.get(s, F.lit(w // 2))) / 2


def mad(x: Column, w: int) -> Column:
    centre = F.percentile(x, F.lit(0.5)).over(last(w))
    return middle(F.transform(values(x, w), lambda v: F.abs(v - centre)), w)


@register("ts_mad", "time", 1, W)
def ts_mad(x: Column, w: int) -> Column:
    return full(x, w, mad(x, w))


@register("ts_robust_zscore", "time", 1, W)
def ts_robust_zscore(x: Column, w: int) -> Column:
    centre = F.percentile(x, F.lit(0.5)).over(last(w))
    return full(x, w, F.try_divide(x - centre, MAD_SCALE * mad(x, w)))


# Day.
register("rank", "day", 1)(lambda x: average_rank(x) / (F.count(x).over(day()) + TINY))
register("zscore", "day", 1)(lambda x: (x - F.avg(x).over(day())) / (F.stddev_samp(x).over(day()) + TINY))


@register("winsor", "day", 1)
def winsor(x: Column) -> Column:
    mean, reach = F.avg(x).over(day()), WINSOR * F.stddev_samp(x).over(day())
    return clip(x, mean - reach, mean + reach)


@register("winsor_mad", "day", 1, ("width",))
def winsor_mad(x: Column, k: float) -> Column:
    centre = F.median(x).over(day())
    reach = k * MAD_SCALE * F.median(F.abs(x - centre)).over(day())
    return clip(x, centre - reach, centre + reach)


@register("cs_residual", "day", 2)
def cs_residual(y: Column, x: Column) -> Column:
    b, a = pair(y, x)
    n, beta = F.count(a).over(day()), F.try_divide(F.covar_pop(b, a).over(day()), F.var_pop(a).over(day()))
    return F.when((n >= 3) & a.isNotNull(), (b - F.avg(b).over(day())) - beta * (a - F.avg(a).over(day())))


@register("group_rank", "day", 2)
def group_rank(x: Column, g: Column) -> Column:
    x = F.when(g.isNotNull(), x)
    n = F.count(x).over(day(g))
    return F.when(n >= 2, average_rank(x, g) / n)


@register("group_zscore", "day", 2)
def group_zscore(x: Column, g: Column) -> Column:
    x = F.when(g.isNotNull(), x)
    n, std = F.count(x).over(day(g)), F.stddev_samp(x).over(day(g))
    return F.when((n >= 2) & (std > 0), (x - F.avg(x).over(day(g))) / std)


#: Literal -> integer window: a check that all builders rely on.
def window_size(value: float, least: int) -> int:
    if value != int(value) or not max(1, least) <= value <= MOST_WINDOW:
        raise ValueError(f"a window is a whole number from {max(1, least)} to {MOST_WINDOW}, not {value:g}")
    return int(value)


ROOT_YEAR = sqrt(252)
