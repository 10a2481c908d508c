"""Queries over the supplier panel, one for each function of the expression language, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.compiler import factor, factors
from weftline.plans.features import WINDOWS, library
from weftline.plans.ordered import value_summary
from weftline.sources.panel import supplier_panel

#: The supplier panel in SQL; `sector` is a group for tests, rn a row's place in its entity's history.
PANEL_SQL = """
bars AS (
  SELECT l_suppkey AS ts_code, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date, l_extendedprice / l_quantity AS p, l_extendedprice, l_quantity,
         l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem),
panel AS (
  SELECT ts_code, trade_date,
         first(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS open, max(p) AS high, min(p) AS low,
         last(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS close,
         sum(l_quantity)::DOUBLE AS vol, round(sum(l_extendedprice), 2) AS amount, round(sum(l_extendedprice), 2) / sum(l_quantity)::DOUBLE AS vwap,
         (ts_code % 5)::DOUBLE AS sector
  FROM bars GROUP BY ts_code, trade_date)"""
WINDOWS_SQL = """WINDOW h AS (PARTITION BY ts_code ORDER BY trade_date), w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  d AS (PARTITION BY trade_date), g AS (PARTITION BY trade_date, sector)"""

#: Instead of decimals: the value in single precision. Means of prices often end in a half of a decimal place.
SINGLE = -1
strict = lambda e, x="close": f"CASE WHEN count({x}) OVER w = 5 THEN {e} END"
LIST = "list(close) OVER w"
COND = "(CASE WHEN close > open THEN 1.0 ELSE 0.0 END)"
LINE = "(covar_pop(close, rn) OVER w * 5)"
SLOPE = f"({LINE} / (10 + 1e-12))"
BETA = "(covar_pop(close, vol) OVER w / nullif(var_pop(vol) OVER w, 0))"
MEDIAN = "(quantile_cont(close, 0.5) OVER w)"
MAD = f"list_aggregate(list_transform({LIST}, lambda v: abs(v - {{m}})), 'median')"

#: name -> (expression, SQL over panel with rn and the windows, decimals; None for values that need no rounding to agree)
DSL: dict[str, tuple[str, str, int | None]] = {
    "divide": ("close/open", "close / (open + 1e-12)", 9),
    "arithmetic": ("-(close-open)*2+low/vol", "-(close - open) * 2 + low / (vol + 1e-12)", SINGLE),
    "log": ("log(vol)", "ln(abs(vol) + 1e-9)", 9),
    "abs": ("abs(close-open)", "abs(close - open)", None),
    "sign": ("sign(close-open)", "sign(close - open)::DOUBLE", 6),
    "maximum": ("maximum(open,close)", "greatest(open, close)", None),
    "minimum": ("minimum(delay(close,1),close)", "least(lag(close, 1) OVER h, close)", None),
    "gt": ("gt(close,delay(close,1))", "CASE WHEN close > lag(close, 1) OVER h THEN 1.0 WHEN close <= lag(close, 1) OVER h THEN 0.0 END::DOUBLE", 6),
    "lt": ("lt(close,open)", "CASE WHEN close < open THEN 1.0 ELSE 0.0 END::DOUBLE", 6),
    "where": ("where(gt(close,delay(close,1)),high,low)", "CASE WHEN lag(close, 1) OVER h IS NULL THEN NULL WHEN close > lag(close, 1) OVER h THEN high ELSE low END", None),
    "delay": ("delay(close,3)", "lag(close, 3) OVER h", None),
    "returns": ("returns(close,4)", "close / (lag(close, 4) OVER h + 1e-12) - 1", 9),
    "ts_delta": ("ts_delta(close,4)", "close - lag(close, 4) OVER h", None),
    "ts_mean": ("ts_mean(close,5)", strict("avg(close) OVER w"), SINGLE),
    "ts_std": ("ts_std(close,5)", strict("stddev_samp(close) OVER w"), SINGLE),
    "ts_sum": ("ts_sum(close,5)", strict("sum(close) OVER w"), SINGLE),
    "ts_min": ("ts_min(close,5)", strict("min(close) OVER w"), None),
    "ts_max": ("ts_max(close,5)", strict("max(close) OVER w"), None),
    "ts_rank": ("ts_rank(close,5)", strict(f"len(list_filter({LIST}, lambda v: v <= close)) / 5.0::DOUBLE"), 6),
    "ts_corr": ("ts_corr(close,vol,5)", strict("(avg(close * vol) OVER w - avg(close) OVER w * avg(vol) OVER w) / (stddev_samp(close) OVER w * stddev_samp(vol) OVER w + 1e-12)"), 5),
    "ts_quantile": ("ts_quantile(close,5,0.3)", strict("quantile_cont(close, 0.3) OVER w"), SINGLE),
    "ts_slope": ("ts_slope(close,5)", strict(SLOPE), 4),
    "ts_rsquare": ("ts_rsquare(close,5)", strict(f"{LINE} * {LINE} / (10 * (var_pop(close) OVER w * 5) + 1e-12)"), 6),
    "ts_resi": ("ts_resi(close,5)", strict(f"close - avg(close) OVER w - {SLOPE} * 2"), 4),
    "ts_argmax": ("ts_argmax(close,5)", strict(f"list_position({LIST}, max(close) OVER w)::DOUBLE"), 6),
    "ts_argmin": ("ts_argmin(close,5)", strict(f"list_position({LIST}, min(close) OVER w)::DOUBLE"), 6),
    "ts_corr_v2": ("ts_corr_v2(close,vol,5)", strict("least(greatest(covar_pop(close, vol) OVER w / nullif(stddev_pop(close) OVER w * stddev_pop(vol) OVER w, 0), -1), 1)"), 6),
    "ts_beta": ("ts_beta(close,vol,5)", strict(BETA), 5),
    "ts_residual": ("ts_residual(close,vol,5)", strict(f"close - avg(close) OVER w - {BETA} * (vol - avg(vol) OVER w)"), 4),
    "ts_mean_if": ("ts_mean_if(close,gt(close,open),5)", strict(f"sum(CASE WHEN {COND} <> 0 THEN close ELSE 0 END) OVER w / nullif(sum({COND}) OVER w, 0)"), SINGLE),
    "ts_count": ("ts_count(gt(close,open),5)", strict(f"(sum({COND}) OVER w)::DOUBLE"), 6),
    "ts_bars_since": ("ts_bars_since(gt(close,open),5)", strict(f"(rn - max(CASE WHEN {COND} <> 0 THEN rn END) OVER w)::DOUBLE"), 6),
    "ts_streak": ("ts_streak(gt(close,open),5)", strict(f"(rn - coalesce(max(CASE WHEN {COND} = 0 THEN rn END) OVER w, rn - 5))::DOUBLE"), 6),
    "ts_decay_linear": ("ts_decay_linear(close,5)", strict("(sum(close * rn) OVER w - sum(close) OVER w * (rn - 5)) / 15"), SINGLE),
    "ts_ewm": ("ts_ewm(close,5)", strict(f"list_sum(list_transform(list_zip({LIST}, [{', '.join(repr((2 / 3) ** (4 - i)) for i in range(5))}]), lambda p: p[1] * p[2])) / {sum((2 / 3) ** i for i in range(5))!r}"), SINGLE),
    "ts_median": ("ts_median(close,5)", strict(MEDIAN), SINGLE),
    "ts_drawdown": ("ts_drawdown(close,5)", strict("close / max(close) OVER w - 1"), 9),
    "ts_mad": ("ts_mad(close,5)", strict(MAD.format(m="med")), SINGLE),
    "ts_robust_zscore": ("ts_robust_zscore(close,5)", strict(f"(close - med) / nullif(1.4826::DOUBLE * {MAD.format(m='med')}, 0)"), 5),
    "rank": ("rank(close)", "(rank() OVER (PARTITION BY trade_date ORDER BY close) + (count(*) OVER (PARTITION BY trade_date, close) - 1) / 2.0::DOUBLE) / (count(close) OVER d + 1e-12)", 9),
    "zscore": ("zscore(close)", "(close - avg(close) OVER d) / (stddev_samp(close) OVER d + 1e-12)", 6),
    "winsor": ("winsor(close)", "CASE WHEN stddev_samp(close) OVER d IS NULL THEN close ELSE least(greatest(close, avg(close) OVER d - 2.5::DOUBLE * stddev_samp(close) OVER d), avg(close) OVER d + 2.5::DOUBLE * stddev_samp(close) OVER d) END", SINGLE),
    "winsor_mad": ("winsor_mad(close,2)", "least(greatest(close, dmed - 2 * 1.4826::DOUBLE * dmad), dmed + 2 * 1.4826::DOUBLE * dmad)", SINGLE),
    "cs_residual": ("cs_residual(close,vol)", "CASE WHEN count(*) OVER d >= 3 THEN close - avg(close) OVER d - covar_pop(close, vol) OVER d / nullif(var_pop(vol) OVER d, 0) * (vol - avg(vol) OVER d) END", 4),
    "group_rank": ("group_rank(close,sector)", "CASE WHEN count(*) OVER g >= 2 THEN (rank() OVER (PARTITION BY trade_date, sector ORDER BY close) + (count(*) OVER (PARTITION BY trade_date, sector, close) - 1) / 2.0::DOUBLE) / count(*) OVER g END", 9),
    "group_zscore": ("group_zscore(close,sector)", "CASE WHEN count(*) OVER g >= 2 AND stddev_samp(close) OVER g > 0 THEN (close - avg(close) OVER g) / stddev_samp(close) OVER g END", 6),
}
BASE_SQL = f"""{PANEL_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS rn, quantile_cont(close, 0.5) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS med,
  median(close) OVER (PARTITION BY trade_date) AS dmed FROM panel),
base AS (SELECT *, median(abs(close - dmed)) OVER (PARTITION BY trade_date) AS dmad FROM numbered)"""


def day_text(name: str = "trade_date"):
    """Dates go out as text, which every engine compares alike."""
    return F.col(name).cast("string").alias(name)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_panel(spark, sf_dir).withColumn("sector", (F.col("ts_code") % 5).cast("double"))


def rounded(c, digits: int):
    """Rounded, and zero without a sign, so that both engines write the same number."""
    kept = c if digits is None else c.cast("float").cast("double") if digits == SINGLE else F.round(c, digits)
    return kept + F.lit(0.0)


def rounded_sql(sql: str, digits: int | None) -> str:
    return (sql if digits is None else f"CAST(CAST({sql} AS FLOAT) AS DOUBLE)" if digits == SINGLE else f"round({sql}, {digits})") + " + 0.0"


def run_expression(spark: SparkSession, sf_dir: str, text: str, digits: int) -> DataFrame:
    return factor(panel(spark, sf_dir), text).select("ts_code", day_text(), rounded(F.col("factor"), digits).alias("factor"))


def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole library of features at its five windows: number and mean of the values of each."""
    return value_summary(panel(spark, sf_dir), library()).select("feature", "n", rounded(F.col("mean"), 4).alias("mean"))


def bar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = library(())
    return factors(panel(spark, sf_dir), names).select("ts_code", day_text(), *[rounded(F.col(n), 6).alias(n.lower()) for n in names])


BAR_SQL = {
    "kmid": "(close - open) / (open + 1e-12)", "klen": "(high - low) / (open + 1e-12)", "kmid2": "(close - open) / (high - low + 1e-12 + 1e-12)", "kup": "(high - greatest(open, close)) / (open + 1e-12)", "kup2": "(high - greatest(open, close)) / (high - low + 1e-12 + 1e-12)",
    "klow": "(least(open, close) - low) / (open + 1e-12)", "klow2": "(least(open, close) - low) / (high - low + 1e-12 + 1e-12)", "ksft": "(2 * close - high - low) / (open + 1e-12)", "ksft2": "(2 * close - high - low) / (high - low + 1e-12 + 1e-12)",
    "open0": "open / (close + 1e-12)", "high0": "high / (close + 1e-12)", "low0": "low / (close + 1e-12)", "vwap0": "vwap / (close + 1e-12)",
}
GUARD = lambda a, b: f"({a}) / (({b}) + 1e-12)"


def rolling_sql(w: int) -> dict[str, str]:
    """SQL of the features of a window, over `stepped` with the window w."""
    whole = lambda e, x="close": f"CASE WHEN count({x}) OVER w = {w} THEN {e} END"
    square = w * (w * w - 1) / 12
    line = f"(covar_pop(close, rn) OVER w * {w})"
    slope = f"({line} / ({square} + 1e-12))"
    agg = lambda f, x: whole(f"{f}({x}) OVER w", x)
    at = lambda f, x: whole(f"list_position(list({x}) OVER w, {f}({x}) OVER w)::DOUBLE", x)
    corr = lambda a, b: f"CASE WHEN count({a} + {b}) OVER w = {w} THEN least(greatest(covar_pop({a}, {b}) OVER w / nullif(stddev_pop({a}) OVER w * stddev_pop({b}) OVER w, 0), -1), 1) END"
    shares = lambda up, down, size: {"P": GUARD(agg("sum", up), f"{agg('sum', size)} + 1e-12"), "N": GUARD(agg("sum", down), f"{agg('sum', size)} + 1e-12"), "D": GUARD(f"{agg('sum', up)} - {agg('sum', down)}", f"{agg('sum', size)} + 1e-12")}
    return {
        "ROC": GUARD(f"lag(close, {w}) OVER h", "close"), "MA": GUARD(agg("avg", "close"), "close"), "STD": GUARD(agg("stddev_samp", "close"), "close"), "BETA": GUARD(whole(slope), "close"),
        "RSQR": whole(f"{line} * {line} / ({square} * (var_pop(close) OVER w * {w}) + 1e-12)"), "RESI": GUARD(whole(f"close - avg(close) OVER w - {slope} * {(w - 1) / 2}"), "close"),
        "MAX": GUARD(agg("max", "high"), "close"), "MIN": GUARD(agg("min", "low"), "close"), "QTLU": GUARD(whole("quantile_cont(close, 0.8) OVER w"), "close"), "QTLD": GUARD(whole("quantile_cont(close, 0.2) OVER w"), "close"),
        "RANK": whole(f"len(list_filter(list(close) OVER w, lambda v: v <= close)) / {w}.0::DOUBLE"), "RSV": GUARD(f"close - {agg('min', 'low')}", f"{agg('max', 'high')} - {agg('min', 'low')} + 1e-12"),
        "IMAX": GUARD(at("max", "high"), w), "IMIN": GUARD(at("min", "low"), w), "IMXD": GUARD(f"{at('max', 'high')} - {at('min', 'low')}", w), "CORR": corr("close", "log_vol"), "CORD": corr("step", "vol_step"),
        "CNTP": agg("avg", "rose"), "CNTN": agg("avg", "fell"), "CNTD": f"{agg('avg', 'rose')} - {agg('avg', 'fell')}", **{f"SUM{k}": v for k, v in shares("up", "down", "size").items()},
        "VMA": GUARD(agg("avg", "vol"), "vol + 1e-12"), "VSTD": GUARD(agg("stddev_samp", "vol"), "vol + 1e-12"), "WVMA": GUARD(agg("stddev_samp", "moved"), f"{agg('avg', 'moved')} + 1e-12"), **{f"VSUM{k}": v for k, v in shares("vol_up", "vol_down", "vol_size").items()},
    }


def features_sql() -> str:
    parts = [("bar", {name.upper(): sql for name, sql in BAR_SQL.items()}, 1, "")] + [(f"f{w}", rolling_sql(w), w, str(w)) for w in WINDOWS]
    tables = ",\n".join(
        f"{name} AS (SELECT {', '.join(f'{sql} AS {c}' for c, sql in found.items())} FROM stepped WINDOW h AS (PARTITION BY ts_code ORDER BY trade_date), w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW))"
        for name, found, w, _ in parts
    )
    rows = " UNION ALL ".join(f"SELECT unnest([{', '.join(repr(c + end) for c in found)}]) AS feature, unnest([{', '.join(f'{c}::DOUBLE' for c in found)}]) AS value FROM {name}" for name, found, _, end in parts)
    return f"""WITH {PANEL_SQL},
before AS (SELECT *, row_number() OVER h AS rn, lag(close) OVER h AS lc, lag(vol) OVER h AS lv FROM panel WINDOW h AS (PARTITION BY ts_code ORDER BY trade_date)),
stepped AS (SELECT *, ln(abs(vol + 1) + 1e-9) AS log_vol, close / (lc + 1e-12 + 1e-12) AS step, ln(abs(vol / (lv + 1e-12 + 1e-12) + 1) + 1e-9) AS vol_step, abs(close / (lc + 1e-12 + 1e-12) - 1) * vol AS moved,
  CASE WHEN close > lc THEN 1.0 WHEN lc IS NOT NULL THEN 0.0 END::DOUBLE AS rose, CASE WHEN close < lc THEN 1.0 WHEN lc IS NOT NULL THEN 0.0 END::DOUBLE AS fell, CASE WHEN lc IS NOT NULL THEN greatest(close - lc, 0) END AS up, CASE WHEN lc IS NOT NULL THEN greatest(lc - close, 0) END AS down, abs(close - lc) AS size,
  CASE WHEN lv IS NOT NULL THEN greatest(vol - lv, 0) END AS vol_up, CASE WHEN lv IS NOT NULL THEN greatest(lv - vol, 0) END AS vol_down, abs(vol - lv) AS vol_size FROM before),
{tables}
SELECT feature, count(value) AS n, {rounded_sql("avg(value)", 4)} AS mean FROM ({rows}) GROUP BY feature"""


NESTED: dict[str, tuple[str, str, int]] = {
    "rank_of_returns": ("rank(returns(close,4))", "WITH {base}, s AS (SELECT *, close / (lag(close, 4) OVER (PARTITION BY ts_code ORDER BY trade_date) + 1e-12) - 1 AS x FROM base) SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, round(CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, x) - 1) / 2.0::DOUBLE) / (count(x) OVER (PARTITION BY trade_date) + 1e-12) END, 9) AS factor FROM s", 9),
    "mean_of_rank": ("ts_mean(rank(close),5)", "WITH {base}, s AS (SELECT *, (rank() OVER (PARTITION BY trade_date ORDER BY close) + (count(*) OVER (PARTITION BY trade_date, close) - 1) / 2.0::DOUBLE) / (count(close) OVER d + 1e-12) AS x FROM base WINDOW d AS (PARTITION BY trade_date)) SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, round(CASE WHEN count(x) OVER w = 5 THEN avg(x) OVER w END, 9) AS factor FROM s WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", 9),
    "residual_of_ranks": ("cs_residual(rank(ts_mean(close,5)),rank(vol))", "WITH {base}, s AS (SELECT *, CASE WHEN count(close) OVER w = 5 THEN round(avg(close) OVER w, 9) END AS m FROM base WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), r AS (SELECT *, CASE WHEN m IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY m NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, m) - 1) / 2.0::DOUBLE) / (count(m) OVER d + 1e-12) END AS y, (rank() OVER (PARTITION BY trade_date ORDER BY vol) + (count(*) OVER (PARTITION BY trade_date, vol) - 1) / 2.0::DOUBLE) / (count(vol) OVER d + 1e-12) AS v FROM s WINDOW d AS (PARTITION BY trade_date)), q AS (SELECT *, CASE WHEN y IS NOT NULL THEN v END AS x FROM r) SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, round(CASE WHEN count(y) OVER d >= 3 AND y IS NOT NULL THEN y - avg(y) OVER d - covar_pop(y, x) OVER d / nullif(var_pop(x) OVER d, 0) * (x - avg(x) OVER d) END, 7) + 0.0 AS factor FROM q WINDOW d AS (PARTITION BY trade_date)", 7),
}


def queries() -> dict:
    found = {f"dsl_{name}": partial(run_expression, text=text, digits=digits) for name, (text, _, digits) in (DSL | NESTED).items()}
    return found | {"features_bar": bar_features, "features_rolling": rolling_features}


def oracle_sql() -> dict[str, str]:
    found = {f"dsl_{name}": f"WITH {BASE_SQL} SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, {rounded_sql(sql, digits)} AS factor FROM base {WINDOWS_SQL}" for name, (_, sql, digits) in DSL.items()}
    found |= {f"dsl_{name}": sql.replace("{base}", BASE_SQL) for name, (_, sql, _) in NESTED.items()}
    found["features_bar"] = f"WITH {PANEL_SQL} SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, {', '.join(f'round({sql}, 6) + 0.0 AS {name}' for name, sql in BAR_SQL.items())} FROM panel"
    found["features_rolling"] = features_sql()
    return found
