"""Queries over stored panels and what describes them: the panel's contract and partitions, slices of history, samples, sketches, composed and rewritten expressions, how many trials count; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.ranges import shared_folder
from weftline.operators import evaluate, paths, search, stats
from weftline.plans.compiler import factor, with_history
from weftline.plans.dsl_queries import PANEL_SQL, SINGLE, WINDOWS_SQL, panel, rounded_sql
from weftline.plans.expression import compose, parse, upgrade_correlation
from weftline.plans.panel_queries import DAY, ROWS_SQL, SERIES_SQL, out, r, rows, series
from weftline.sources.panel import load_panel, panel_points, supplier_panel, table

START, END = "1997-01-01", "1997-06-30"
FIELDS = ("open", "high", "low", "close", "vol", "amount", "vwap")
TERMS = [("returns(close,4)", 0.5, 1), ("vol", 0.25, -1), ("close-open", 0.25, 1)]


def store(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the supplier panel, written by year as a panel on disk is, some rows flagged as invalid."""
    folder = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    flagged = supplier_panel(spark, sf_dir).drop("vwap").withColumns({"valid_bar": F.col("vol") >= 20, "raw_close": F.when(F.col("vol") < 40, F.col("close") * 2), "adj_factor": F.when(F.col("ts_code") % 2 == 0, 1.5), "trade_year": F.year("trade_date")})
    flagged.write.partitionBy("trade_year").parquet(folder)
    return folder


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_panel(spark, store(spark, sf_dir))


def panel_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stored(spark, sf_dir), "ts_code", "can_buy_open_proxy", days=("trade_date",), raw_open=None, raw_close=SINGLE, adjustment_factor=3, vwap=SINGLE)


def panel_history_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor over half a year from the rows that it needs."""
    found = factor(with_history(stored(spark, sf_dir), "ts_mean(close,5)", START, END), "ts_mean(close,5)")
    return out(found.filter(F.col("trade_date").between(F.lit(START), F.lit(END))), "ts_code", days=("trade_date",), factor=SINGLE)


def panel_points_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes on the days on which each supplier shipped most in 1996."""
    folder = store(spark, sf_dir)
    asked = panel(spark, sf_dir).filter(F.year("trade_date") == 1996).groupBy("ts_code").agg(F.max_by("trade_date", F.struct("vol", "trade_date")).alias("trade_date"))
    return out(panel_points(spark, folder, asked), "ts_code", days=("trade_date",), close=None, vol=None)


def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.monthly(series(spark, sf_dir), "ts_code").withColumn("ret", F.round("ret", 6) + 0.0)


def return_path_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.monthly_path(monthly_returns(spark, sf_dir), "ts_code", "ret")
    text = F.array_join(F.transform("path", lambda x: F.when(x.isNotNull(), F.format_string("%.6f", x)).otherwise("-")), "|")
    return out(found.withColumn("path", text), "ts_code", "path", "fingerprint", days=("last",))


def ic_path_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a factor's rank correlations by layer."""
    ic = evaluate.daily_ic(rows(spark, sf_dir)).withColumn("month", F.date_trunc("month", F.col("trade_date")).cast("date"))
    found = paths.monthly_path(ic.groupBy("layer", "month").agg((F.round(F.avg("rank_ic"), 6) + 0.0).alias("ic")), "layer", "ic")
    text = F.array_join(F.transform("path", lambda x: F.when(x.isNotNull(), F.format_string("%.6f", x)).otherwise("-")), "|")
    return out(found.withColumn("path", text), "layer", "path", "fingerprint", days=("last",))


def sleeves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("sector", (F.col("ts_code") % 5).cast("int")).groupBy("sector", "trade_date").agg(F.avg("ret").alias("ret"))


def sleeve_rolling_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(search.rolling_correlation(sleeves(spark, sf_dir), "sector", "trade_date", "ret", 60, 20), "a", "b", "n", days=("trade_date",), correlation=6)


def sleeve_monthly_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each month over all months so far."""
    months = stats.monthly(sleeves(spark, sf_dir), "sector")
    return out(search.rolling_correlation(months, "sector", "month", "ret", 10**6, 6), "a", "b", "n", days=("month",), correlation=6)


def entities_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.sampled_entities(panel(spark, sf_dir), 4), "ts_code", days=("trade_date",), close=None)


def signal_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.signal_sketch(rows(spark, sf_dir)), "layer", "bucket", "n", signal=8)


def composed_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(factor(panel(spark, sf_dir), compose(TERMS, FIELDS)), "ts_code", days=("trade_date",), factor=8)


def upgraded_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(factor(panel(spark, sf_dir), upgrade_correlation(parse("ts_corr(close,vol,5)*2", FIELDS)).text()), "ts_code", days=("trade_date",), factor=5)


def effective_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["close", "vol", "amount"]
    return out(search.effective_trials(evaluate.factor_correlations(panel(spark, sf_dir), names), len(names)), "trials", effective=6)


def mechanism_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(search.information(table(spark, sf_dir, "events"), "user_id", "event_type"), "user_id", "n", "names", entropy=8, effective=7)


PAIRS = (("close", "vol"), ("close", "amount"), ("vol", "amount"))
RANK = "(rank() OVER (PARTITION BY trade_date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0::DOUBLE) / (count({c}) OVER (PARTITION BY trade_date) + 1e-12)"
HASH = lambda text, modulus: f"('0x' || substr(md5({text}), 1, 8))::BIGINT % {modulus}"
PATH_SQL = """ends AS (SELECT k, max(month) AS last FROM monthly GROUP BY k),
grid AS (SELECT k, last, i, CAST(last - to_months(i::INT) AS DATE) AS month FROM ends, range(24) t(i)),
told AS (SELECT g.k, g.last, string_agg(coalesce(printf('%.6f', m.v), '-'), '|' ORDER BY g.i DESC) AS path FROM grid g LEFT JOIN monthly m ON m.k = g.k AND m.month = g.month GROUP BY ALL)"""
SLEEVES_SQL = f"{SERIES_SQL}, sleeves AS (SELECT (ts_code % 5)::INT AS sector, trade_date, avg(ret) AS ret FROM series GROUP BY ALL)"
SQL = {
    "panel_points_read": f"WITH {PANEL_SQL}, m AS (SELECT ts_code, arg_max(trade_date, (vol, trade_date)) AS trade_date FROM panel WHERE year(trade_date) = 1996 GROUP BY ts_code) SELECT ts_code, {DAY}, close + 0.0 AS close, vol + 0.0 AS vol FROM panel JOIN m USING (ts_code, trade_date) WHERE vol >= 20",
    "return_path_months": f"WITH {SERIES_SQL}, monthly AS (SELECT ts_code AS k, CAST(date_trunc('month', trade_date) AS DATE) AS month, round(exp(sum(ln(1 + ret))) - 1, 6) + 0.0 AS v FROM series GROUP BY ALL), {PATH_SQL} SELECT k AS ts_code, path, substr(sha256(path), 1, 16) AS fingerprint, last::VARCHAR AS last FROM told",
    "ic_path_months": f"WITH {ROWS_SQL}, monthly AS (SELECT layer AS k, CAST(date_trunc('month', trade_date) AS DATE) AS month, round(avg(rank_ic), 6) + 0.0 AS v FROM ics GROUP BY ALL), {PATH_SQL} SELECT k AS layer, path, substr(sha256(path), 1, 16) AS fingerprint, last::VARCHAR AS last FROM told",
    "sleeve_rolling_correlation": f"WITH {SLEEVES_SQL}, j AS (SELECT x.sector AS a, y.sector AS b, x.trade_date, x.ret AS p, y.ret AS q FROM sleeves x JOIN sleeves y ON x.trade_date = y.trade_date AND x.sector < y.sector) SELECT a, b, count(*) OVER w AS n, {DAY}, round(CASE WHEN count(*) OVER w >= 20 THEN covar_pop(p, q) OVER w / nullif(stddev_pop(p) OVER w * stddev_pop(q) OVER w, 0) END, 6) + 0.0 AS correlation FROM j WINDOW w AS (PARTITION BY a, b ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
    "sleeve_monthly_correlation": f"WITH {SLEEVES_SQL}, mm AS (SELECT sector, CAST(date_trunc('month', trade_date) AS DATE) AS month, exp(sum(ln(1 + ret))) - 1 AS ret FROM sleeves GROUP BY ALL), j AS (SELECT x.sector AS a, y.sector AS b, x.month, x.ret AS p, y.ret AS q FROM mm x JOIN mm y ON x.month = y.month AND x.sector < y.sector) SELECT a, b, count(*) OVER w AS n, month::VARCHAR AS month, round(CASE WHEN count(*) OVER w >= 6 THEN covar_pop(p, q) OVER w / nullif(stddev_pop(p) OVER w * stddev_pop(q) OVER w, 0) END, 6) + 0.0 AS correlation FROM j WINDOW w AS (PARTITION BY a, b ORDER BY month)",
    "panel_loaded": f"WITH {PANEL_SQL} SELECT ts_code, {DAY}, true AS can_buy_open_proxy, open + 0.0 AS raw_open, {rounded_sql('CASE WHEN vol < 40 THEN close * 2 ELSE close END', SINGLE)} AS raw_close, CASE WHEN ts_code % 2 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS adjustment_factor, {rounded_sql('vwap', SINGLE)} AS vwap FROM panel WHERE vol >= 20",
    "panel_history_slice": f"WITH {PANEL_SQL}, f AS (SELECT ts_code, trade_date, CASE WHEN count(close) OVER w = 5 THEN avg(close) OVER w END AS m FROM panel WHERE vol >= 20 WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT ts_code, {DAY}, {rounded_sql('m', SINGLE)} AS factor FROM f WHERE trade_date BETWEEN DATE '{START}' AND DATE '{END}'",
    "entities_sampled": f"WITH {PANEL_SQL} SELECT ts_code, {DAY}, close + 0.0 AS close FROM panel WHERE {HASH('ts_code::VARCHAR', 4)} = 0",
    "signal_sketch": f"WITH {ROWS_SQL} SELECT layer, ({HASH('ts_code::VARCHAR || chr(47) || trade_date::VARCHAR', 32)})::INT AS bucket, count(*) AS n, {r(8, signal='avg(pct - 0.5)')} FROM rws GROUP BY ALL",
    "composed_factor": f"WITH {PANEL_SQL}, s AS (SELECT *, close / (lag(close, 4) OVER (PARTITION BY ts_code ORDER BY trade_date) + 1e-12) - 1 AS a, vol AS b, close - open AS c FROM panel) SELECT ts_code, {DAY}, round(CASE WHEN a IS NOT NULL THEN 0.5::DOUBLE * {RANK.format(c='a')} - 0.25::DOUBLE * {RANK.format(c='b')} + 0.25::DOUBLE * {RANK.format(c='c')} END, 8) + 0.0 AS factor FROM s",
    "upgraded_correlation": f"WITH {PANEL_SQL} SELECT ts_code, {DAY}, round(CASE WHEN count(close) OVER w = 5 THEN least(greatest(covar_pop(close, vol) OVER w / nullif(stddev_pop(close) OVER w * stddev_pop(vol) OVER w, 0), -1), 1) * 2 END, 5) + 0.0 AS factor FROM panel {WINDOWS_SQL}",
    "effective_trials": f"""WITH {PANEL_SQL}, k AS (SELECT trade_date, {', '.join(f"rank() OVER (PARTITION BY trade_date ORDER BY {c}) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0::DOUBLE AS {c}" for c in ('close', 'vol', 'amount'))} FROM panel),
d AS ({' UNION ALL '.join(f"SELECT '{a}{b}' AS p, covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS c FROM k GROUP BY trade_date" for a, b in PAIRS)}), m AS (SELECT avg(c) AS c FROM d GROUP BY p) SELECT 3::INT AS trials, round(9.0::DOUBLE / (3 + 2 * sum(c * c)), 6) + 0.0 AS effective FROM m""",
    "mechanism_information": f"WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), g AS (SELECT user_id, sum(c)::BIGINT AS n, count(*) AS names, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS e FROM c GROUP BY user_id) SELECT user_id, n, names, {r(8, entropy='e')}, {r(7, effective='exp(e)')} FROM g",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return SQL
