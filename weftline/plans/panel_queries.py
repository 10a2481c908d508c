"""Queries over the supplier panel for the screener, the evaluator, return statistics and the vector back-test, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.windows import history
from weftline.operators import evaluate, screener, stats, vector
from weftline.plans.compiler import factor
from weftline.plans.dsl_queries import PANEL_SQL, SINGLE, day_text, panel, rounded, rounded_sql
from weftline.sources.panel import LAYERS, calendar, user_panel, with_labels, with_universe

HORIZON = 5
EXPRESSION = "returns(close,4)"


def out(df: DataFrame, *plain: str, days: tuple[str, ...] = (), **digits: int) -> DataFrame:
    return df.select(*[F.col(c) for c in plain], *[day_text(c) for c in days], *[(F.col(c) if d is None else rounded(F.col(c).cast("double"), d)).alias(c) for c, d in digits.items()])


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(with_universe(panel(spark, sf_dir), decimals=2), "ts_code", "univ_rank", "era", "layer", days=("trade_date",), amt60=SINGLE)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(with_labels(panel(spark, sf_dir)), "ts_code", "market_session_index", days=("trade_date", "label_entry_date", "label_exit_date_5"), fwd_1=8, fwd_5=8, fwd_10=8, fwd_20=8)


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor(with_labels(with_universe(panel(spark, sf_dir), decimals=2), (HORIZON,)), EXPRESSION)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluation_rows(ready(spark, sf_dir), HORIZON)


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(rows(spark, sf_dir), "ts_code", "layer", days=("trade_date",), pct=9, label_rank=6)


def eval_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.decile_table(rows(spark, sf_dir)), "layer", "decile", "n", mean_return=6)


def eval_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.daily_ic(rows(spark, sf_dir)), "layer", "n", days=("trade_date",), ic=7, rank_ic=7)


def eval_ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.ic_summary(evaluate.daily_ic(rows(spark, sf_dir)), HORIZON), "layer", "n", mean=7, std=7, positive=7, icir=6)


def eval_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.daily_portfolio(evaluate.legs(rows(spark, sf_dir)), HORIZON), "layer", "n", days=("trade_date",), gross=7, turnover=7)


def eval_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.preflight(factor(panel(spark, sf_dir), EXPRESSION)), "n", "n_finite", "n_distinct", days=("trade_date",), std=4, mean_abs=4)


def eval_preflight_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.preflight_decision(evaluate.preflight(factor(panel(spark, sf_dir), EXPRESSION))), "usable", "passes", coverage=7)


def eval_factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.factor_correlations(panel(spark, sf_dir), ["close", "vol", "amount"]), "a", "b", "n", correlation=7)


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.previous_close(panel(spark, sf_dir)), "ts_code", days=("trade_date",), close=None)


def user_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(user_panel(spark, sf_dir), "ts_code", days=("trade_date",), open=4, close=4, high=4, low=4, vol=1, amount=3)


def market_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(panel(spark, sf_dir)).select(day_text(), F.col("market_session_index").cast("long").alias("market_session_index"))


def screen_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screener.screen(with_universe(panel(spark, sf_dir), decimals=2), [("returns(close,4)", 2.0, 1), ("ts_mean(vol,5)", 1.0, -1)], "2000-06-30", k=15, universe=80)
    return out(found, "ts_code", "side", "place", score=7, rank_1=7, rank_2=7)


def execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(screener.execution_inputs(panel(spark, sf_dir)), "ts_code", days=("trade_date",), prev_close=None, adv_prev=5, atr_pct=5, vol_prev=4)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped weekly returns of each supplier, and the market's mean."""
    p = panel(spark, sf_dir).withColumn("before", F.lag("close").over(history()))
    p = p.filter("before is not null").select("ts_code", "trade_date", F.least(F.greatest(F.col("close") / F.col("before") - 1, F.lit(-0.02)), F.lit(0.02)).alias("ret"))
    return p.join(p.groupBy("trade_date").agg(F.avg("ret").alias("market")), "trade_date")


def stats_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.series_stats(series(spark, sf_dir), "ts_code", 52), "ts_code", "n", final_nav=6, max_drawdown=7, win_rate=7, tail_mean=7, annual_return=7, annual_volatility=7, sharpe=6, sortino=6, calmar=5)


def stats_newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.newey_west(series(spark, sf_dir), "ts_code", 4), "ts_code", "n", mean=8, se=8, t=6)


def stats_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.confidence_bounds(series(spark, sf_dir), "ts_code", 4), "ts_code", lower=8, upper=8)


def stats_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.moments(series(spark, sf_dir), "ts_code"), "ts_code", "n", sharpe=7, skew=7, kurtosis=7)


def stats_psr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.probabilistic_sharpe(series(spark, sf_dir), "ts_code"), "ts_code", psr=6)


def stats_market_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.market_model(series(spark, sf_dir), "ts_code"), "ts_code", "n", beta=6, correlation=6, alpha=7)


def stats_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.monthly(series(spark, sf_dir), "ts_code"), "ts_code", "n", days=("month",), ret=7)


def stats_rolling_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.rolling_months(series(spark, sf_dir), "ts_code", 12, 30), "ts_code", "n", days=("month_end",), ret=6, sharpe=6)


def stats_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.with_nav(series(spark, sf_dir), "ts_code"), "ts_code", days=("trade_date",), nav=6, drawdown=6)


def stats_volatility_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.volatility_target(series(spark, sf_dir), "ts_code", 0.29), "ts_code", days=("trade_date",), scale=6, scaled=7)


def stats_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.regime(series(spark, sf_dir), "ts_code", 20), "ts_code", "on", days=("trade_date",))


def stats_false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = stats.newey_west(series(spark, sf_dir), "ts_code", 4).select(F.col("ts_code").alias("id"), F.round(2 * (1 - stats.normal_cdf(F.abs("t"))), 6).alias("p"))
    return out(stats.benjamini_hochberg(tests), "id", p=6, q=6)


def vector_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(vector.vector_backtest(ready(spark, sf_dir), HORIZON, universe=60, short=True), "n", days=("trade_date",), cost_bps=2, gross=7, turnover=7, net=7, benchmark=7)


def vector_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(vector.training_direction(evaluate.daily_ic(rows(spark, sf_dir))), "direction", mean=7)


def fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("side", F.when(F.col("l_linenumber") % 2 == 0, "sell").otherwise("buy"))
    day = F.add_months(F.col("l_shipdate").cast("date"), 288)
    return lines.groupBy("side").agg(F.sum(vector.fees_a_share(F.col("side"), F.col("l_extendedprice"), day)).cast("double").alias("a_share"), F.sum(vector.fees_us(F.col("l_quantity"), F.col("l_extendedprice"))).cast("double").alias("us"))


ENDS = " ".join(f"WHEN '{x.name}' THEN DATE '{x.end}'" for x in LAYERS)
UNI_SQL = f"""{PANEL_SQL},
amounts AS (SELECT *, CASE WHEN count(amount) OVER w60 >= 20 THEN avg(amount) OVER w60 END AS amt60 FROM panel WINDOW w60 AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
uni AS (SELECT *, CASE WHEN amt60 IS NOT NULL THEN row_number() OVER (PARTITION BY trade_date ORDER BY amt60 DESC NULLS LAST, ts_code) END::INT AS univ_rank, year(trade_date)::INT AS era,
  CASE {' '.join(f"WHEN trade_date BETWEEN DATE '{x.start}' AND DATE '{x.end}' THEN '{x.name}'" for x in LAYERS)} ELSE 'NONE' END AS layer FROM amounts),
days AS (SELECT DISTINCT trade_date FROM panel),
cal AS (SELECT trade_date, (row_number() OVER c - 1)::INT AS idx, lead(trade_date, 1) OVER c AS entry, lead(trade_date, 2) OVER c AS exit1, lead(trade_date, 6) OVER c AS exit5, lead(trade_date, 11) OVER c AS exit10, lead(trade_date, 21) OVER c AS exit20 FROM days WINDOW c AS (ORDER BY trade_date)),
lab AS (SELECT u.*, c.idx, c.entry, c.exit5, x1.open / e.open - 1 AS fwd_1, x5.open / e.open - 1 AS fwd_5, x10.open / e.open - 1 AS fwd_10, x20.open / e.open - 1 AS fwd_20, u.close / (lag(u.close, 4) OVER (PARTITION BY u.ts_code ORDER BY u.trade_date) + 1e-12) - 1 AS factor
  FROM uni u JOIN cal c USING (trade_date) LEFT JOIN panel e ON e.ts_code = u.ts_code AND e.trade_date = c.entry LEFT JOIN panel x1 ON x1.ts_code = u.ts_code AND x1.trade_date = c.exit1
  LEFT JOIN panel x5 ON x5.ts_code = u.ts_code AND x5.trade_date = c.exit5 LEFT JOIN panel x10 ON x10.ts_code = u.ts_code AND x10.trade_date = c.exit10 LEFT JOIN panel x20 ON x20.ts_code = u.ts_code AND x20.trade_date = c.exit20)"""
ROWS_SQL = f"""{UNI_SQL},
places AS (SELECT layer, trade_date, row_number() OVER (PARTITION BY layer ORDER BY trade_date) - 1 AS place FROM (SELECT DISTINCT layer, trade_date FROM uni)),
kept AS (SELECT * FROM (SELECT l.*, p.place, l.fwd_5 AS label, stddev_samp(factor) OVER (PARTITION BY trade_date) AS spread, avg(abs(factor)) OVER (PARTITION BY trade_date) AS size FROM lab l JOIN places p USING (layer, trade_date) WHERE layer <> 'NONE' AND place >= 5 AND exit5 <= CASE layer {ENDS} END AND place % 5 = 0 AND factor IS NOT NULL) WHERE spread > (size + 1) * 1e-10 AND label IS NOT NULL),
rws AS (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n_day,
  (rank() OVER (PARTITION BY trade_date ORDER BY factor) + (count(*) OVER (PARTITION BY trade_date, factor) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY trade_date) AS pct,
  rank() OVER (PARTITION BY trade_date ORDER BY label) + (count(*) OVER (PARTITION BY trade_date, label) - 1) / 2.0::DOUBLE AS label_rank FROM kept),
ics AS (SELECT layer, trade_date, count(*) AS n, covar_pop(factor, label) / nullif(stddev_pop(factor) * stddev_pop(label), 0) AS ic, covar_pop(pct, label_rank) / nullif(stddev_pop(pct) * stddev_pop(label_rank), 0) AS rank_ic FROM rws GROUP BY ALL HAVING count(*) >= 50)"""
SERIES_SQL = f"""{PANEL_SQL},
moves AS (SELECT ts_code, trade_date, least(greatest(close / lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1, -0.02::DOUBLE), 0.02::DOUBLE) AS ret, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS b FROM panel),
series AS (SELECT ts_code, trade_date, ret, avg(ret) OVER (PARTITION BY trade_date) AS market FROM moves WHERE b IS NOT NULL),
nav AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ts_code ORDER BY trade_date)) AS nav FROM series),
dd AS (SELECT *, 1 - nav / greatest(1, max(nav) OVER (PARTITION BY ts_code ORDER BY trade_date)) AS drawdown FROM nav),
devs AS (SELECT *, ret - avg(ret) OVER (PARTITION BY ts_code) AS dev FROM series),
lagged AS (SELECT *, dev * lag(dev, 1) OVER o AS p1, dev * lag(dev, 2) OVER o AS p2, dev * lag(dev, 3) OVER o AS p3, dev * lag(dev, 4) OVER o AS p4 FROM devs WINDOW o AS (PARTITION BY ts_code ORDER BY trade_date)),
nw AS (SELECT ts_code, count(*) AS n, avg(ret) AS mean, CASE WHEN count(*) >= 30 THEN sqrt(greatest(sum(dev * dev) + 2 * 0.8::DOUBLE * coalesce(sum(p1), 0) + 2 * 0.6::DOUBLE * coalesce(sum(p2), 0) + 2 * 0.4::DOUBLE * coalesce(sum(p3), 0) + 2 * 0.2::DOUBLE * coalesce(sum(p4), 0), 0)) / count(*) END AS se FROM lagged GROUP BY ts_code),
mom AS (SELECT ts_code, count(*) AS n, avg(ret) / nullif(sqrt(sum(dev * dev) / (count(*) - 1)), 0) AS sharpe, sum(dev * dev * dev) / count(*) / nullif(pow(sum(dev * dev) / count(*), 1.5), 0) AS skew, sum(dev * dev * dev * dev) / count(*) / nullif(pow(sum(dev * dev) / count(*), 2), 0) AS kurtosis FROM devs GROUP BY ts_code)"""
CDF = lambda z: f"(CASE WHEN {z} >= 0 THEN 1 - {TAIL.format(x=f'(abs({z}) / sqrt(2))')} / 2 ELSE {TAIL.format(x=f'(abs({z}) / sqrt(2))')} / 2 END)"
T = "(1 / (1 + 0.3275911::DOUBLE * {x}))"
TAIL = f"({T} * (0.254829592::DOUBLE + {T} * (-0.284496736::DOUBLE + {T} * (1.421413741::DOUBLE + {T} * (-1.453152027::DOUBLE + {T} * 1.061405429::DOUBLE)))) * exp(-{{x}} * {{x}}))"
DAY = "CAST(trade_date AS VARCHAR) AS trade_date"


def r(digits: int, **columns: str) -> str:
    return ", ".join(f"{rounded_sql(sql, digits)} AS {name}" for name, sql in columns.items())


def same(digits: int, *names: str) -> str:
    return r(digits, **{n: n for n in names})


SQL = {
    "panel_universe": f"WITH {UNI_SQL} SELECT ts_code, univ_rank, era, layer, {DAY}, {same(SINGLE, 'amt60')} FROM uni",
    "panel_labels": f"WITH {UNI_SQL} SELECT ts_code, idx AS market_session_index, {DAY}, CAST(entry AS VARCHAR) AS label_entry_date, CAST(exit5 AS VARCHAR) AS label_exit_date_5, {same(8, 'fwd_1', 'fwd_5', 'fwd_10', 'fwd_20')} FROM lab",
    "panel_calendar": f"WITH {UNI_SQL} SELECT {DAY}, idx::BIGINT AS market_session_index FROM cal",
    "panel_carry_forward": f"WITH {PANEL_SQL}, grid AS (SELECT * FROM (SELECT DISTINCT ts_code FROM panel), (SELECT DISTINCT trade_date FROM panel)) SELECT g.ts_code, CAST(g.trade_date AS VARCHAR) AS trade_date, (last_value(p.close IGNORE NULLS) OVER (PARTITION BY g.ts_code ORDER BY g.trade_date)) AS close FROM grid g LEFT JOIN panel p ON p.ts_code = g.ts_code AND p.trade_date = g.trade_date",
    "panel_user": "SELECT user_id AS ts_code, CAST(CAST(ts AS DATE) AS VARCHAR) AS trade_date, round(first(value ORDER BY ts, event_id), 4) + 0.0 AS open, round(last(value ORDER BY ts, event_id), 4) + 0.0 AS close, round(max(value), 4) + 0.0 AS high, round(min(value), 4) + 0.0 AS low, count(*)::DOUBLE AS vol, round(round(sum(value), 4), 3) + 0.0 AS amount FROM events WHERE value IS NOT NULL GROUP BY user_id, CAST(ts AS DATE)",
    "eval_rows": f"WITH {ROWS_SQL} SELECT ts_code, layer, {DAY}, {same(9, 'pct')}, {same(6, 'label_rank')} FROM rws",
    "eval_deciles": f"WITH {ROWS_SQL} SELECT layer, least(greatest(ceil(pct * 10), 1), 10)::INT AS decile, count(*) AS n, round(avg(label), 6) + 0.0 AS mean_return FROM rws GROUP BY ALL",
    "eval_ic": f"WITH {ROWS_SQL} SELECT layer, n, {DAY}, {same(7, 'ic', 'rank_ic')} FROM ics",
    "eval_ic_summary": f"WITH {ROWS_SQL} SELECT layer, count(rank_ic) AS n, {r(7, mean='avg(rank_ic)', std='stddev_samp(rank_ic)', positive='avg((rank_ic > 0)::INT::DOUBLE)')}, round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) * sqrt(252 / 5.0), 6) + 0.0 AS icir FROM ics GROUP BY layer",
    "eval_portfolio": f"""WITH {ROWS_SQL},
w AS (SELECT *, CASE WHEN pct >= 0.8::DOUBLE THEN 1.0::DOUBLE / sum((pct >= 0.8::DOUBLE)::INT) OVER (PARTITION BY trade_date) WHEN pct <= 0.2::DOUBLE THEN -1.0::DOUBLE / sum((pct <= 0.2::DOUBLE)::INT) OVER (PARTITION BY trade_date) ELSE 0 END AS weight FROM rws),
o AS (SELECT *, CASE WHEN lag(place) OVER e = place - 5 THEN lag(weight) OVER e ELSE 0 END AS old FROM w WINDOW e AS (PARTITION BY layer, ts_code ORDER BY trade_date)),
d AS (SELECT layer, trade_date, count(*) AS n, sum(weight * label) AS gross, sum(abs(weight)) AS exposure, sum(abs(weight - coalesce(old, 0))) AS changed, sum(abs(coalesce(old, 0))) AS matched FROM o GROUP BY ALL)
SELECT layer, n, {DAY}, {same(7, 'gross')}, round(changed + greatest(coalesce(lag(exposure) OVER (PARTITION BY layer ORDER BY trade_date), 0) - matched, 0), 7) + 0.0 AS turnover FROM d""",
    "eval_preflight": f"WITH {UNI_SQL} SELECT {DAY}, count(*) AS n, count(factor) AS n_finite, count(DISTINCT factor) AS n_distinct, {r(4, std='stddev_samp(factor)', mean_abs='avg(abs(factor))')} FROM lab GROUP BY trade_date",
    "eval_preflight_decision": f"WITH {UNI_SQL}, d AS (SELECT count(*) AS n, count(factor) AS f, count(DISTINCT factor) AS k, stddev_samp(factor) AS s, avg(abs(factor)) AS m FROM lab GROUP BY trade_date) SELECT sum((coalesce(k >= 3 AND s > greatest(1e-10, m * 1e-10), false))::INT)::BIGINT AS usable, sum(f) / sum(n) >= 0.02 AND usable >= 8 AS passes, round(sum(f)::DOUBLE / sum(n), 7) + 0.0 AS coverage FROM d",
    "eval_factor_correlations": f"""WITH {PANEL_SQL}, k AS (SELECT trade_date, {', '.join(f"rank() OVER (PARTITION BY trade_date ORDER BY {c}) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0::DOUBLE AS {c}" for c in ('close', 'vol', 'amount'))} FROM panel),
d AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS c FROM k GROUP BY trade_date" for a, b in (('close', 'vol'), ('close', 'amount'), ('vol', 'amount')))}) SELECT a, b, count(c) AS n, round(avg(c), 7) + 0.0 AS correlation FROM d GROUP BY a, b""",
    "screen_both": f"""WITH {UNI_SQL},
f AS (SELECT *, CASE WHEN count(vol) OVER w = 5 THEN -avg(vol) OVER w END AS f2 FROM lab WHERE trade_date <= DATE '2000-06-30' WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
t AS (SELECT * FROM f WHERE trade_date = (SELECT max(trade_date) FROM f)),
k AS (SELECT *, CASE WHEN factor IS NOT NULL THEN (rank() OVER (ORDER BY factor NULLS LAST) + (count(*) OVER (PARTITION BY factor) - 1) / 2.0::DOUBLE) / count(factor) OVER () END AS rank_1, CASE WHEN f2 IS NOT NULL THEN (rank() OVER (ORDER BY f2 NULLS LAST) + (count(*) OVER (PARTITION BY f2) - 1) / 2.0::DOUBLE) / count(f2) OVER () END AS rank_2 FROM t),
s AS (SELECT *, rank_1 * (2.0::DOUBLE / 3) + rank_2 * (1.0::DOUBLE / 3) AS score FROM k WHERE rank_1 IS NOT NULL AND rank_2 IS NOT NULL AND univ_rank <= 80),
top AS (SELECT *, 'top' AS side, row_number() OVER (ORDER BY score DESC, ts_code) AS place FROM s QUALIFY place <= 8),
bottom AS (SELECT *, 'bottom' AS side, row_number() OVER (ORDER BY score, ts_code DESC) AS place FROM s WHERE ts_code NOT IN (SELECT ts_code FROM top) QUALIFY place <= 7)
SELECT ts_code, side, place, {same(7, 'score', 'rank_1', 'rank_2')} FROM (SELECT * FROM top UNION ALL SELECT * FROM bottom)""",
    "screen_execution_inputs": f"""WITH {PANEL_SQL}, a AS (SELECT *, lag(close) OVER h AS prev_close FROM panel WINDOW h AS (PARTITION BY ts_code ORDER BY trade_date)),
b AS (SELECT *, close / prev_close - 1 AS ret, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr FROM a)
SELECT ts_code, {DAY}, prev_close, {r(5, adv_prev='avg(vol) OVER p', atr_pct='CASE WHEN count(tr) OVER q >= 10 THEN avg(tr) OVER q END / abs(close)')}, round(CASE WHEN count(ret) OVER p >= 5 THEN stddev_samp(ret) OVER p * sqrt(252) END, 4) + 0.0 AS vol_prev
FROM b WINDOW p AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "stats_series": f"""WITH {SERIES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY ret, trade_date) AS k, count(*) OVER (PARTITION BY ts_code) AS m FROM dd),
g AS (SELECT ts_code, count(*) AS n, exp(sum(ln(1 + ret))) AS final_nav, avg(ret) AS mean, stddev_samp(ret) AS sd, sqrt(avg(pow(least(ret, 0), 2))) AS down, max(drawdown) AS max_drawdown, avg((ret > 0)::INT::DOUBLE) AS win_rate, avg(ret) FILTER (WHERE k <= greatest(1, floor(m * 0.05::DOUBLE))) AS tail_mean FROM o GROUP BY ts_code)
SELECT ts_code, n, {same(6, 'final_nav')}, {r(7, max_drawdown='max_drawdown', win_rate='win_rate', tail_mean='tail_mean', annual_return='pow(final_nav, 52.0::DOUBLE / n) - 1', annual_volatility='sd * sqrt(52)')}, {r(6, sharpe='mean / nullif(sd, 0) * sqrt(52)', sortino='mean / nullif(down, 0) * sqrt(52)')}, round((pow(final_nav, 52.0::DOUBLE / n) - 1) / nullif(max_drawdown, 0), 5) + 0.0 AS calmar FROM g""",
    "stats_newey_west": f"WITH {SERIES_SQL} SELECT ts_code, n, {same(8, 'mean', 'se')}, round(CASE WHEN se > 1e-15 THEN mean / se WHEN se IS NOT NULL THEN 0 END, 6) + 0.0 AS t FROM nw",
    "stats_bounds": f"WITH {SERIES_SQL} SELECT ts_code, {r(8, lower='mean - 1.9599639845400538::DOUBLE * se', upper='mean + 1.9599639845400538::DOUBLE * se')} FROM nw",
    "stats_moments": f"WITH {SERIES_SQL} SELECT ts_code, n, {same(7, 'sharpe', 'skew', 'kurtosis')} FROM mom",
    "stats_psr": f"WITH {SERIES_SQL}, z AS (SELECT ts_code, sharpe * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, 1e-12)) AS z FROM mom) SELECT ts_code, round({CDF('z')}, 6) + 0.0 AS psr FROM z",
    "stats_market_model": f"WITH {SERIES_SQL} SELECT ts_code, count(*) AS n, {r(6, beta='covar_pop(ret, market) / nullif(var_pop(market), 0)', correlation='covar_pop(ret, market) / nullif(stddev_pop(ret) * stddev_pop(market), 0)')}, round(avg(ret) - covar_pop(ret, market) / nullif(var_pop(market), 0) * avg(market), 7) + 0.0 AS alpha FROM series GROUP BY ts_code",
    "stats_monthly": f"WITH {SERIES_SQL} SELECT ts_code, count(*) AS n, CAST(CAST(date_trunc('month', trade_date) AS DATE) AS VARCHAR) AS month, round(exp(sum(ln(1 + ret))) - 1, 7) + 0.0 AS ret FROM series GROUP BY ts_code, date_trunc('month', trade_date)",
    "stats_rolling_year": f"WITH {SERIES_SQL}, e AS (SELECT ts_code, max(trade_date) AS month_end FROM series GROUP BY ts_code, date_trunc('month', trade_date)) SELECT e.ts_code, count(*) AS n, CAST(month_end AS VARCHAR) AS month_end, round(exp(sum(ln(1 + ret))) - 1, 6) + 0.0 AS ret, round(avg(ret) / nullif(stddev_samp(ret), 0), 6) + 0.0 AS sharpe FROM e JOIN series s ON s.ts_code = e.ts_code AND s.trade_date <= month_end AND s.trade_date > month_end - INTERVAL 12 MONTH GROUP BY e.ts_code, month_end HAVING count(*) >= 30",
    "stats_drawdown": f"WITH {SERIES_SQL} SELECT ts_code, {DAY}, {same(6, 'nav', 'drawdown')} FROM dd",
    "stats_volatility_target": f"WITH {SERIES_SQL}, v AS (SELECT *, coalesce(least(greatest(0.29::DOUBLE / nullif(CASE WHEN count(ret) OVER w = 60 THEN stddev_samp(ret) OVER w * sqrt(252) END, 0), 0.25), 1.5), 1.0)::DOUBLE AS own FROM series WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), z AS (SELECT *, lag(own, 1, 1.0) OVER (PARTITION BY ts_code ORDER BY trade_date) AS scale FROM v) SELECT ts_code, {DAY}, {same(6, 'scale')}, round(ret * scale, 7) + 0.0 AS scaled FROM z",
    "stats_regime": f"""WITH {SERIES_SQL}, v AS (SELECT *, CASE WHEN count(ret) OVER w = 20 THEN (sum(ln(1 + ret)) OVER w > 0)::INT ELSE 1 END AS own FROM series WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT ts_code, {DAY}, lag(own, 1, 1) OVER (PARTITION BY ts_code ORDER BY trade_date) AS "on" FROM v""",
    "stats_false_discovery": f"WITH {SERIES_SQL}, p AS (SELECT ts_code AS id, round(2 * (1 - {CDF('abs(mean / nullif(se, 0))')}), 6) AS p FROM nw), k AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST, id) AS place, count(p) OVER () AS m FROM p) SELECT id, {same(6, 'p')}, round(least(1, min(p * m / place) OVER (ORDER BY p NULLS LAST, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS q FROM k",
    "vector_backtest": f"""WITH {UNI_SQL},
sig AS (SELECT *, idx // 5 AS period, fwd_5 AS label FROM lab WHERE idx % 5 = 0 AND univ_rank <= 60 AND factor IS NOT NULL),
k AS (SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY trade_date) * 0.2::DOUBLE)) AS k, row_number() OVER (PARTITION BY trade_date ORDER BY factor DESC, ts_code) AS best, row_number() OVER (PARTITION BY trade_date ORDER BY factor, ts_code DESC) AS worst FROM sig),
w AS (SELECT *, CASE WHEN best <= k THEN 1.0 / k WHEN worst <= k THEN -1.0 / k END::DOUBLE AS weight FROM k WHERE best <= k OR worst <= k),
p AS (SELECT coalesce(a.period, b.period + 1) AS period, sum(coalesce(a.weight * a.label, 0)) AS gross, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover, count(a.weight) AS n FROM w a FULL JOIN w b ON a.ts_code = b.ts_code AND a.period = b.period + 1 GROUP BY 1),
m AS (SELECT trade_date, period, avg(label) AS benchmark FROM sig GROUP BY ALL)
SELECT n, {DAY}, c.cost_bps, {same(7, 'gross', 'turnover')}, round(gross - turnover * c.cost_bps / 10000, 7) + 0.0 AS net, {same(7, 'benchmark')} FROM p JOIN m USING (period), (SELECT unnest([0.0, 5.0, 10.0, 20.0]::DOUBLE[]) AS cost_bps) c WHERE n > 0""",
    "fees": """WITH l AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'sell' ELSE 'buy' END AS side, l_extendedprice AS v, l_quantity AS q, CAST(CAST(l_shipdate AS DATE) + INTERVAL 288 MONTH AS DATE) AS d FROM lineitem)
SELECT side, CAST(sum(round((v * 0.0002::DOUBLE)::DECIMAL(38,10), 2) + round((CASE WHEN side = 'sell' THEN v * CASE WHEN d < DATE '2023-08-28' THEN 0.001::DOUBLE ELSE 0.0005::DOUBLE END ELSE 0 END)::DECIMAL(38,10), 2)
  + round((v * CASE WHEN d < DATE '2022-04-29' THEN 0.00002::DOUBLE ELSE 0.00001::DOUBLE END)::DECIMAL(38,10), 2)) AS DOUBLE) AS a_share, CAST(sum(round(least(greatest(q * 0.005::DOUBLE, 1.0), v * 0.01::DOUBLE)::DECIMAL(38,10), 2)) AS DOUBLE) AS us FROM l GROUP BY side""",
    "vector_direction": f"WITH {ROWS_SQL} SELECT CASE WHEN avg(rank_ic) < 0 THEN -1 ELSE 1 END AS direction, round(avg(rank_ic), 7) + 0.0 AS mean FROM ics WHERE layer = 'TRAIN'",
}


def queries() -> dict:
    return {
        "panel_universe": universe, "panel_labels": labels, "panel_calendar": market_calendar, "panel_carry_forward": carry_forward, "panel_user": user_bars,
        "eval_rows": eval_rows, "eval_deciles": eval_deciles, "eval_ic": eval_ic, "eval_ic_summary": eval_ic_summary, "eval_portfolio": eval_portfolio, "eval_preflight": eval_preflight, "eval_preflight_decision": eval_preflight_decision, "eval_factor_correlations": eval_factor_correlations,
        "screen_both": screen_both, "screen_execution_inputs": execution,
        "stats_series": stats_series, "stats_newey_west": stats_newey_west, "stats_bounds": stats_bounds, "stats_moments": stats_moments, "stats_psr": stats_psr, "stats_market_model": stats_market_model, "stats_monthly": stats_monthly, "stats_rolling_year": stats_rolling_year, "stats_drawdown": stats_drawdown, "stats_volatility_target": stats_volatility_target, "stats_regime": stats_regime, "stats_false_discovery": stats_false_discovery,
        "vector_backtest": vector_backtest, "vector_direction": vector_direction, "fees": fees,
    }


def oracle_sql() -> dict[str, str]:
    return SQL
