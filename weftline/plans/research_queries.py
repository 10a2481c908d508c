"""Queries over the supplier panel for event studies, joins, similarity, weight search, allocation, ledgers and telemetry, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import events, ledger, paths, relational, search, similarity
from weftline.plans.compiler import factor, factors
from weftline.plans.dsl_queries import DSL, PANEL_SQL, panel
from weftline.plans.panel_queries import SERIES_SQL, UNI_SQL, out, r, same, series
from weftline.sources.panel import table, with_universe
from weftline.streaming.telemetry import latency

#: Gaps of the supplier panel are small; an event is a move of this fraction at least.
EVENT = 0.01
FIELDS = ["open", "high", "low", "close", "vol", "amount", "vwap", "sector"]
COMPONENTS = {"momentum": "returns(close,4)", "size": "log(amount)", "range": "high/low"}


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.gap_events(panel(spark, sf_dir))


def event_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(events.bucket_table(gaps(spark, sf_dir), 5), "bucket", "n", "entities", mean=7, median=7, win_rate=7)


def event_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(events.group_summary(gaps(spark, sf_dir).withColumn("year", F.year("trade_date")), "year", 5), "year", "n", mean=7, std=7, t=4, q05=7, q25=7, q50=7, q75=7, q95=7)


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(events.grid(gaps(spark, sf_dir), (0.005, 0.02), (5, 10)), "sign", "horizon", "n", threshold=3, mean=7)


def event_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large gaps, at most one of an entity in 10 sessions."""
    return out(events.cooldown(gaps(spark, sf_dir).filter(F.abs("gap") >= EVENT), 10), "ts_code", "calendar_idx", days=("trade_date",))


def event_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(events.spacing(gaps(spark, sf_dir).filter(F.abs("gap") >= EVENT)), "ts_code", "calendar_idx", "next_in")


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase of a user, the value of the user's last event of another type at or before it."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    left = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "at")
    right = rows.filter("event_type <> 'purchase'").groupBy("user_id", "at").agg(F.max("value").alias("value"))
    return relational.asof_join(left, right, "user_id", "at", "value")


def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the size bands that hold them."""
    bands = spark.createDataFrame([(i, i * 7, i * 7 + 9) for i in range(8)], "band int, low int, high int")
    return relational.range_join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), bands, "p_size", "low", "high", 10).select("p_partkey", "p_size", "band")


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return found.select("o_custkey", "o_orderkey", "o_totalprice")


def shortest_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as identities: the shortest properties and the users' parity classes."""
    rows = table(spark, sf_dir, "events").select("event_type", "props", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("origin"))
    return relational.shortest_of(rows.filter("props is not null"), "event_type", "props", "origin").withColumn("origins", F.array_join("origins", ","))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.page(table(spark, sf_dir, "orders"), "o_orderkey", 100, 50).select("o_orderkey", "o_custkey")


def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(relational.concentration(table(spark, sf_dir, "orders"), "o_custkey"), hhi=9, effective=5)


def regime_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close where the session's mean return was positive to nine digits (sums in another order differ beyond), else open."""
    p = panel(spark, sf_dir)
    on = series(spark, sf_dir).groupBy("trade_date").agg(F.max("market").alias("market")).select("trade_date", (F.round("market", 9) > 0).cast("int").alias("on"))
    blend = relational.regime_blend(p.select("ts_code", "trade_date", F.col("close").alias("x")), p.select("ts_code", "trade_date", F.col("open").alias("x")), on, ["ts_code", "trade_date"], "trade_date", "x")
    return out(blend, "ts_code", days=("trade_date",), x=8)


def catalogue(spark: SparkSession) -> DataFrame:
    """The expressions of the language's own queries, numbered by name."""
    return spark.createDataFrame([(i, DSL[name][0]) for i, name in enumerate(sorted(DSL))], "id int, expression string")


def similar_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(similarity.similar_pairs(catalogue(spark), FIELDS, 0.5), "a", "b", similarity=9)


def expression_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue(spark)
    return similarity.clusters(spark, rows, similarity.similar_pairs(rows, FIELDS, 0.5))


def weight_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factors(panel(spark, sf_dir), COMPONENTS | {"label": "returns(close,1)"})
    found = search.weight_scores(spark, rows, list(COMPONENTS), "label")
    return out(found.withColumn("weights", F.array_join(F.transform("weights", lambda w: F.format_number(w, 2)), ",")), "candidate", "weights", "n", mean_ic=9, ir=7)


def few_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of the sectors: a portfolio of five names."""
    return series(spark, sf_dir).withColumn("sector", (F.col("ts_code") % 5).cast("int")).groupBy("sector", "trade_date").agg(F.avg("ret").alias("ret"))


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(search.covariance(few_series(spark, sf_dir), "sector", "trade_date", "ret"), "a", "b", "n", cov=10)


def risk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.risk_budget(search.covariance(few_series(spark, sf_dir), "sector", "trade_date", "ret").toPandas())
    return spark.createDataFrame([(int(k), round(v, 9)) for k, v in found.items()], "sector int, weight double")


def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 resampled paths of the market's returns (one value a session)."""
    market = [x.m for x in series(spark, sf_dir).groupBy("trade_date").agg(F.max("market").alias("m")).orderBy("trade_date").collect()]
    return search.block_bootstrap(spark, market, 1000, 20, 7)


def overfit_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.overfit_probability(few_series(spark, sf_dir), "sector", "trade_date", "ret")


def return_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(paths.signature(series(spark, sf_dir), "ts_code", 12), "ts_code", "block", "n", mean=8, z=5)


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(paths.robust_scale(panel(spark, sf_dir), "vol"), "ts_code", days=("trade_date",), vol=6)


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's yearly mean returns as fold scores."""
    folds = series(spark, sf_dir).groupBy("ts_code", F.year("trade_date").alias("fold")).agg(F.avg("ret").alias("score"))
    return out(paths.fold_summary(folds, "ts_code", "score"), "ts_code", "folds", least=9, median=9, mean=9, dispersion=9)


RUNS = [ledger.Run("base")]


def ledger_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor(with_universe(panel(spark, sf_dir), decimals=2), "returns(close,4)")


def ledger_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run is given: picks by session of the first configuration."""
    rows = ledger.candidates(ledger_panel(spark, sf_dir), spark.createDataFrame([ledger.asdict(RUNS[0])]))
    return rows.filter("picked").select("run_id", F.col("trade_date").cast("string").alias("trade_date"), "session", "ts_code")


def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latency(table(spark, sf_dir, "events"), "ts", "value", ["event_type"], "1 hour")
    return out(rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "event_type", "start", "n", p50=8, p95=8, p99=8)


EVENTS_SQL = f"""{PANEL_SQL},
cal AS (SELECT trade_date, (row_number() OVER (ORDER BY trade_date) - 1)::INT AS idx FROM (SELECT DISTINCT trade_date FROM panel)),
moves AS (SELECT ts_code, trade_date, idx, open / lag(close) OVER h - 1 AS gap, CASE WHEN lead(idx, 5) OVER h = idx + 5 THEN lead(open, 5) OVER h / open - 1 END AS fwd_5,
  CASE WHEN lead(idx, 10) OVER h = idx + 10 THEN lead(open, 10) OVER h / open - 1 END AS fwd_10 FROM panel JOIN cal USING (trade_date) WINDOW h AS (PARTITION BY ts_code ORDER BY trade_date)),
ev AS (SELECT *, {' + '.join(f'(gap >= {e!r}::DOUBLE)::INT' for e in events.EDGES)} AS bucket, year(trade_date)::INT AS year FROM moves WHERE gap IS NOT NULL)"""
GRID_SQL = " UNION ALL ".join(f"SELECT {s} AS sign, {h} AS horizon, count(fwd_{h}) AS n, {t}::DOUBLE AS threshold, {r(7, mean=f'avg(fwd_{h})')} FROM ev WHERE gap * {s} >= {t}::DOUBLE" for t in (0.005, 0.02) for s in (-1, 1) for h in (5, 10))
COVARIANCE_SQL = f"{SERIES_SQL}, few AS (SELECT (ts_code % 5)::INT AS sector, trade_date, avg(ret) AS ret FROM series GROUP BY ALL)"
SQL = {
    "event_buckets": f"WITH {EVENTS_SQL} SELECT bucket, count(*) AS n, count(DISTINCT ts_code) AS entities, {r(7, mean='avg(fwd_5)', median='median(fwd_5)', win_rate='avg((fwd_5 > 0)::INT)')} FROM ev GROUP BY bucket",
    "event_years": f"WITH {EVENTS_SQL} SELECT year, count(*) AS n, {r(7, mean='avg(fwd_5)', std='stddev_samp(fwd_5)')}, {r(4, t='avg(fwd_5) / (stddev_samp(fwd_5) / sqrt(count(*)))')}, "
    + r(7, **{f"q{q:02d}": f"quantile_cont(fwd_5, {q / 100})" for q in (5, 25, 50, 75, 95)}) + " FROM ev WHERE fwd_5 IS NOT NULL GROUP BY year",
    "event_grid": f"WITH {EVENTS_SQL} {GRID_SQL}",
    "event_cooldown": f"""WITH RECURSIVE {EVENTS_SQL}, big AS MATERIALIZED (SELECT ts_code, trade_date, idx FROM ev WHERE abs(gap) >= {EVENT}),
chosen AS (SELECT ts_code, min(idx) AS idx FROM big GROUP BY ts_code UNION ALL SELECT c.ts_code, (SELECT min(b.idx) FROM big b WHERE b.ts_code = c.ts_code AND b.idx > c.idx + 10) FROM chosen c WHERE c.idx IS NOT NULL)
SELECT ts_code, idx AS calendar_idx, CAST(trade_date AS VARCHAR) AS trade_date FROM chosen JOIN big USING (ts_code, idx)""",
    "event_spacing": f"WITH {EVENTS_SQL} SELECT ts_code, idx AS calendar_idx, lead(idx) OVER (PARTITION BY ts_code ORDER BY idx) - idx AS next_in FROM ev WHERE abs(gap) >= {EVENT}",
    "join_asof": """WITH rws AS (SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at" FROM events), others AS (SELECT user_id, "at", max(value) AS value FROM rws WHERE event_type <> 'purchase' GROUP BY ALL)
SELECT l.event_id, l.user_id, l."at", o.value FROM (SELECT * FROM rws WHERE event_type = 'purchase') l ASOF LEFT JOIN others o ON l.user_id = o.user_id AND l."at" >= o."at" """,
    "join_range": "SELECT p_partkey, p_size, band::INT AS band FROM part JOIN range(8) b(band) ON p_size BETWEEN band * 7 AND band * 7 + 9",
    "latest_order": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "shortest_of": "SELECT event_type, first(props ORDER BY length(props), props) AS props, string_agg(DISTINCT 'u' || (user_id % 3), ',' ORDER BY 'u' || (user_id % 3)) AS origins, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY event_type",
    "page_rows": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 150",
    "concentration": f"WITH s AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY ALL), h AS (SELECT sum(pow(c / (SELECT count(*) FROM orders)::DOUBLE, 2)) AS hhi FROM s) SELECT {r(9, hhi='hhi')}, {r(5, effective='1 / hhi')} FROM h",
    "regime_blend": f"WITH {SERIES_SQL}, state AS (SELECT trade_date, round(max(market), 9) > 0 AS up FROM series GROUP BY ALL) SELECT ts_code, CAST(p.trade_date AS VARCHAR) AS trade_date, {r(8, x='CASE WHEN up THEN close ELSE open END')} FROM panel p LEFT JOIN state USING (trade_date)",
    "covariance": f"WITH {COVARIANCE_SQL} SELECT a.sector AS a, b.sector AS b, count(*) AS n, {r(10, cov='covar_samp(a.ret, b.ret)')} FROM few a JOIN few b ON a.trade_date = b.trade_date AND a.sector <= b.sector GROUP BY a.sector, b.sector",
    "return_signature": f"""WITH {SERIES_SQL}, placed AS (SELECT *, ((row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) - 1) * 12 // count(*) OVER (PARTITION BY ts_code))::INT AS block FROM series),
means AS (SELECT ts_code, block, count(*) AS n, avg(ret) AS mean FROM placed GROUP BY ALL) SELECT ts_code, block, n, {same(8, 'mean')}, {r(5, z='(mean - avg(mean) OVER s) / nullif(stddev_pop(mean) OVER s, 0)')} FROM means WINDOW s AS (PARTITION BY ts_code)""",
    "robust_scale": f"""WITH {PANEL_SQL}, m AS (SELECT median(vol) AS med FROM panel), d AS (SELECT median(abs(vol - med)) AS mad FROM panel, m)
SELECT ts_code, CAST(trade_date AS VARCHAR) AS trade_date, {r(6, vol='least(greatest((p.vol - med) / nullif(1.4826::DOUBLE * mad, 0), -3), 3)')} FROM panel p, m, d""",
    "fold_scores": f"WITH {SERIES_SQL}, f AS (SELECT ts_code, year(trade_date) AS fold, avg(ret) AS score FROM series GROUP BY ALL) SELECT ts_code, count(*) AS folds, {r(9, least='min(score)', median='median(score)', mean='avg(score)', dispersion='stddev_pop(score)')} FROM f GROUP BY ts_code",
    "weight_search": f"""WITH {PANEL_SQL},
x AS (SELECT *, close / (lag(close, 4) OVER h + 1e-12) - 1 AS a, ln(abs(amount) + 1e-9) AS b, high / (low + 1e-12) AS c, close / (lag(close, 1) OVER h + 1e-12) - 1 AS label FROM panel WINDOW h AS (PARTITION BY ts_code ORDER BY trade_date)),
k AS (SELECT trade_date, label, {', '.join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY trade_date) END AS {c}" for c in 'abc')} FROM x),
g(candidate, u, v, w) AS (VALUES {', '.join(f"({i}::INT, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(search.simplex(3, 4)))}),
s AS (SELECT candidate, u, v, w, trade_date, label, a * u + b * v + c * w AS score FROM k, g), f AS (SELECT * FROM s WHERE score IS NOT NULL AND label IS NOT NULL),
d AS (SELECT candidate, u, v, w, trade_date, covar_pop(score, label) / nullif(stddev_pop(score) * stddev_pop(label), 0) AS ic FROM f GROUP BY ALL)
SELECT candidate, printf('%.2f,%.2f,%.2f', u, v, w) AS weights, count(ic) AS n, round(avg(ic), 9) + 0.0 AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 7) + 0.0 AS ir FROM d GROUP BY candidate, u, v, w""",
    "overfit_probability": f"""WITH {SERIES_SQL}, p AS (SELECT ts_code % 5 AS sector, trade_date, avg(ret) AS ret FROM series GROUP BY ALL),
b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY sector ORDER BY trade_date) - 1) * 8 / count(*) OVER (PARTITION BY sector)) AS INT) AS block FROM p),
s AS (SELECT sector, block, sum(ret) AS s, sum(ret * ret) AS q, count(*) AS n FROM b GROUP BY ALL),
h AS (SELECT i::INT AS split FROM range(256) t(i) WHERE bit_count(i::INT) = 4),
v AS (SELECT split, sector, ((split >> block) & 1) = 1 AS inside, sum(s) AS s, sum(q) AS q, sum(n) AS n FROM s, h GROUP BY ALL),
r AS (SELECT split, sector, max((s / n) / nullif(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 0)) FILTER (WHERE inside) AS a, max((s / n) / nullif(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 0)) FILTER (WHERE NOT inside) AS o FROM v GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY a DESC NULLS LAST, sector) AS first, rank() OVER (PARTITION BY split ORDER BY o NULLS FIRST) AS place, count(*) OVER (PARTITION BY split) AS m FROM r)
SELECT count(*) AS splits, avg((place / (m + 1) <= 0.5)::INT::DOUBLE) AS below FROM k WHERE first = 1""",
    "ledger_candidates": f"""WITH {UNI_SQL}, f AS (SELECT ts_code, trade_date, univ_rank, close / (lag(close, 4) OVER (PARTITION BY ts_code ORDER BY trade_date) + 1e-12) - 1 AS factor FROM uni),
s AS (SELECT f.*, c.idx AS session, lag(factor) OVER (PARTITION BY ts_code ORDER BY f.trade_date) AS signal FROM f JOIN cal c USING (trade_date))
SELECT 'base' AS run_id, CAST(trade_date AS VARCHAR) AS trade_date, session, ts_code FROM s WHERE signal IS NOT NULL AND univ_rank <= 500 AND session % 5 = 0 QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY signal DESC, ts_code) <= 20""",
    "stream_latency": f"SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, {r(8, p50='quantile_cont(value, 0.5)', p95='quantile_cont(value, 0.95)', p99='quantile_cont(value, 0.99)')} FROM events GROUP BY ALL",
}


def queries() -> dict:
    found = (
        event_buckets, event_years, event_grid, event_cooldown, event_spacing, join_asof, join_range, latest_order, shortest_of, page_rows, concentration, regime_blend,
        similar_expressions, expression_clusters, weight_search, covariance, risk_budget, block_bootstrap, overfit_probability, return_signature, robust_scale, fold_scores,
        ledger_candidates, stream_latency,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return SQL
