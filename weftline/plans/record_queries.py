"""Queries over tables of results, and over the samples, scales and full evaluation that lead to them, with their SQL. The star-schema tables stand for results: parts, orders, customers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.windows import history
from weftline.operators import evaluate, records, sampling, stats
from weftline.plans.dsl_queries import PANEL_SQL, day_text, panel
from weftline.plans.panel_queries import DAY, HORIZON, ROWS_SQL, SERIES_SQL, out, r, rows, same, series
from weftline.sources.panel import table

FOLDS = [("WF1", "1995-01-01", "1996-12-31", "1997-01-01", "1997-12-31"), ("WF2", "1995-01-01", "1997-12-31", "1998-01-01", "1998-12-31"), ("WF3", "1995-01-01", "1998-12-31", "1999-01-01", "1999-12-31"), ("WF4", "1995-01-01", "1999-12-31", "2000-01-01", "2000-12-31")]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as results; a third have no fingerprint of their own."""
    rows = table(spark, sf_dir, "part")
    own = F.when(F.col("p_partkey") % 3 > 0, F.concat_ws("/", "p_brand", (F.col("p_size") % 10).cast("string")))
    return rows.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("market"), own.alias("print"), F.col("p_name").alias("name"), F.col("p_size").alias("records"), F.col("p_retailprice").alias("quality"))


def result_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.equivalence(results(spark, sf_dir), ["print", "name"], "records", "id").select("id", "group", "group_size", "representative", "duplicate_of")


def result_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.equivalence(results(spark, sf_dir), ["print", "name"], "records", "id")
    return records.leaderboard(found, "market", ["records", "quality"], "id").select("id", "market", "representative", "place")


def library_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).select("id", "name", F.col("records").alias("version"))
    incoming = rows.filter("id % 2 = 0").withColumn("version", F.col("version") + (F.col("id") % 5).cast("int") - 2)
    return records.merged(rows.filter("id % 3 <> 0"), incoming, "id", "version").select("id", "name", "version", "state")


def report_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports: of one customer and day they are copies of one."""
    rows = table(spark, sf_dir, "orders").withColumn("identity", F.concat_ws("/", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM")))
    found = records.catalogue(rows, "identity", F.col("o_orderpriority") == "1-URGENT", ["o_orderstatus", "o_orderpriority"], "o_orderdate", "o_orderkey")
    return found.select("o_orderkey", "identity", "copies", "archive_copies", "latest")


def search_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"))
    return records.search_progress(rows, "o_custkey", "o_orderkey", "score", 50000.0).select("o_orderkey", "best_before", F.round("gain", 2).alias("gain"), "since_record")


def rating_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.round(F.sum("o_totalprice"), 2) - 2000000).alias("outcome")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = records.calibration(rows, "c_mktsegment", "c_custkey", "c_acctbal", "outcome", F.col("outcome") > 0)
    return out(found, "c_mktsegment", "n", "calibrated", spearman=7, top_good=7, bottom_good=7, all_good=7, monotonicity=6)


def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("source", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))
    found = records.task_summary(rows, "event_type", F.col("value") > 10, F.col("value") > 50, "value", "source")
    text = F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.withColumn("sources", text)


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts at tasks (their types); users below 100 are tried twice as often in a day, and reasons come from values and props."""
    rows = table(spark, sf_dir, "events")
    why = F.array_compact(F.array(F.when(F.col("value") < 5, "small"), F.when(F.col("user_id") % 3 == 0, "third"), F.when(F.get_json_object("props", "$.k").cast("int") > 50, "late"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))))
    text = F.concat(F.lit("Rank( "), F.floor("value").cast("string"), F.lit(" )"))
    rows = rows.withColumns({"reasons": why, "text": text, "numbers": F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("double"), F.lit("value"), F.col("value"))})
    found = records.feedback_summary(rows, "event_type", "event_id", F.col("value") > 1, F.col("value") > 20, "value", "text", "reasons", "numbers", 5)
    told = F.array_join(F.transform("reasons", lambda x: F.concat_ws("=", x["reason"], x["count"].cast("string"))), ",")
    return out(found.withColumn("reasons", told).withColumn("k", F.col("means")["k"]), "event_type", "records", "valid", "errors", "passed", "reasons", pass_rate=6, score_mean=6, score_std=6, score_best=4, duplicate_rate=6, k=6)


def evidence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = [("screened", F.col("p_size") > 10), ("validated", F.col("p_retailprice") > 950), ("confirmed", F.col("p_partkey") % 4 == 0)]
    return records.evidence(table(spark, sf_dir, "part"), gates).groupBy("p_brand", "state").agg(F.count(F.lit(1)).alias("n"))


def event_cluster_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("year", F.year("trade_date"))
    return out(records.cluster_bootstrap(rows, "year", "ts_code", "ret", 100), "year", "clusters", mean=9, lower=8, upper=8)


def sessions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(sampling.latest_sessions(panel(spark, sf_dir), 21), "ts_code", days=("trade_date",), close=None)


def sessions_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(sampling.even_sessions(panel(spark, sf_dir), 50), "ts_code", days=("trade_date",), close=None)


def sessions_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that each of five sectors has, of the ten last suppliers."""
    few = panel(spark, sf_dir).filter("ts_code < 10").groupBy("sector", "trade_date").agg(F.count(F.lit(1)).alias("n"))
    return sampling.common_sessions(few, "sector").select("sector", day_text(), "n")


def scale_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(sampling.clipped_zscores(panel(spark, sf_dir), ["vol", "amount"], 1.5), "ts_code", days=("trade_date",), vol=6, amount=6)


def label_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.centred_rank(panel(spark, sf_dir), "close", "label")
    rows = sampling.centred_rank(rows.withColumn("rising", F.when(F.col("close") > F.col("open"), F.col("vol"))), "rising", "neutral", 0.0)
    return out(rows, "ts_code", days=("trade_date",), label=9, neutral=9)


def stats_rolling_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of returns as they are: clipped ones add up to zero too often for a share of positive windows."""
    moves = panel(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close").over(history()) - 1)
    return out(stats.rolling_sharpe(moves, "ts_code", 104), "ts_code", "n", q10=5, median=5, q90=5, positive=7)


def stats_path_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.path_returns(stats.with_nav(series(spark, sf_dir), "ts_code").drop("ret"), "ts_code"), "ts_code", days=("trade_date",), ret=8)


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(stats.walk_forward(evaluate.daily_ic(rows(spark, sf_dir)), FOLDS, "rank_ic"), "fold", "part", "n", mean=7, std=7, positive=7)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.daily_evaluation(evaluate.legs(rows(spark, sf_dir)), HORIZON)


def eval_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(daily(spark, sf_dir), "layer", "n", "eligible_n", days=("trade_date", "entry", "exit"), ic=7, rank_ic=7, coverage=7, benchmark=6, long_return=7, short_return=7, gross=7, turnover=7, participation=4)


METRICS = dict(ic=7, icir=6, positive=7, coverage=7, turnover=7, participation=4, annual_net=6, sharpe=5, max_drawdown=6)


def eval_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.layer_metrics(daily(spark, sf_dir), HORIZON), "layer", "n", cost_bps=1, **METRICS)


def eval_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.layer_metrics(daily(spark, sf_dir), HORIZON, (15.0,), ("layer", "era")), "layer", "era", "n", cost_bps=1, **METRICS)


RESULTS_SQL = """results AS (SELECT p_partkey AS id, p_type AS market, CASE WHEN p_partkey % 3 > 0 THEN p_brand || '/' || (p_size % 10) END AS print, p_name AS name, p_size AS records, p_retailprice AS quality FROM part)"""
GROUPS_SQL = f"""{RESULTS_SQL}, grouped AS (SELECT *, coalesce(nullif(print, ''), nullif(name, ''), id::VARCHAR) AS "group" FROM results),
eq AS (SELECT *, count(*) OVER g AS group_size, first(id) OVER (PARTITION BY "group" ORDER BY records DESC NULLS LAST, id) AS one FROM grouped WINDOW g AS (PARTITION BY "group"))"""
CORR = lambda a, b: f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
SHARPE = "avg(ret) OVER w / nullif(stddev_samp(ret) OVER w, 0) * sqrt(252)"
DRAWS = " + ".join(f"(u >= {edge!r}::DOUBLE)::INT" for edge in records.POISSON)
DAILY_SQL = f"""{ROWS_SQL},
elig AS (SELECT l.trade_date, count(*) AS eligible_n FROM lab l JOIN places p USING (layer, trade_date) WHERE layer <> 'NONE' AND factor IS NOT NULL GROUP BY l.trade_date),
w AS (SELECT *, CASE WHEN pct >= 0.8::DOUBLE THEN 1.0::DOUBLE / sum((pct >= 0.8::DOUBLE)::INT) OVER (PARTITION BY trade_date) WHEN pct <= 0.2::DOUBLE THEN -1.0::DOUBLE / sum((pct <= 0.2::DOUBLE)::INT) OVER (PARTITION BY trade_date) ELSE 0 END AS weight FROM rws),
o AS (SELECT *, coalesce(CASE WHEN lag(place) OVER e = place - 5 THEN lag(weight) OVER e ELSE 0 END, 0) AS old FROM w WINDOW e AS (PARTITION BY layer, ts_code ORDER BY trade_date)),
paid AS (SELECT *, CASE WHEN amount > 0 THEN abs(weight - old) * 1e6::DOUBLE / amount END AS pay FROM o),
near AS (SELECT *, row_number() OVER (PARTITION BY layer, trade_date ORDER BY pay NULLS LAST) AS kp, count(pay) OVER (PARTITION BY layer, trade_date) AS np, row_number() OVER (PARTITION BY layer, trade_date ORDER BY amount NULLS LAST) AS ka, count(amount) OVER (PARTITION BY layer, trade_date) AS na FROM paid),
d AS (SELECT layer, trade_date, {CORR('factor', 'label')} AS ic, {CORR('pct', 'label_rank')} AS rank_ic, count(*) AS n, min(entry) AS entry, max(exit5) AS exit, avg(label) AS benchmark,
  coalesce(sum(weight * label) FILTER (WHERE weight > 0), 0) AS long_return, coalesce(sum(-weight * label) FILTER (WHERE weight < 0), 0) AS short_return, sum(abs(weight)) AS exposure, sum(abs(weight - old)) AS changed, sum(abs(old)) AS matched,
  sum((weight <> 0)::INT) AS held, max(CASE WHEN kp = round((np - 1) * 0.95::DOUBLE) + 1 THEN pay END) AS p95, max(CASE WHEN ka = round((na - 1) * 0.05::DOUBLE) + 1 THEN amount END) AS p05 FROM near GROUP BY ALL),
sells AS (SELECT *, greatest(coalesce(lag(exposure) OVER (PARTITION BY layer ORDER BY trade_date), 0) - matched, 0) AS sold FROM d),
days_of AS (SELECT s.*, eligible_n, n::DOUBLE / eligible_n AS coverage, changed + sold AS turnover, long_return - short_return AS gross, year(trade_date)::INT AS era, greatest(coalesce(p95, 0), coalesce(CASE WHEN p05 > 0 THEN sold * 1e6 / (greatest(held, 1) * p05) END, 0)) AS participation FROM sells s JOIN elig USING (trade_date) WHERE n >= 50)"""


def metrics_sql(by: str, costs: str) -> str:
    """layer_metrics in SQL, by the columns."""
    return f"""WITH {DAILY_SQL}, net AS (SELECT *, gross - turnover * cost_bps / 10000 AS net FROM days_of, (SELECT unnest([{costs}]::DOUBLE[]) AS cost_bps)),
nav AS (SELECT *, exp(sum(ln(greatest(1e-9, 1 + net))) OVER (PARTITION BY {by}, cost_bps ORDER BY trade_date)) AS nav FROM net), dn AS (SELECT *, 1 - nav / greatest(1, max(nav) OVER (PARTITION BY {by}, cost_bps ORDER BY trade_date)) AS down FROM nav)
SELECT {by}, count(*) AS n, cost_bps, {r(7, ic='avg(rank_ic)', positive='avg((rank_ic > 0)::INT::DOUBLE)', coverage='avg(coverage)', turnover='avg(turnover)')}, {r(6, icir='avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) * sqrt(50.4)', annual_net='avg(net) * 50.4', max_drawdown='max(down)')}, {r(4, participation='max(participation)')}, {r(5, sharpe='avg(net) / nullif(stddev_samp(net), 0) * sqrt(50.4)')} FROM dn GROUP BY {by}, cost_bps"""


SQL = {
    "result_groups": f'WITH {GROUPS_SQL} SELECT id, "group", group_size, one = id AS representative, CASE WHEN one <> id THEN one END AS duplicate_of FROM eq',
    "result_leaderboard": f"""WITH {GROUPS_SQL}, best AS (SELECT "group", row_number() OVER (PARTITION BY market ORDER BY records DESC, quality DESC, id) AS place FROM eq WHERE one = id) SELECT id, market, one = id AS representative, place::INT AS place FROM eq LEFT JOIN best USING ("group")""",
    "library_merge": f"""WITH {RESULTS_SQL}, c AS (SELECT id, name, records AS version FROM results WHERE id % 3 <> 0), i AS (SELECT id, name, (records + id % 5 - 2)::INT AS version FROM results WHERE id % 2 = 0)
SELECT coalesce(c.id, i.id) AS id, coalesce(c.name, i.name) AS name, CASE WHEN c.id IS NULL OR i.version > c.version THEN i.version ELSE c.version END AS version, CASE WHEN c.id IS NULL THEN 'added' WHEN i.id IS NULL THEN 'only' WHEN i.version > c.version THEN 'updated' ELSE 'kept' END AS state FROM c FULL JOIN i ON c.id = i.id""",
    "report_catalogue": """WITH rws AS (SELECT *, o_custkey || '/' || strftime(o_orderdate, '%Y-%m') AS identity, o_orderpriority = '1-URGENT' AS active FROM orders),
k AS (SELECT *, count(*) OVER (PARTITION BY identity) AS copies, sum((NOT active)::INT) OVER (PARTITION BY identity)::BIGINT AS archive_copies FROM rws QUALIFY row_number() OVER (PARTITION BY identity ORDER BY active DESC, o_orderkey) = 1)
SELECT o_orderkey, identity, copies, archive_copies, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS latest FROM k""",
    "search_progress": """WITH b AS (SELECT *, greatest(coalesce(max(o_totalprice) OVER p, 50000), 50000) AS best_before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, greatest(o_totalprice - best_before, 0) AS gain FROM b) SELECT o_orderkey, best_before, round(gain, 2) AS gain, n - coalesce(max(CASE WHEN gain > 0 THEN n END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS since_record FROM g""",
    "rating_calibration": f"""WITH t AS (SELECT o_custkey, round(sum(o_totalprice), 2) - 2000000 AS outcome FROM orders GROUP BY ALL), a AS (SELECT c_mktsegment, c_custkey, c_acctbal, outcome, (outcome > 0)::INT::DOUBLE AS good FROM t JOIN customer ON o_custkey = c_custkey),
k AS (SELECT *, count(*) OVER s AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS p, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY c_mktsegment ORDER BY outcome) + (count(*) OVER (PARTITION BY c_mktsegment, outcome) - 1) / 2.0::DOUBLE AS ro FROM a WINDOW s AS (PARTITION BY c_mktsegment)),
m AS (SELECT c_mktsegment, {CORR('bucket', 'mean')} AS monotonicity FROM (SELECT c_mktsegment, ceil(least(4, n) * p / n)::INT AS bucket, avg(outcome) AS mean FROM k GROUP BY ALL) GROUP BY ALL),
f AS (SELECT c_mktsegment, max(n) AS n, {CORR('rs', 'ro')} AS spearman, avg(good) AS all_good, avg(good) FILTER (WHERE p > n - greatest(1, ceil(n / 4))) AS top_good, avg(good) FILTER (WHERE p <= greatest(1, ceil(n / 4))) AS bottom_good FROM k GROUP BY ALL)
SELECT c_mktsegment, n, coalesce(spearman >= 0.25 AND top_good >= all_good AND top_good > bottom_good AND monotonicity > 0, false) AS calibrated, {same(7, 'spearman', 'top_good', 'bottom_good', 'all_good')}, {same(6, 'monotonicity')} FROM f JOIN m USING (c_mktsegment)""",
    "task_summary": """WITH s AS (SELECT coalesce(event_type, 'unknown') AS event_type, 'u' || (user_id % 3) AS source, count(*) AS records, sum((coalesce(value > 10, false))::INT) AS valid, sum((coalesce(value > 50, false))::INT) AS passed, max(value) FILTER (WHERE value > 10) AS best FROM events GROUP BY ALL)
SELECT event_type, sum(records)::BIGINT AS records, sum(valid)::BIGINT AS valid, sum(passed)::BIGINT AS passed, coalesce(max(best), 0.0) AS best, string_agg(source || '=' || records, ',' ORDER BY source) AS sources FROM s GROUP BY event_type""",
    "feedback": """WITH v AS (SELECT *, (props::JSON ->> '$.k')::INT AS k, 'rank(' || CAST(floor(value) AS BIGINT) || ')' AS text FROM events WHERE value > 1),
w AS (SELECT coalesce(event_type, 'unknown') AS t, count(*) AS records, count(*) FILTER (WHERE value > 1) AS valid, count(*) FILTER (WHERE value > 20) AS passed, avg(value) FILTER (WHERE value > 1) AS score_mean, stddev_pop(value) FILTER (WHERE value > 1) AS score_std, max(value) FILTER (WHERE value > 1) AS score_best FROM events GROUP BY ALL),
d AS (SELECT coalesce(event_type, 'unknown') AS t, 1 - count(DISTINCT text) / count(text) AS duplicate_rate, avg(k) AS k FROM v GROUP BY ALL),
e AS (SELECT coalesce(event_type, 'unknown') AS t, event_id, unnest(list_filter([CASE WHEN value < 5 THEN 'small' END, CASE WHEN user_id % 3 = 0 THEN 'third' END, CASE WHEN k > 50 THEN 'late' END, 'u' || (user_id % 10)], lambda x: x IS NOT NULL)) AS reason, generate_subscripts(list_filter([CASE WHEN value < 5 THEN 'small' END, CASE WHEN user_id % 3 = 0 THEN 'third' END, CASE WHEN k > 50 THEN 'late' END, 'u' || (user_id % 10)], lambda x: x IS NOT NULL), 1) AS pos FROM v),
c AS (SELECT t, reason, count(*) AS n, min((event_id, pos)) AS first FROM e GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, first) AS place FROM c QUALIFY place <= 5)
SELECT w.t AS event_type, records, valid, records - valid AS errors, passed, round(passed / nullif(valid, 0), 6) + 0.0 AS pass_rate, round(score_mean, 6) + 0.0 AS score_mean, round(score_std, 6) + 0.0 AS score_std, round(score_best, 4) + 0.0 AS score_best,
  round(duplicate_rate, 6) + 0.0 AS duplicate_rate, (SELECT string_agg(reason || '=' || n, ',' ORDER BY place) FROM top WHERE top.t = w.t) AS reasons, round(k, 6) + 0.0 AS k FROM w LEFT JOIN d ON d.t = w.t""",
    "evidence_states": "SELECT p_brand, CASE WHEN p_size > 10 AND p_retailprice > 950 AND p_partkey % 4 = 0 THEN 'confirmed' WHEN p_size > 10 AND p_retailprice > 950 THEN 'validated' WHEN p_size > 10 THEN 'screened' ELSE 'candidate' END AS state, count(*) AS n FROM part GROUP BY ALL",
    "event_cluster_bounds": f"""WITH {SERIES_SQL}, sums AS (SELECT year(trade_date)::INT AS year, ts_code, sum(ret) AS s, count(ret) AS c FROM series GROUP BY ALL),
u AS (SELECT *, ('0x' || substr(md5('1729/' || rep || '/' || year || '/' || ts_code), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM sums, (SELECT unnest(range(1, 101)) AS rep)),
m AS (SELECT year, rep, sum(({DRAWS}) * s) / nullif(sum(({DRAWS}) * c), 0) AS m FROM u GROUP BY ALL), b AS (SELECT year, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM m GROUP BY year), c AS (SELECT year, count(*) AS clusters, sum(s) / sum(c) AS mean FROM sums GROUP BY year)
SELECT year, clusters, {same(9, 'mean')}, {r(8, lower='CASE WHEN clusters >= 2 THEN lower END', upper='CASE WHEN clusters >= 2 THEN upper END')} FROM b JOIN c USING (year)""",
    "sessions_latest": f"WITH {PANEL_SQL} SELECT ts_code, {DAY}, close FROM panel WHERE panel.trade_date IN (SELECT trade_date FROM (SELECT DISTINCT trade_date FROM panel) ORDER BY 1 DESC LIMIT 21)",
    "sessions_even": f"WITH {PANEL_SQL}, days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM panel)) SELECT ts_code, {DAY}, close FROM panel JOIN days USING (trade_date) WHERE n <= 50 OR i IN (SELECT (k * ((SELECT count(*) FROM days) - 1)) // 49 FROM range(50) t(k))",
    "sessions_common": f"WITH {PANEL_SQL}, f AS (SELECT sector, trade_date, count(*) AS n FROM panel WHERE ts_code < 10 GROUP BY ALL) SELECT sector, {DAY}, n FROM f WHERE f.trade_date IN (SELECT trade_date FROM f GROUP BY trade_date HAVING count(*) = (SELECT count(DISTINCT sector) FROM f))",
    "scale_clipped": f"WITH {PANEL_SQL} SELECT ts_code, {DAY}, {r(6, **{c: f'least(greatest(({c} - avg({c}) OVER d) / (stddev_samp({c}) OVER d + 1e-12), -1.5), 1.5)' for c in ('vol', 'amount')})} FROM panel WINDOW d AS (PARTITION BY panel.trade_date)",
    "label_centred": f"""WITH {PANEL_SQL}, s AS (SELECT *, CASE WHEN close > open THEN vol END AS rising FROM panel)
SELECT ts_code, {DAY}, {r(9, label='(rank() OVER (PARTITION BY s.trade_date ORDER BY close) + (count(*) OVER (PARTITION BY s.trade_date, close) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY s.trade_date) + 1) - 0.5', neutral='CASE WHEN rising IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY s.trade_date ORDER BY rising NULLS LAST) + (count(*) OVER (PARTITION BY s.trade_date, rising) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY s.trade_date) + 1) - 0.5 END')} FROM s""",
    "stats_rolling_sharpe": f"WITH {PANEL_SQL}, moves AS (SELECT * FROM (SELECT ts_code, trade_date, close / lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS ret FROM panel) WHERE ret IS NOT NULL), s AS (SELECT ts_code, CASE WHEN count(*) OVER w = 104 AND stddev_samp(ret) OVER w > 1e-15 THEN {SHARPE} END AS s FROM moves WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 103 PRECEDING AND CURRENT ROW)) SELECT ts_code, count(s) AS n, {r(5, q10='coalesce(quantile_cont(s, 0.1), 0)', median='coalesce(median(s), 0)', q90='coalesce(quantile_cont(s, 0.9), 0)')}, {r(7, positive='coalesce(avg((s > 0)::INT::DOUBLE), 0)')} FROM s GROUP BY ts_code",
    "stats_path_returns": f"WITH {SERIES_SQL} SELECT ts_code, {DAY}, {r(8, ret='nav / lag(nav, 1, 1.0) OVER (PARTITION BY ts_code ORDER BY nav.trade_date) - 1')} FROM nav",
    "walk_forward": f"WITH {ROWS_SQL}, f AS ({' UNION ALL '.join(f'''SELECT '{n}' AS fold, '{p}' AS part, DATE '{a}' AS a, DATE '{b}' AS b''' for n, t0, t1, v0, v1 in FOLDS for p, a, b in (('train', t0, t1), ('valid', v0, v1)))}) SELECT fold, part, count(*) AS n, {r(7, mean='avg(rank_ic)', std='stddev_samp(rank_ic)', positive='avg((rank_ic > 0)::INT::DOUBLE)')} FROM ics JOIN f ON trade_date BETWEEN a AND b WHERE rank_ic IS NOT NULL GROUP BY fold, part",
    "eval_daily": f"WITH {DAILY_SQL} SELECT layer, n, eligible_n, {DAY}, CAST(entry AS VARCHAR) AS entry, CAST(exit AS VARCHAR) AS exit, {same(7, 'ic', 'rank_ic', 'coverage', 'long_return', 'short_return', 'gross', 'turnover')}, {same(6, 'benchmark')}, {same(4, 'participation')} FROM days_of",
    "eval_layers": metrics_sql("layer", "0.0, 5.0, 15.0"),
    "eval_eras": metrics_sql("layer, era", "15.0"),
}


def queries() -> dict:
    found = (
        result_groups, result_leaderboard, library_merge, report_catalogue, search_progress, rating_calibration, task_summary, feedback, evidence_states, event_cluster_bounds,
        sessions_latest, sessions_even, sessions_common, scale_clipped, label_centred, stats_rolling_sharpe, stats_path_returns, walk_forward, eval_daily, eval_layers, eval_eras,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return SQL
