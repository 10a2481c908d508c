"""Queries that choose among sources of return: representatives, diverse candidates, weights; with their SQL. Suppliers stand for candidates."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.ranges import cut
from weftline.functions.windows import average_rank, day
from weftline.operators import diversity, paths, rating, residuals, search, stats, weights
from weftline.plans.panel_queries import CDF, HORIZON, ROWS_SQL, SERIES_SQL, out, r, rows, same, series
from weftline.sources.panel import table

LIKE, CAP, CHOSEN = 0.3, 0.1, 8


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the path of their returns in 48 blocks, region, quality (mean return), and what diverse choice asks for."""
    own = series(spark, sf_dir)
    blocks = paths.signature(own, "ts_code").groupBy("ts_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "mean"))), lambda x: x["mean"]).alias("path"))
    quality = paths.ordered_mean(own, "ts_code", "quality")
    about = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ts_code"), F.col("n_regionkey").alias("region"), "s_nationkey", F.col("s_acctbal").alias("rating"))
    return blocks.join(quality, "ts_code").join(about, "ts_code")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.representative_clusters(candidates(spark, sf_dir), "region", [F.desc("quality"), F.asc("ts_code")], "path", LIKE)


def return_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(clusters(spark, sf_dir), "ts_code", "region", "place", "best_place", correlation=6)


def return_source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(diversity.cluster_summary(clusters(spark, sf_dir), "region"), "region", "rows", "clusters", "largest", redundancy=6, hhi=6, effective=4)


def return_source_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.family_summary(clusters(spark, sf_dir), "region", "s_nationkey")


def diverse_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures: a nation's suppliers of one band of rating; mechanisms: regions."""
    rows = candidates(spark, sf_dir).withColumn("structure", F.concat_ws("/", "s_nationkey", F.floor(F.col("rating") / 3000))).withColumn("first", F.col("ts_code") % 2)
    found = diversity.diverse_candidates(rows, "ts_code", "structure", "region", [-F.col("first"), -F.col("rating")], "path", CAP, 3, CHOSEN)
    return out(found, "id", "mechanism", "state", "kept", "place", correlation=6)


COMPONENTS, GROUPS = ["factor", "vol", "vwap"], ["price", "size", "price"]
WIDTHS, TOP, COST, STRESS, FOLDS, CONFIDENCE_Z = (0.1, 0.2, 0.3), 0.2, 5.0, 20.0, 5, 1.2815515655446008
GRID = search.simplex(3, 4)
SINGLES = [GRID.index(tuple(float(i == j) for j in range(3))) for i in range(3)]
SCORE_LAYERS = ("TRAIN", "VALID")
MEASURES = ("sharpe", "ann_return", "max_drawdown", "ann_return_lcb", "sharpe_lcb", "stress_sharpe", "ic_mean", "icir", "conversion", "avg_turnover", "year_rate", "era_rate", "active_era_rate", "worst_block_sharpe", "worst_block_return", "positive_block_rate", "worst_tail_sharpe", "tail_monotonicity")


def weight_sessions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rows(spark, sf_dir)
    for c in COMPONENTS:
        ranked = ranked.withColumn(f"r_{c}", average_rank(F.col(c)) / F.count(F.lit(1)).over(day()))
    return cut(weights.session_scores(ranked, [f"r_{c}" for c in COMPONENTS], GRID, WIDTHS))


def weight_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(weight_sessions_table(spark, sf_dir), "layer", "candidate", "width", days=("trade_date",), gross=8, benchmark=8, turnover=8, ic=8)


def weight_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(weights.metrics(weight_sessions_table(spark, sf_dir), 252 / HORIZON, TOP, COST, STRESS, 0.90, FOLDS), "layer", "candidate", "n", **dict.fromkeys(MEASURES, 6))


def weight_robust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = weight_sessions_table(spark, sf_dir)
    measures = weights.metrics(sessions, 252 / HORIZON, TOP, COST, STRESS, 0.90, FOLDS)
    similarity = weights.independence(sessions.filter(F.col("layer").isin(*SCORE_LAYERS)), SINGLES, TOP, COST)
    found = weights.robust_scores(measures, GRID, GROUPS, similarity, SCORE_LAYERS)
    return out(found, "candidate", robust_score=5, diversification=6, group_diversification=6, independence=5, gap=5, sharpe_lcb=5)


def candidate_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weightings rated: VALID is the rating window, TRAIN the reference, HOLDOUT what came after; gates and blends by their measures."""
    m = cut(weights.metrics(weight_sessions_table(spark, sf_dir), 252 / HORIZON, TOP, COST, STRESS, 0.90, FOLDS))
    of = lambda layer, **names: m.filter(F.col("layer") == layer).select("candidate", *[F.col(c).alias(k) for k, c in names.items()])
    found = m.filter("layer = 'VALID'").join(of("TRAIN", train_sharpe="sharpe", train_ic="ic_mean"), "candidate").join(of("HOLDOUT", holdout_sharpe="sharpe", holdout_ic="ic_mean", holdout_drawdown="max_drawdown"), "candidate")
    t = F.try_divide(F.col("sharpe") * CONFIDENCE_Z, F.col("sharpe") - F.col("sharpe_lcb"))
    cost = F.col("avg_turnover") * COST / 10000 * 252 / HORIZON
    found = found.withColumn("return_t", t).withColumns({
        "calmar": F.try_divide("ann_return", "max_drawdown"), "psr": stats.normal_cdf(F.col("return_t")), "era_rate": F.col("active_era_rate"), "worst_era_sharpe": F.col("worst_block_sharpe"), "turnover": F.col("avg_turnover") / HORIZON, "participation": F.lit(0.01),
        "cost_cushion": F.try_divide(F.col("ann_return_lcb") + cost, cost), "monotonicity": F.col("tail_monotonicity"), "direction_kept": (F.col("ic_mean") > 0) & (F.col("train_ic") > 0) & (F.col("holdout_ic") > 0),
        "research_pass": F.col("icir") > -1, "holdout_pass": F.col("holdout_sharpe") > -1, "vault_pass": F.col("holdout_drawdown") < 0.5, "capacity_pass": F.col("avg_turnover") < 1.2,
    })
    found = rating.gated(rating.rated(found, len(GRID)), [("ic", F.col("icir") > 0), ("sharpe", F.col("sharpe_lcb") > -2), ("turnover", F.col("avg_turnover") < 0.9)])
    found = rating.blended(found, "state", {"raw_score": 0.5, "sharpe": 0.3, "turnover": 0.2}).withColumn("reasons", F.array_join("reasons", ","))
    return out(found, "candidate", "state", "reasons", "passes", **dict.fromkeys([*rating.WEIGHTS, "raw_score", "score"], 4), blend=6)


RIDGE, RIDGE_FOLDS, RIDGE_EMBARGO = 1.0, 6, 1


def ridge_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ranks of the factor and of volume don't explain of the label, sessions before teaching sessions after."""
    ranked = rows(spark, sf_dir).withColumn("c0", F.col("pct")).withColumn("c1", average_rank(F.col("vol")) / F.col("n_day"))
    ranked = cut(ranked.select("ts_code", "trade_date", "label_exit_date_5", "label", "c0", "c1"))
    found = residuals.forward_residuals(ranked, "label", ["c0", "c1"], RIDGE_FOLDS, RIDGE, RIDGE_EMBARGO, exit="label_exit_date_5")
    return out(found, "ts_code", "fold", days=("trade_date",), prediction=8, residual=8)


CANDIDATES_SQL = f"""WITH RECURSIVE {SERIES_SQL},
numbered AS (SELECT *, CAST(floor((row_number() OVER o - 1) * 48 / count(*) OVER (PARTITION BY ts_code)) AS INT) AS block FROM series WINDOW o AS (PARTITION BY ts_code ORDER BY trade_date)),
blocks AS (SELECT ts_code, block, avg(ret) AS m FROM numbered GROUP BY ALL),
about AS (SELECT ts_code, avg(ret) AS quality, n_regionkey AS region, s_nationkey, s_acctbal AS rating FROM series JOIN supplier ON s_suppkey = ts_code JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)"""
PAIRS_SQL = """pairs AS (
  SELECT a.scope, a.place AS p, b.place AS o, CASE WHEN count(*) >= 4 THEN corr(x.m, y.m) END AS c FROM ranked a JOIN ranked b ON a.scope = b.scope AND b.place < a.place
  JOIN blocks x ON x.ts_code = a.ts_code JOIN blocks y ON y.ts_code = b.ts_code AND y.block = x.block GROUP BY ALL),
near AS (SELECT r.scope, r.place, coalesce(list(o) FILTER (WHERE c {test}), []) AS others FROM ranked r LEFT JOIN pairs ON pairs.scope = r.scope AND p = r.place GROUP BY ALL)"""
CLUSTERS_SQL = f"""{CANDIDATES_SQL},
ranked AS (SELECT ts_code, region AS scope, s_nationkey, row_number() OVER (PARTITION BY region ORDER BY quality DESC, ts_code) - 1 AS place FROM about WHERE ts_code IN (SELECT ts_code FROM blocks GROUP BY 1 HAVING count(*) >= 4)),
{PAIRS_SQL.format(test=f">= {LIKE}::DOUBLE")},
walk AS (
  SELECT scope, place, [0::BIGINT] AS reps FROM near WHERE place = 0
  UNION ALL SELECT n.scope, n.place, CASE WHEN list_has_any(n.others, w.reps) THEN w.reps ELSE list_append(w.reps, n.place) END FROM walk w JOIN near n ON n.scope = w.scope AND n.place = w.place + 1),
reps AS (SELECT scope, unnest(reps) AS rep FROM walk QUALIFY place = max(place) OVER (PARTITION BY scope)),
best AS (SELECT r.scope, r.place, r.ts_code, r.s_nationkey, arg_max(rep, (c, -rep)) AS rep, max(c) AS c FROM ranked r LEFT JOIN pairs ON pairs.scope = r.scope AND pairs.p = r.place JOIN reps ON reps.scope = r.scope AND reps.rep = pairs.o GROUP BY ALL),
found AS (SELECT r.ts_code, r.scope AS region, r.s_nationkey, r.place, coalesce(reps.rep, best.rep) AS best_place, CASE WHEN reps.rep IS NOT NULL THEN 1.0 ELSE best.c END::DOUBLE AS correlation FROM ranked r
  LEFT JOIN reps ON reps.scope = r.scope AND reps.rep = r.place LEFT JOIN best ON best.scope = r.scope AND best.place = r.place)"""
RANK = "(rank() OVER (PARTITION BY trade_date ORDER BY {c}) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY trade_date)"
RATIO = lambda mean, std: f"CASE WHEN {std} > 1e-12 THEN ({mean}) * sqrt({252 / HORIZON}::DOUBLE) / {std} ELSE 0 END"
GROWTH = "sum(ln(greatest(1e-12, 1 + active)))"
SESSIONS_SQL = f"""{ROWS_SQL},
comps AS (SELECT *, {RANK.format(c="factor")} AS c0, {RANK.format(c="vol")} AS c1, {RANK.format(c="vwap")} AS c2 FROM rws),
grid AS (SELECT * FROM (VALUES {", ".join(f"({i}::INT, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(GRID))}) g(candidate, w0, w1, w2)),
scored AS (SELECT layer, trade_date, ts_code, label, label_rank, candidate, n_day AS n, round(c0 * w0 + c1 * w1 + c2 * w2, 9) AS score FROM comps, grid),
placed AS (SELECT *, row_number() OVER (PARTITION BY candidate, trade_date ORDER BY score, ts_code) - 1 AS place FROM scored),
widths AS (SELECT unnest([{", ".join(f"{w}::DOUBLE" for w in WIDTHS)}]) AS width),
orders AS (SELECT layer, trade_date, row_number() OVER (PARTITION BY layer ORDER BY trade_date) AS k FROM (SELECT DISTINCT layer, trade_date FROM rws)),
held AS (SELECT p.layer, p.trade_date, o.k, candidate, width, ts_code, label, greatest(1, floor(n * width)) AS top FROM placed p JOIN orders o USING (layer, trade_date), widths WHERE place >= n - greatest(1, floor(n * width))),
picks AS (SELECT layer, k, candidate, width, any_value(trade_date) AS trade_date, avg(label) AS gross, any_value(top) AS top FROM held GROUP BY layer, k, candidate, width),
kept_n AS (SELECT a.layer, a.k, a.candidate, a.width, count(*) AS kept FROM held a JOIN held b ON b.layer = a.layer AND b.k = a.k - 1 AND b.candidate = a.candidate AND b.width = a.width AND b.ts_code = a.ts_code GROUP BY ALL),
ranked_ic AS (SELECT candidate, trade_date, round(coalesce(covar_pop(place, label_rank) / nullif(stddev_pop(place) * stddev_pop(label_rank), 0), 0), 12) AS ic, avg(label) AS benchmark FROM placed GROUP BY ALL),
sessions AS (SELECT p.layer, p.trade_date, p.candidate, p.width, p.gross, benchmark, ic, CASE WHEN q.top IS NULL THEN 1 ELSE (p.top - coalesce(kept, 0)) / p.top + (q.top - coalesce(kept, 0)) / q.top + coalesce(kept, 0) * abs(1 / p.top - 1 / q.top) END::DOUBLE AS turnover
  FROM picks p LEFT JOIN picks q ON q.layer = p.layer AND q.k = p.k - 1 AND q.candidate = p.candidate AND q.width = p.width LEFT JOIN kept_n n ON n.layer = p.layer AND n.k = p.k AND n.candidate = p.candidate AND n.width = p.width JOIN ranked_ic i ON i.candidate = p.candidate AND i.trade_date = p.trade_date)"""
METRICS_SQL = f"""{SESSIONS_SQL},
active AS (SELECT *, gross - benchmark - turnover * {COST} / 10000 AS active, gross - benchmark - turnover * {STRESS} / 10000 AS stressed FROM sessions),
devs AS (SELECT *, count(*) OVER w AS n, row_number() OVER o - 1 AS i, active - avg(active) OVER w AS dev, exp(sum(ln(greatest(1e-12, 1 + active))) OVER o) AS nav FROM active WHERE width = {TOP} WINDOW w AS (PARTITION BY layer, candidate), o AS (PARTITION BY layer, candidate ORDER BY trade_date)),
lagged AS (SELECT *, 1 - nav / greatest(1, max(nav) OVER o) AS down, {", ".join(f"dev * lag(dev, {k}) OVER o AS p{k}" for k in range(1, 9))},
  least({FOLDS}, n // 2) AS f FROM devs WINDOW o AS (PARTITION BY layer, candidate ORDER BY trade_date)),
blocked AS (SELECT *, CASE WHEN i < (n % f) * (n // f + 1) THEN i // (n // f + 1) ELSE n % f + (i - (n % f) * (n // f + 1)) // (n // f) END AS block FROM lagged),
sums AS (SELECT layer, candidate, count(*) AS n, avg(active) AS mean, stddev_samp(active) AS sd, {GROWTH} AS g, max(down) AS max_drawdown, avg(dev * dev) AS s0, {", ".join(f"avg(p{k}) AS s{k}" for k in range(1, 9))}, avg(stressed) AS sm, stddev_samp(stressed) AS ss, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_sd,
  coalesce(count(*) FILTER (WHERE ic > 0 AND active > 0) / nullif(count(*) FILTER (WHERE ic > 0), 0), 0) AS conversion, avg(turnover) AS avg_turnover, greatest(1, least(8, round_even(pow(count(*), 1 / 3.0::DOUBLE), 0))) AS lag FROM blocked GROUP BY ALL),
lower AS (SELECT *, mean - {CONFIDENCE_Z}::DOUBLE * sqrt(greatest(0, s0 + {" + ".join(f"CASE WHEN {k} <= least(lag, n - 1) THEN 2 * (1 - {k} / (lag + 1)) * s{k} ELSE 0 END" for k in range(1, 9))}) / n) AS low FROM sums),
years AS (SELECT layer, candidate, year(trade_date) AS y, {GROWTH} AS g, avg(ic) AS ic FROM blocked GROUP BY ALL),
year_rates AS (SELECT layer, candidate, avg((g > 0)::INT::DOUBLE) AS year_rate, avg((ic > 0)::INT::DOUBLE) AS era_rate, avg((g > 0)::INT::DOUBLE) AS active_era_rate FROM years GROUP BY ALL),
parts AS (SELECT layer, candidate, block, count(*) AS m, avg(active) AS mean, stddev_samp(active) AS sd, {GROWTH} AS g FROM blocked GROUP BY ALL HAVING count(*) >= 2),
part_rates AS (SELECT layer, candidate, min({RATIO("mean", "sd")}) AS worst_block_sharpe, min(exp(g * {252 / HORIZON}::DOUBLE / m) - 1) AS worst_block_return, avg((g > 0)::INT::DOUBLE) AS positive_block_rate FROM parts GROUP BY ALL),
tails AS (SELECT layer, candidate, width, avg(active) AS mean, stddev_samp(active) AS sd, round({GROWTH} / count(*), 12) AS g FROM active GROUP BY ALL),
falls AS (SELECT *, coalesce(g >= lead(g) OVER (PARTITION BY layer, candidate ORDER BY width), g > 0) AS falls FROM tails),
tail_rates AS (SELECT layer, candidate, min({RATIO("mean", "sd")}) AS worst_tail_sharpe, avg(falls::INT::DOUBLE) AS tail_monotonicity FROM falls GROUP BY ALL),
metrics AS (SELECT l.*, {RATIO("mean", "sd")} AS sharpe, exp(g * {252 / HORIZON}::DOUBLE / n) - 1 AS ann_return, low * {252 / HORIZON}::DOUBLE AS ann_return_lcb, {RATIO("low", "sd")} AS sharpe_lcb, {RATIO("sm", "ss")} AS stress_sharpe, {RATIO("ic_mean", "ic_sd")} AS icir,
  y.* EXCLUDE (layer, candidate), p.* EXCLUDE (layer, candidate), t.* EXCLUDE (layer, candidate) FROM lower l JOIN year_rates y USING (layer, candidate) LEFT JOIN part_rates p USING (layer, candidate) JOIN tail_rates t USING (layer, candidate))"""
CLIP = lambda x, low, high: f"least(greatest({x}, {low}), {high})"
WORSE = lambda c: f"least(a.{c}, b.{c})"
SCORE_SQL = " + ".join([f"{w} * {CLIP(f'{WORSE(c)} / {scale}', -1, 1)}" for c, w, scale in weights.CLIPPED] + [f"{w} * (2 * {WORSE(c)} - 1)" for c, w in weights.RATES])
SPREAD = lambda parts: f"CASE WHEN {' + '.join(f'(({p}) > 1e-12)::INT' for p in parts)} > 1 THEN (1 - ({' + '.join(f'({p}) * ({p})' for p in parts)})) / (1 - 1 / ({' + '.join(f'(({p}) > 1e-12)::INT' for p in parts)})) ELSE 1 END"
ROBUST_SQL = f"""{METRICS_SQL},
singles AS (SELECT layer, trade_date, {", ".join(f"max(CASE WHEN candidate = {c} THEN active END) AS u{i}" for i, c in enumerate(SINGLES))} FROM active WHERE width = {TOP} AND layer IN {SCORE_LAYERS} GROUP BY ALL),
alike AS (SELECT max(abs(r01)) AS r01, max(abs(r02)) AS r02, max(abs(r12)) AS r12 FROM (SELECT layer, corr(u0, u1) AS r01, corr(u0, u2) AS r02, corr(u1, u2) AS r12 FROM singles GROUP BY layer)),
shapes AS (SELECT candidate, {SPREAD(["w0", "w1", "w2"])} AS diversification, {SPREAD(["w0 + w2", "w1"])} AS group_diversification,
  1 - {CLIP("2 * (w0 * w1 * r01 + w0 * w2 * r02 + w1 * w2 * r12) / greatest(1e-12, 1 - (w0 * w0 + w1 * w1 + w2 * w2))", 0, 1)} AS independence FROM grid, alike),
layers_of AS (SELECT a.candidate, {WORSE("sharpe_lcb")} AS sharpe_lcb, s.*  EXCLUDE (candidate), abs(a.sharpe - b.sharpe) / greatest(1, abs(a.sharpe), abs(b.sharpe)) AS gap, {SCORE_SQL} AS parts, greatest(a.max_drawdown, b.max_drawdown) AS worst_drawdown
  FROM metrics a JOIN metrics b ON b.candidate = a.candidate AND a.layer = '{SCORE_LAYERS[0]}' AND b.layer = '{SCORE_LAYERS[1]}' JOIN shapes s ON s.candidate = a.candidate)"""
UNIT = lambda x: f"least(greatest({x}, 0.0), 1.0)"
HURDLE = NormalDist().inv_cdf(1 - 0.10 / len(GRID))
RATINGS_SQL = f"""{METRICS_SQL},
sides AS (SELECT v.*, t.sharpe AS train_sharpe, t.ic_mean AS train_ic, h.sharpe AS holdout_sharpe, h.ic_mean AS holdout_ic, h.max_drawdown AS holdout_drawdown, v.sharpe * {CONFIDENCE_Z}::DOUBLE / nullif(v.sharpe - v.sharpe_lcb, 0) AS t, v.avg_turnover * {COST} / 10000 * {252 / HORIZON}::DOUBLE AS cost
  FROM metrics v JOIN metrics t ON t.candidate = v.candidate AND t.layer = 'TRAIN' JOIN metrics h ON h.candidate = v.candidate AND h.layer = 'HOLDOUT' WHERE v.layer = 'VALID'),
rated AS (SELECT *, 0.45 * {UNIT("sharpe_lcb / 1.5")} + 0.35 * {UNIT("ann_return_lcb / 0.12")} + 0.2 * {UNIT("coalesce(ann_return / nullif(max_drawdown, 0), -99) / 1.5")} AS profitability,
  0.65 * {UNIT(f"coalesce(t, -99) / {HURDLE}::DOUBLE")} + 0.35 * {UNIT(f"coalesce({CDF('t')}, 0)")} AS confidence,
  0.4 * {UNIT("(stress_sharpe + 0.25) / 1.75")} + 0.25 * active_era_rate + 0.15 * year_rate + 0.2 * {UNIT("(worst_block_sharpe + 0.5) / 2")} AS robustness,
  0.75 * {UNIT("holdout_sharpe / greatest(0.25, train_sharpe)")} + 0.25 * (ic_mean > 0 AND train_ic > 0 AND holdout_ic > 0)::INT AS generalization,
  0.45 * {UNIT("coalesce((ann_return_lcb + cost) / nullif(cost, 0), 0) / 3")} + 0.3 * exp(-avg_turnover / {HORIZON} / 0.5) + 0.25 * exp(-0.01::DOUBLE / 0.05::DOUBLE) AS implementation, 0.6 * {UNIT("icir / 2")} + 0.4 * tail_monotonicity AS signal FROM sides),
raw AS (SELECT *, 100 * (0.35 * profitability + 0.2 * confidence + 0.2 * robustness + 0.1 * generalization + 0.1 * implementation + 0.05 * signal) * (0.7 + 0.3 * least(profitability, confidence, robustness, implementation)) AS raw_score FROM rated),
capped AS (SELECT *, CASE WHEN icir <= -1 THEN 'research_rejected' WHEN holdout_sharpe <= -1 THEN 'holdout_rejected' WHEN holdout_drawdown >= 0.5 THEN 'vault_rejected' WHEN avg_turnover >= 1.2 THEN 'capacity_limited' WHEN raw_score >= 75 THEN 'capital_priority_non_pit' WHEN raw_score >= 60 THEN 'paper_priority' ELSE 'passed_low_conviction' END AS state FROM raw),
shares AS (SELECT *, count(*) OVER s AS m, {", ".join(f"(rank() OVER (PARTITION BY state ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY state, {c}) - 1) / 2.0::DOUBLE) AS p_{c}" for c in ("raw_score", "sharpe", "avg_turnover"))} FROM capped WINDOW s AS (PARTITION BY state))"""
RIDGE_SQL = f"""{SESSIONS_SQL},
numbered AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n, least({RIDGE_FOLDS}, count(*) OVER ()) AS f FROM (SELECT DISTINCT trade_date FROM comps)),
folds AS (SELECT *, CAST(CASE WHEN i < (n % f) * (n // f + 1) THEN i // (n // f + 1) ELSE n % f + (i - (n % f) * (n // f + 1)) // (n // f) END AS INT) AS fold FROM numbered),
starts AS (SELECT fold, min(trade_date) AS start, min(i) AS first FROM folds GROUP BY fold),
sums AS (SELECT fold, count(*) AS n, sum(label) AS y, sum(c0) AS x0, sum(c1) AS x1, sum(c0 * c0) AS x00, sum(c0 * c1) AS x01, sum(c1 * c1) AS x11, sum(c0 * label) AS y0, sum(c1 * label) AS y1 FROM starts JOIN comps ON greatest(trade_date, exit5) < start WHERE fold > 0 GROUP BY fold HAVING count(*) >= 4),
spreads AS (SELECT *, sqrt(x00 / n - (x0 / n) * (x0 / n)) AS d0, sqrt(x11 / n - (x1 / n) * (x1 / n)) AS d1 FROM sums),
grams AS (SELECT *, (x00 - x0 * x0 / n) / (d0 * d0) + {RIDGE} AS g00, (x01 - x0 * x1 / n) / (d0 * d1) AS g01, (x11 - x1 * x1 / n) / (d1 * d1) + {RIDGE} AS g11, (y0 - y * x0 / n) / d0 AS h0, (y1 - y * x1 / n) / d1 AS h1 FROM spreads),
slopes AS (SELECT *, (h0 * g11 - h1 * g01) / (g00 * g11 - g01 * g01) / d0 AS b0, (h1 * g00 - h0 * g01) / (g00 * g11 - g01 * g01) / d1 AS b1 FROM grams),
predicted AS (SELECT ts_code, f.fold, trade_date, label, CASE WHEN f.i >= s.first + {RIDGE_EMBARGO} THEN y / n_fit - b0 * x0 / n_fit - b1 * x1 / n_fit + b0 * c0 + b1 * c1 END AS prediction
  FROM comps JOIN folds f USING (trade_date) JOIN starts s ON s.fold = f.fold LEFT JOIN (SELECT * EXCLUDE (n), n AS n_fit FROM slopes) b ON b.fold = f.fold)"""
SQL = {
    "candidate_ratings": f"""WITH {RATINGS_SQL} SELECT candidate, state, concat_ws(',', CASE WHEN icir <= 0 THEN 'ic' END, CASE WHEN sharpe_lcb <= -2 THEN 'sharpe' END, CASE WHEN avg_turnover >= 0.9 THEN 'turnover' END) AS reasons, icir > 0 AND sharpe_lcb > -2 AND avg_turnover < 0.9 AS passes,
  {same(4, *rating.WEIGHTS, 'raw_score')}, {r(4, score="least(raw_score, CASE state WHEN 'research_rejected' THEN 24.9 WHEN 'holdout_rejected' THEN 49.9 WHEN 'vault_rejected' THEN 64.9 WHEN 'capacity_limited' THEN 79.9 ELSE 100 END)")},
  {r(6, blend="CASE WHEN m = 1 THEN 1 ELSE (0.5 * p_raw_score + 0.3 * p_sharpe + 0.2 * p_avg_turnover) / (m - 1) END")} FROM shares""",
    "ridge_residuals": f"WITH {RIDGE_SQL} SELECT ts_code, fold, CAST(trade_date AS VARCHAR) AS trade_date, {r(8, prediction='prediction', residual='label - prediction')} FROM predicted",
    "weight_sessions": f"WITH {SESSIONS_SQL} SELECT layer, CAST(trade_date AS VARCHAR) AS trade_date, candidate, width, {same(8, 'gross', 'benchmark', 'turnover', 'ic')} FROM sessions",
    "weight_metrics": f"WITH {METRICS_SQL} SELECT layer, candidate, n, {same(6, *MEASURES)} FROM metrics",
    "weight_robust_scores": f"""WITH {ROBUST_SQL} SELECT candidate, {r(5, robust_score=f"parts + 0.02 * diversification + 0.02 * group_diversification + 0.05 * independence + 0.05 * (1 - {CLIP('worst_drawdown / 0.35', 0, 2)}) - 0.1 * {CLIP('gap', 0, 1)}")}, {same(6, "diversification", "group_diversification")}, {same(5, "independence", "gap", "sharpe_lcb")} FROM layers_of""",
    "return_sources": f"{CLUSTERS_SQL} SELECT ts_code, region, place, best_place, {same(6, 'correlation')} FROM found",
    "return_source_summary": f"""{CLUSTERS_SQL}, s AS (SELECT region, best_place, count(*) AS size FROM found GROUP BY ALL),
t AS (SELECT region, sum(size)::BIGINT AS rows, count(*) AS clusters, max(size) AS largest, sum(size * size) AS squares FROM s GROUP BY region)
SELECT region, rows, clusters, largest, {r(6, redundancy='1 - clusters / rows', hhi='squares / (rows * rows)')}, {r(4, effective='rows * rows / squares')} FROM t""",
    "return_source_families": f"{CLUSTERS_SQL} SELECT region, s_nationkey, count(*) AS rows, count(DISTINCT best_place) AS clusters, count(*) FILTER (WHERE place = best_place) AS represented FROM found GROUP BY ALL",
    "diverse_choice": f"""{CANDIDATES_SQL},
keyed AS (SELECT *, s_nationkey || '/' || CAST(floor(rating / 3000) AS BIGINT) AS structure, row_number() OVER (ORDER BY -(ts_code % 2), -rating, ts_code) AS k FROM about WHERE ts_code IN (SELECT ts_code FROM blocks)),
firsts AS (SELECT structure, min(k) AS k FROM keyed GROUP BY structure),
ranked AS (SELECT ts_code, region AS scope, keyed.k, row_number() OVER (PARTITION BY region ORDER BY keyed.k) - 1 AS place FROM keyed JOIN firsts ON firsts.k = keyed.k),
{PAIRS_SQL.format(test=f"> {CAP}::DOUBLE")},
walk AS (
  SELECT scope, place, []::BIGINT[] AS before, [0::BIGINT] AS taken FROM near WHERE place = 0
  UNION ALL SELECT n.scope, n.place, w.taken, CASE WHEN len(w.taken) >= 3 OR list_has_any(n.others, w.taken) THEN w.taken ELSE list_append(w.taken, n.place) END FROM walk w JOIN near n ON n.scope = w.scope AND n.place = w.place + 1),
lead AS (SELECT scope, min(k) AS lead FROM ranked GROUP BY scope),
turns AS (SELECT w.scope, w.place, len(w.before) AS turn, row_number() OVER (ORDER BY len(w.before), lead) AS nth FROM walk w JOIN lead USING (scope) WHERE list_contains(w.taken, w.place)),
alike AS (SELECT w.scope, w.place, arg_max(o, (c, -o)) AS o, max(c) AS c FROM walk w JOIN pairs ON pairs.scope = w.scope AND pairs.p = w.place WHERE list_contains(w.before, o) AND c > {CAP}::DOUBLE GROUP BY ALL),
judged AS (SELECT r.ts_code AS id, r.scope AS mechanism, CASE WHEN t.nth <= {CHOSEN} THEN 'chosen' WHEN t.nth IS NOT NULL THEN 'surplus' WHEN len(w.before) >= 3 THEN 'mechanism' ELSE 'path' END AS state, b.ts_code AS like_code, a.c, t.nth
  FROM ranked r JOIN walk w ON w.scope = r.scope AND w.place = r.place LEFT JOIN turns t ON t.scope = r.scope AND t.place = r.place LEFT JOIN alike a ON a.scope = r.scope AND a.place = r.place LEFT JOIN ranked b ON b.scope = r.scope AND b.place = a.o)
SELECT id, mechanism::VARCHAR AS mechanism, state, CASE WHEN state = 'path' THEN like_code END AS kept, CASE WHEN state = 'chosen' THEN nth END::INT AS place, CASE WHEN state = 'path' THEN round(c, 6) + 0.0 END AS correlation FROM judged
UNION ALL SELECT keyed.ts_code, region::VARCHAR, 'structure', r.ts_code, NULL, NULL FROM keyed JOIN firsts ON firsts.structure = keyed.structure JOIN ranked r ON r.k = firsts.k WHERE keyed.k <> firsts.k""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return SQL
