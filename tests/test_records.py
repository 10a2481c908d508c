"""Tables of results, samples and the column cache on small tables."""

import math

from weftline.operators import evaluate, records, sampling, stats
from weftline.sources.cache import cached_factors, column_key


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_equivalence_and_leaderboard(spark):
    found = records.equivalence(spark.createDataFrame([(1, "m", "x", 3, 5.0), (2, "m", "x", 3, 9.0), (3, "m", "", 1, 7.0), (4, "m", None, 1, None)], "id int, market string, print string, records int, quality double"), ["print"], "records", "id")
    assert rows(found.select("id", "group", "group_size", "representative", "duplicate_of")) == [(1, "x", 2, True, None), (2, "x", 2, False, 1), (3, "3", 1, True, None), (4, "4", 1, True, None)]
    assert rows(records.leaderboard(found, "market", ["quality"], "id").select("id", "place")) == [(1, 2), (2, 2), (3, 1), (4, 3)]


def test_merged(spark):
    old = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, v int")
    new = spark.createDataFrame([(2, 2), (3, 4), (4, 1)], "id int, v int")
    assert rows(records.merged(old, new, "id", "v")) == [(1, 1, "only"), (2, 2, "kept"), (3, 4, "updated"), (4, 1, "added")]
    assert records.merged(old.limit(0), new.limit(0), "id", "v").count() == 0


def test_search_progress(spark):
    found = records.search_progress(spark.createDataFrame([("a", i, s) for i, s in enumerate([0.1, 0.3, None, 0.2, 0.4])], "t string, i int, s double"), "t", "i", "s")
    assert [(round(r.gain, 6), r.since_record) for r in found.orderBy("i").collect()] == [(0.1, 0), (0.2, 0), (0.0, 1), (0.0, 2), (0.1, 0)]


def test_calibration_of_ordered_ratings(spark):
    table = spark.createDataFrame([("s", i, float(i), float(i - 4)) for i in range(10)] + [("one", 1, 1.0, 1.0), ("none", 1, None, 1.0)], "scope string, id int, score double, outcome double")
    found = {r.scope: r for r in records.calibration(table, "scope", "id", "score", "outcome", table["outcome"] > 0).collect()}
    assert found["s"].calibrated and math.isclose(found["s"].spearman, 1) and (found["s"].top_good, found["s"].bottom_good) == (1.0, 0.0)
    assert not found["one"].calibrated and "none" not in found


def test_evidence_stops_at_the_first_closed_gate(spark):
    table = spark.createDataFrame([(1, True, True), (2, False, True), (3, True, None)], "id int, a boolean, b boolean")
    assert rows(records.evidence(table, [("one", table["a"]), ("two", table["b"])]).select("id", "state")) == [(1, "two"), (2, "candidate"), (3, "one")]


def test_cluster_bounds_hold_the_mean(spark):
    table = spark.createDataFrame([("g", c, float((c * 37 + i * 11) % 13)) for c in range(40) for i in range(3)] + [("few", 1, 2.0)], "g string, c int, x double")
    found = {r.g: r for r in records.cluster_bootstrap(table, "g", "c", "x").collect()}
    assert found["g"].lower < found["g"].mean < found["g"].upper and found["few"].lower is None


def test_sessions(spark):
    days = [f"2020-01-{d:02d}" for d in range(1, 12)]
    panel = spark.createDataFrame([("a", d) for d in days], "ts_code string, trade_date string")
    for keep in range(13):
        want = days if keep >= len(days) else [days[i * 10 // max(keep - 1, 1)] for i in range(keep)]
        assert [r.trade_date for r in sampling.even_sessions(panel, keep).orderBy("trade_date").collect()] == want
    assert sampling.even_sessions(panel.limit(1), 3).count() == 1 and sampling.even_sessions(panel.limit(0), 3).count() == 0
    assert [r.trade_date for r in sampling.latest_sessions(panel, 2).orderBy("trade_date").collect()] == days[-2:]
    more = panel.unionByName(spark.createDataFrame([("b", days[3]), ("b", "2021-01-01")], panel.schema))
    assert rows(sampling.common_sessions(more, "ts_code").select("ts_code", "trade_date")) == [("a", days[3]), ("b", days[3])]


def test_scales(spark):
    panel = spark.createDataFrame([("a", "d", 1.0), ("b", "d", 2.0), ("c", "d", None), ("e", "d", 2.0)], "ts_code string, trade_date string, x double")
    found = {r.ts_code: r.y for r in sampling.centred_rank(panel, "x", "y", 0.0).collect()}
    assert {k: round(v, 9) for k, v in found.items()} == {"a": -0.3, "b": 0.0, "c": 0.0, "e": 0.0}
    assert min(r.x for r in sampling.clipped_zscores(panel, ["x"], 0.5).collect() if r.x is not None) == -0.5


def test_nearest_quantile(spark):
    table = spark.createDataFrame([("g", float(x)) for x in (5, 1, 4, 2, 3)] + [("g", None)], "g string, x double")
    for q, want in ((0.0, 1.0), (0.3, 2.0), (0.95, 5.0)):
        assert [r.v for r in table.select(evaluate.nearest(table["x"], q, "g").alias("v")).collect() if r.v is not None] == [want]


def test_path_returns_and_empty_windows(spark):
    navs = spark.createDataFrame([("a", 1, 1.1), ("a", 2, 1.21)], "k string, trade_date int, nav double")
    found = stats.path_returns(navs, "k")
    assert [round(r.ret, 9) for r in found.orderBy("trade_date").collect()] == [0.1, 0.1]
    assert rows(stats.rolling_sharpe(found, "k", 5)) == [("a", 0, 0.0, 0.0, 0.0, 0.0)]


def test_column_cache(spark, tmp_path):
    panel = spark.createDataFrame([("a", d, float(d)) for d in range(5)], "ts_code string, trade_date int, close double")
    want = [("a", 0, None)] + [("a", d, 1.0) for d in range(1, 5)]
    first = cached_factors(panel, {"f": "ts_delta(close,1)"}, str(tmp_path), "v1")
    assert sorted(map(tuple, first.collect()), key=lambda r: r[1]) == want
    # Found again without the panel's rows; another identity or sign has another key.
    again = cached_factors(panel.limit(0), {"f": "ts_delta( close, 1)"}, str(tmp_path), "v1")
    assert again.count() == 5 and cached_factors(panel.limit(0), {"f": "ts_delta(close,1)"}, str(tmp_path), "v2").count() == 0
    assert column_key(panel, {"f": "-close"}, "v1") != column_key(panel, {"f": "close"}, "v1")
    # A write that broke off is done again.
    (tmp_path / column_key(panel, {"f": "ts_delta(close,1)"}, "v1") / "_SUCCESS").unlink()
    assert cached_factors(panel, {"f": "ts_delta(close,1)"}, str(tmp_path), "v1").count() == 5
