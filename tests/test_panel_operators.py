"""Operators that SQL doesn't check, against brute force, and files and streams by round trips."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.functions import ranges
from weftline.operators import evaluate, events, ledger, relational, search, similarity
from weftline.plans import compiler, panel_queries
from weftline.plans.expression import ExpressionError, expression_hash, parse, required_history, validate
from weftline.sources import files
from weftline.streaming import telemetry

FIELDS = ("open", "close", "vol")


def test_cooldown_is_greedy(spark):
    rng = random.Random(5)
    data = [(code, i) for code in range(4) for i in sorted(rng.sample(range(200), 60))]
    want, last = [], {}
    for code, i in data:
        if code not in last or i - last[code] > 7:
            want.append((code, i))
            last[code] = i
    got = events.cooldown(spark.createDataFrame(data, "ts_code long, calendar_idx int").repartition(5), 7)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_asof_join_counts_equal_times(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 2.0), ("a", 2, 1.0), ("c", 1, 9.0)], "k string, t int, v double")
    assert sorted(map(tuple, relational.asof_join(left, right, "k", "t", "v").collect()), key=str) == [("a", 1, None), ("a", 5, 2.0), ("b", 3, None)]


def test_range_join_is_complete(spark):
    ranges = [(i, lo, lo + w) for i, (lo, w) in enumerate([(0, 3), (2, 25), (10, 0), (9, 11)])]
    got = relational.range_join(spark.range(30).withColumnRenamed("id", "x"), spark.createDataFrame(ranges, "r int, low int, high int"), "x", "low", "high", 7)
    assert sorted((row.x, row.r) for row in got.collect()) == sorted((x, r) for x in range(30) for r, lo, hi in ranges if lo <= x <= hi)


def test_clusters_are_components(spark):
    ids = spark.createDataFrame([(i,) for i in range(7)], "id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "a long, b long")
    assert {r.id: r.cluster for r in similarity.clusters(spark, ids, pairs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}


def test_simplex_adds_up():
    grid = search.simplex(3, 4)
    assert len(grid) == len(set(grid)) == 15
    assert all(abs(sum(w) - 1) < 1e-12 and min(w) >= 0 for w in grid)


def test_bootstrap_does_not_depend_on_partitions(spark):
    series = [0.01, -0.02, 0.03, 0.0, 0.01]
    a, b = (sorted(map(tuple, search.block_bootstrap(spark, series, 50, 2, 3).collect())) for _ in range(2))
    assert a == b and len(a) == 50


def test_risk_budget_is_equal_for_equal_risks(spark):
    cov = spark.createDataFrame([(0, 0, 0.04), (0, 1, 0.0), (1, 1, 0.04)], "a int, b int, cov double").toPandas()
    weights = search.risk_budget(cov, cap=0.9)
    assert weights[0] == pytest.approx(0.5) and sum(weights.values()) == pytest.approx(1)


def test_candidates_of_runs(spark):
    rng, day = random.Random(3), date(2020, 1, 1)
    data = [(code, day + timedelta(i), 1.0, 1.0, 1e4, rng.random(), code + 1) for code in range(6) for i in range(12)]
    panel = spark.createDataFrame(data, "ts_code long, trade_date date, open double, close double, vol double, factor double, univ_rank int")
    found = ledger.candidates(panel, spark.createDataFrame([ledger.asdict(ledger.Run("a", positions=2, universe=5)), ledger.asdict(ledger.Run("b", positions=1, every=4, direction=-1))])).collect()
    signal = {(c, d + timedelta(1)): x for c, d, _, _, _, x, _ in data}
    for run, every, most, universe, sign in (("a", 5, 2, 5, -1), ("b", 4, 1, 500, 1)):
        picks = {(r["trade_date"], r["ts_code"]) for r in found if r["run_id"] == run and r["picked"]}
        want = {(d, c) for i in range(1, 12) if i % every == 0 for d in [day + timedelta(i)] for c in sorted((c for c in range(6) if c + 1 <= universe), key=lambda c: sign * signal[c, d])[:most]}
        assert picks == want
        assert len([r for r in found if r["run_id"] == run]) == 12 * len({c for _, c in picks})


def test_closes_are_carried_over_pauses(spark):
    day = lambda i: date(2020, 1, 1) + timedelta(i)
    rows = [(1, day(i), float(i)) for i in range(8)] + [(2, day(2), None), (2, day(3), 5.0), (2, day(6), None), (3, day(7), 9.0)]
    found = evaluate.previous_close(spark.createDataFrame(rows, "ts_code long, trade_date date, close double")).collect()
    own = {(c, d): x for c, d, x in rows}
    want = []
    for code in (1, 2, 3):
        last = None
        for i in range(8):
            last = own.get((code, day(i))) if own.get((code, day(i))) is not None else last
            want.append((code, day(i), last))
    assert sorted((tuple(r) for r in found), key=str) == sorted(want, key=str)


def test_history_counts_rows_of_paused_entities(spark):
    day = lambda i: date(2020, 1, 1) + timedelta(i)
    rows = [(1, day(i), float(i)) for i in range(300)] + [(2, day(i), float(i)) for i in (0, 1, 2, 3, 290, 295)]
    panel = spark.createDataFrame(rows, "ts_code long, trade_date date, close double")
    expression = "ts_mean(close,4)"
    kept = compiler.with_history(panel, expression, day(288), day(296))
    inside = F.col("trade_date").between(day(288), day(296))
    values = lambda p: {(r["ts_code"], r["trade_date"]): r["factor"] for r in compiler.factor(p, expression).filter(inside).collect()}
    assert values(kept) == values(panel) and values(kept)[2, day(290)] is not None
    assert kept.count() < 30 and kept.filter("ts_code = 2").count() >= 5


def test_asof_join_over_ranges(spark, monkeypatch):
    draw = random.Random(5)
    left = [(draw.choice([1, 1, 1, 2, None]), draw.randrange(400), i) for i in range(500)]
    right = [(draw.choice([1, 1, 1, 2]), t, t * 10) for t in draw.sample(range(400), 120)]
    a, b = spark.createDataFrame(left, "user long, at long, id long"), spark.createDataFrame(right, "user long, at long, value long")
    plain = sorted((tuple(r) for r in relational.asof_join(a, b, "user", "at", "value").collect()), key=str)
    monkeypatch.setattr(relational, "GROUP_ROWS", 10)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 60)
    assert sorted((tuple(r) for r in relational.asof_join(a, b, "user", "at", "value").collect()), key=str) == plain
    best = lambda u, t: max(((x, v) for w, x, v in right if w == u and x <= t), default=(0, None))[1]
    assert plain == sorted(((u, t, i, best(u, t)) for u, t, i in left), key=str)


def test_language_refuses_what_it_does_not_allow():
    for text in ("close-close", "ts_corr(close,vol,5)", "f(close)", "__import__('os')", "close**2", "ts_mean(close,0)", "nothing"):
        assert validate(text, FIELDS)
    assert validate("rank(ts_mean(close,5))", FIELDS) == ""
    with pytest.raises(ExpressionError):
        parse("close" + "+close" * 2000, FIELDS)


def test_hash_ignores_the_outer_sign_and_history_nests():
    assert expression_hash(parse("-rank(close)", FIELDS)) == expression_hash(parse("rank(close)", FIELDS))
    assert required_history(parse("ts_mean(ts_mean(close,5),10)", FIELDS)) == 13


def test_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a,{i}") for i in range(50)], "seq int, name string")
    files.write_csv(rows, f"{tmp_path}/c", "seq", gzip=True)
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/c", "seq int, name string").collect())) == sorted(map(tuple, rows.collect()))
    files.write_ledger(rows.limit(0), f"{tmp_path}/empty")
    assert spark.read.parquet(f"{tmp_path}/empty").columns == ["seq", "name"]
    for version in (1, 2):
        files.append_results(rows.limit(3).withColumn("v", F.lit(version)), f"{tmp_path}/log")
    last = files.latest_results(spark, f"{tmp_path}/log", "seq int, name string, v int", ["seq"], "v")
    assert [r.v for r in last.collect()] == [2, 2, 2]
    before = files.identity(spark, f"{tmp_path}/log")
    assert before == files.identity(spark, f"{tmp_path}/log")
    files.append_results(rows, f"{tmp_path}/log")
    assert before != files.identity(spark, f"{tmp_path}/log")
    assert files.manifest(spark, f"{tmp_path}/c").filter("length(sha256) = 64").count() > 0


def test_daily_bars_follow_new_files(spark, tmp_path):
    source, target, state = f"{tmp_path}/in", f"{tmp_path}/bars", f"{tmp_path}/state"
    start = datetime(2024, 1, 1, 9)
    schema = "ts timestamp, user_id long, value double"
    spark.createDataFrame([(start, 1, 1.0), (start + timedelta(days=1), 1, 5.0)], schema).write.parquet(source)
    telemetry.keep_daily_bars(spark, source, target, state).awaitTermination()
    spark.createDataFrame([(start + timedelta(hours=1), 1, 3.0)], schema).write.mode("append").parquet(source)
    telemetry.keep_daily_bars(spark, source, target, state).awaitTermination()
    assert sorted((str(r.day), r.n, r.total) for r in spark.read.parquet(target).collect()) == [("2024-01-01", 2, 4.0), ("2024-01-02", 1, 5.0)]


def test_latency_runs_on_a_stream(spark, tmp_path):
    schema = "ts timestamp, kind string, value double"
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 0, i), "a", float(i)) for i in range(10)], schema)
    rows.write.parquet(f"{tmp_path}/in")
    stream = telemetry.latency(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts", "value", ["kind"], late="10 minutes")
    stream.writeStream.format("memory").queryName("latency").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (str(r.start), r.n, r.p50)
    assert sorted(map(key, spark.table("latency").collect())) == sorted(map(key, telemetry.latency(rows, "ts", "value", ["kind"]).collect()))


def test_a_long_chain_is_one_cluster(spark):
    ids = spark.createDataFrame([(i,) for i in range(102)], "id long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(99)], "a long, b long")
    assert {r.id: r.cluster for r in similarity.clusters(spark, ids, pairs).collect()} == {i: 0 if i < 100 else i for i in range(102)}


def odd_panel(spark, rows=40):
    """Three entities over some sessions, with an infinite close."""
    days = spark.range(rows).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("trade_date"), "id")
    return days.crossJoin(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "ts_code string, k int")).select(
        "ts_code", "trade_date", (F.col("id") + F.col("k") + 1.0).alias("open"), F.when((F.col("id") == 5) & (F.col("k") == 1), F.lit(float("inf"))).otherwise(F.col("id") * 1.5 + F.col("k")).alias("close"), F.lit(1.0).alias("vol")
    )


def test_labels_follow_the_market_and_refuse_repeated_sessions(spark):
    from weftline.sources.panel import with_labels

    panel = odd_panel(spark).filter("not (ts_code = 'b' and day(trade_date) = 3)").cache()
    got = {(r["ts_code"], r["trade_date"].day): r["fwd_2"] for r in with_labels(panel.filter("month(trade_date) = 1"), (2,)).collect()}
    assert got["a", 1] == (3 + 1 + 1) / (1 + 1 + 1) - 1 and got["b", 2] is None and got["b", 1] == (3 + 2 + 1) / (1 + 2 + 1) - 1 and got["a", 30] is None
    with pytest.raises(Exception, match="several rows in one session"):
        with_labels(panel.unionByName(panel.filter("ts_code = 'c'").limit(1)), (2,)).select(F.sum("fwd_2")).collect()


def test_a_constant_factor_has_no_evaluation_rows(spark):
    from weftline.operators.evaluate import evaluation_rows
    from weftline.sources.panel import LAYERS, with_labels

    panel = with_labels(odd_panel(spark), (5,)).withColumn("layer", F.lit(LAYERS[0].name)).withColumn("univ_rank", F.lit(1))
    moved = panel.withColumn("trade_date", F.lit(LAYERS[0].end).cast("date")).withColumn("label_exit_date_5", F.lit(LAYERS[0].end).cast("date"))
    assert evaluation_rows(moved.withColumn("factor", F.lit(1.0)), 5, embargo=0).count() == 0
    assert evaluation_rows(moved.withColumn("factor", F.col("close")), 5, embargo=0).count() > 0


def test_values_that_are_not_finite_count_as_missing(spark):
    from weftline.plans.compiler import factor

    panel = odd_panel(spark)
    value = {(r["ts_code"], r["trade_date"].day, r["trade_date"].month): r["factor"] for r in factor(panel, "where(close,1,2)").collect()}
    assert value["a", 6, 1] is None and value["a", 7, 1] == 1
    found = {(r["ts_code"], r["trade_date"].day, r["trade_date"].month): r["factor"] for r in factor(panel, "ts_median(close,5)").collect()}
    assert found["a", 8, 1] is None or found["a", 8, 1] < float("inf")


def test_universe_ties_by_code(spark, monkeypatch):
    """The same amounts in another order have the same mean, though their sums as doubles differ."""
    amounts = [round(17.13 * 1.9**i + 0.01 * i, 2) for i in range(20)]
    data = [(code, date(2020, 1, 1) + timedelta(i), a) for code in range(6) for i, a in enumerate(random.Random(code).sample(amounts, 20))]
    monkeypatch.setattr(panel_queries, "panel", lambda *_: spark.createDataFrame(data, "ts_code long, trade_date date, amount double"))
    found = panel_queries.universe(spark, "").filter("amt60 is not null").collect()
    assert {r["ts_code"]: r["univ_rank"] for r in found} == {code: code + 1 for code in range(6)}
