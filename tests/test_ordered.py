"""Expressions over sorted rows in one pass, against the windows of `factors`."""

import math
import random
from datetime import date, timedelta

import pytest

from weftline.plans.compiler import factors
from weftline.plans.dsl_queries import rolling_features
from weftline.plans.expression import ExpressionError
from weftline.plans.features import ROLLING
from weftline.plans.ordered import KERNELS, ordered_factors, value_summary

EXPRESSIONS = {name.lower(): text.format(w=7) for name, text in ROLLING.items()} | {
    "one": "ts_mean(close,1)", "spread": "ts_std(close,2)", "none": "ts_std(close,1)", "deep": "ts_sum(ts_mean(delay(close,2),3),4)", "signs": "-sign(close-open)*2", "corner": "ts_quantile(close,7,1)", "lowest": "ts_quantile(close,7,0)", "row": "minimum(open,close)/(low-low*1)",
}


@pytest.fixture(scope="module")
def bars(spark):
    draw, rows = random.Random(3), []
    for code, n in ((1, 90), (2, 6), (3, 7), (4, 1), (None, 30), (5, 40), (6, 25)):
        for i in range(n):
            close = draw.choice([1.0, 1.0, 2.0, 3.5, round(draw.uniform(1, 9), 2)]) if code != 6 else 4.0
            open_, vol = draw.choice([1.0, close, close + 1]), float(draw.choice([1, 5, 7]))
            row = [open_, max(open_, close) + 0.5, min(open_, close) - 0.5, close, vol]
            if code == 5 and draw.random() < 0.08:
                row[draw.randrange(5)] = draw.choice([None, float("nan"), None])
            rows.append((code, date(2020, 1, 1) + timedelta(i), *row))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "ts_code long, trade_date date, open double, high double, low double, close double, vol double")


@pytest.mark.parametrize("batch", [3, 11, 10000])
def test_same_as_windows(spark, bars, batch):
    want = {(r["ts_code"], r["trade_date"]): r for r in factors(bars, EXPRESSIONS).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = ordered_factors(bars, EXPRESSIONS).collect()
        summary = {r["feature"]: (r["n"], r["mean"]) for r in value_summary(bars, EXPRESSIONS).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(want) == 199
    number = lambda v: None if v is None or math.isnan(v) else v
    for name in EXPRESSIONS:
        values = [(number(r[name]), number(want[r["ts_code"], r["trade_date"]][name])) for r in found]
        wrong = [(a, b) for a, b in values if (a is None) != (b is None) or a is not None and a != pytest.approx(b, rel=1e-7, abs=1e-7)]
        assert not wrong, (name, wrong[:5])
        there = [b for _, b in values if b is not None]
        assert summary[name][0] == len(there), name
        assert summary[name][1] == (pytest.approx(sum(there) / len(there), rel=1e-7, abs=1e-7) if there else None), name
    assert all(any(kernel in text for text in EXPRESSIONS.values()) for kernel in KERNELS)


def test_library_needs_no_sliding_windows(spark):
    plan = rolling_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan


def test_refuses_other_functions(bars):
    with pytest.raises(ExpressionError):
        ordered_factors(bars, {"x": "rank(close)"})
