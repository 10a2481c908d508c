"""Expanding-window residuals and the price-scale check, against plain versions."""

import random
from datetime import date, timedelta

import numpy as np
import pytest

from weftline.operators import residuals
from weftline.plans import semantics

FIELDS = ("open", "high", "low", "close", "vol", "amount", "pb")


@pytest.mark.parametrize("folds, embargo, exits", [(5, 0, False), (4, 2, True), (50, 0, False)])
def test_forward_residuals(spark, folds, embargo, exits):
    draw = random.Random(9)
    day = lambda i: date(2020, 1, 1) + timedelta(i)
    rows = []
    for i in range(23):
        for code in range(draw.choice([3, 6])):
            x = [draw.gauss(5, 2), draw.gauss(0, 100), 7.0]
            y = 2 + 0.5 * x[0] - 0.01 * x[1] + draw.gauss(0, 0.1)
            if draw.random() < 0.08:
                x[0] = draw.choice([None, float("nan"), float("inf")])
            rows.append((i, code, day(i), day(i + 3), y if draw.random() > 0.05 else None, *x))
    found = residuals.forward_residuals(spark.createDataFrame(rows, "i int, code int, trade_date date, until date, y double, a double, b double, c double"), "y", ["a", "b", "c"], folds, 0.5, embargo, exit="until" if exits else None)
    got = {(r["i"], r["code"]): r["residual"] for r in found.collect()}
    whole = lambda r: all(v is not None and np.isfinite(v) for v in r[4:])
    want = dict.fromkeys(got)
    for block in np.array_split(np.arange(23), min(folds, 23))[1:]:
        train = [r for r in rows if r[0] < block[0] and (not exits or r[3] < day(int(block[0]))) and whole(r)]
        test = [r for r in rows if r[0] in block[embargo:] and whole(r)]
        if len(train) < 5 or not test:
            continue
        x, y, z = np.array([r[5:] for r in train]), np.array([r[4] for r in train]), np.array([r[5:] for r in test])
        centre, spread = x.mean(axis=0), x.std(axis=0)
        spread = np.where(spread > 1e-12, spread, 1)
        design = np.column_stack([np.ones(len(x)), (x - centre) / spread])
        penalty = 0.5 * np.eye(4)
        penalty[0, 0] = 0
        b = np.linalg.solve(design.T @ design + penalty, design.T @ y)
        for r, p in zip(test, np.column_stack([np.ones(len(z)), (z - centre) / spread]) @ b, strict=True):
            want[r[0], r[1]] = r[4] - p
    assert sum(v is not None for v in want.values()) > 30
    assert {k: v is None for k, v in got.items()} == {k: v is None for k, v in want.items()}
    assert all(got[k] == pytest.approx(v) for k, v in want.items() if v is not None)


CASES = {
    "close/amount": ("mixed", False), "ts_delta(close,5)/amount": ("mixed", False), "returns(close,5)/amount": ("ok", True), "(high-low)/close*amount": ("ok", True), "(high-low)/amount": ("mixed", False),
    "amount/ts_mean(amount,20)": ("ok", True), "ts_corr(close,amount,20)": ("ok", True), "close-open": ("ok", False), "rank(close)*rank(amount)": ("mixed", False), "ts_rank(close,20)*amount": ("ok", True),
    "-(close*amount)": ("mixed", False), "ts_mean(close/open,5)+amount": ("ok", True), "close*vol": ("ok", False), "pb*amount": ("ok", True), "log(close/open)*amount": ("ok", True), "(close*2)/(open+amount)": ("mixed", True),
}


def test_price_scales(spark):
    for text, (status, free) in CASES.items():
        assert semantics.audit(text, FIELDS)[:2] == (status, free), text
    rows = spark.createDataFrame([(t,) for t in [*CASES, "close+", "unknown(close)", None]], "expression string")
    found = {r["expression"]: r["verdict"] for r in semantics.audited(rows, "expression", FIELDS).collect()}
    assert {t: (v["status"], v["scale_free"]) for t, v in found.items() if t in CASES} == CASES
    assert all(found[t]["status"].startswith("error") and found[t]["fields"] == [] for t in ("close+", "unknown(close)", None))
    assert found["(close*2)/(open+amount)"]["mixed"] == ["(open+amount)"] and found["close*vol"]["fields"] == ["close", "vol"]
