"""Ratings, gates and blends against plain Python."""

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from weftline.operators import rating

NAMES = ("sharpe_lcb", "ann_return_lcb", "calmar", "return_t", "psr", "stress_sharpe", "era_rate", "year_rate", "worst_era_sharpe", "train_sharpe", "holdout_sharpe", "cost_cushion", "turnover", "participation", "icir", "monotonicity")
GATES = ("research_pass", "holdout_pass", "vault_pass", "capacity_pass")


def plain(row, trials):
    worst = {"turnover": 99, "participation": 99} | dict.fromkeys(("sharpe_lcb", "ann_return_lcb", "calmar", "return_t", "stress_sharpe", "worst_era_sharpe"), -99)
    m = {k: row[k] if row[k] is not None and math.isfinite(row[k]) else worst.get(k, 0) for k in NAMES}
    unit = lambda x: min(max(x, 0), 1)
    sure = NormalDist().inv_cdf(1 - 0.1 / trials)
    parts = [
        0.45 * unit(m["sharpe_lcb"] / 1.5) + 0.35 * unit(m["ann_return_lcb"] / 0.12) + 0.2 * unit(m["calmar"] / 1.5), 0.65 * unit(m["return_t"] / sure) + 0.35 * unit(m["psr"]),
        0.4 * unit((m["stress_sharpe"] + 0.25) / 1.75) + 0.25 * unit(m["era_rate"]) + 0.15 * unit(m["year_rate"]) + 0.2 * unit((m["worst_era_sharpe"] + 0.5) / 2),
        0.75 * unit(m["holdout_sharpe"] / max(0.25, m["train_sharpe"])) + 0.25 * bool(row["direction_kept"]),
        0.45 * unit(m["cost_cushion"] / 3) + 0.3 * math.exp(-m["turnover"] / 0.5) + 0.25 * math.exp(-m["participation"] / 0.05), 0.6 * unit(m["icir"] / 2) + 0.4 * unit(m["monotonicity"]),
    ]
    raw = 100 * sum(w * p for w, p in zip((0.35, 0.2, 0.2, 0.1, 0.1, 0.05), parts, strict=True)) * (0.7 + 0.3 * min(parts[0], parts[1], parts[2], parts[4]))
    for gate, cap, state in (("research_pass", 24.9, "research_rejected"), ("holdout_pass", 49.9, "holdout_rejected"), ("vault_pass", 64.9, "vault_rejected"), ("capacity_pass", 79.9, "capacity_limited")):
        if not row[gate]:
            return raw, min(raw, cap), state
    return raw, raw, "capital_priority_non_pit" if raw >= 75 else "paper_priority" if raw >= 60 else "passed_low_conviction"


def test_ratings(spark):
    draw = random.Random(8)
    rows = []
    for i in range(300):
        good = i % 3 == 0
        row = {k: draw.choice([None, float("nan"), float("inf")]) if draw.random() < 0.04 else draw.uniform(1, 4) if good and k not in ("turnover", "participation") else draw.uniform(-1, 2) if k not in ("turnover", "participation") else draw.uniform(0, 0.02) for k in NAMES}
        rows.append({"id": i, **row, "direction_kept": draw.choice([True, False, None]), **{g: draw.random() < 0.85 or None for g in GATES}})
    schema = "id int, " + ", ".join(f"{k} double" for k in NAMES) + ", direction_kept boolean, " + ", ".join(f"{g} boolean" for g in GATES)
    table = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    found = {r["id"]: r for r in rating.rated(table, 40).collect()}
    for row in rows:
        raw, score, state = plain(row, 40)
        got = found[row["id"]]
        assert (got["raw_score"], got["score"]) == pytest.approx((raw, score)) and got["state"] == state
    assert len({r["state"] for r in found.values()}) == 7


def test_gates_and_blends(spark):
    rows = [(1, "a", 1.0, 5.0), (2, "a", 2.0, 5.0), (3, "a", None, 7.0), (4, "a", 2.0, None), (5, "b", 9.0, 1.0)]
    table = spark.createDataFrame(rows, "id int, scope string, x double, y double")
    found = {r["id"]: r for r in rating.gated(table, [("x", F.col("x") > 1), ("y", F.col("y") > 4)]).collect()}
    assert {i: (r["reasons"], r["passes"]) for i, r in found.items()} == {1: (["x"], False), 2: ([], True), 3: (["x"], False), 4: (["y"], False), 5: (["y"], False)}
    blend = {r["id"]: r["blend"] for r in rating.blended(table, "scope", {"x": 3.0, "y": 1.0}).collect()}
    assert blend == {1: pytest.approx(0.75 * 1 / 3 + 0.25 * 0.5), 2: pytest.approx(0.75 * 2.5 / 3 + 0.25 * 0.5), 3: pytest.approx(0.25), 4: pytest.approx(0.75 * 2.5 / 3), 5: pytest.approx(1.0)}
