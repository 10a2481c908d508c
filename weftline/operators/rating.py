"""Ratings of candidates from their measures: six components, a score that their weakest critical part holds down, caps by what was passed, and gates with reasons.

All is expressions over a row for each candidate. A measure that is missing counts as its worst.
"""

from __future__ import annotations

from math import inf
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Targets of a rating.
TARGETS = {"sharpe": 1.5, "ann_return": 0.12, "calmar": 1.5, "cost_cushion": 3.0, "turnover": 0.5, "participation": 0.05, "icir": 2.0, "alpha": 0.10, "train_floor": 0.25}
#: Weights of the components, and those that are critical.
WEIGHTS = {"profitability": 0.35, "confidence": 0.20, "robustness": 0.20, "generalization": 0.10, "implementation": 0.10, "signal": 0.05}
CRITICAL = ("profitability", "confidence", "robustness", "implementation")
#: Share of the score that doesn't hang on the weakest critical component; caps and states by the first gate that isn't passed; states by score.
FREE_SHARE = 0.70
CAPS = (("research_pass", 24.9, "research_rejected"), ("holdout_pass", 49.9, "holdout_rejected"), ("vault_pass", 64.9, "vault_rejected"), ("capacity_pass", 79.9, "capacity_limited"))
STATES = ((75.0, "capital_priority_non_pit"), (60.0, "paper_priority"), (-inf, "passed_low_conviction"))


def measure(name: str, worst: float) -> Column:
    x = F.col(name).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(float(worst))).otherwise(x)


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def components(trials: int, targets: dict[str, float] = TARGETS) -> dict[str, Column]:
    """Components from 0 to 1, of the measures sharpe_lcb, ann_return_lcb, calmar, return_t, psr, stress_sharpe, era_rate, year_rate, worst_era_sharpe, train_sharpe (the worse), holdout_sharpe, direction_kept,
    cost_cushion, turnover, participation, icir, monotonicity. trials: how many candidates were tested, for the t value that counts as sure."""
    sure = NormalDist().inv_cdf(1 - min(0.25, max(1e-6, targets["alpha"])) / max(1, trials))
    low = lambda name: measure(name, -99.0)
    none = lambda name: measure(name, 0.0)
    retained = unit(none("holdout_sharpe") / F.greatest(F.lit(targets["train_floor"]), none("train_sharpe")))
    kept = F.coalesce(F.col("direction_kept"), F.lit(False)).cast("double")
    return {
        "profitability": 0.45 * unit(low("sharpe_lcb") / targets["sharpe"]) + 0.35 * unit(low("ann_return_lcb") / targets["ann_return"]) + 0.20 * unit(low("calmar") / targets["calmar"]),
        "confidence": 0.65 * unit(low("return_t") / max(1e-9, sure)) + 0.35 * unit(none("psr")),
        "robustness": 0.40 * unit((low("stress_sharpe") + 0.25) / 1.75) + 0.25 * unit(none("era_rate")) + 0.15 * unit(none("year_rate")) + 0.20 * unit((low("worst_era_sharpe") + 0.50) / 2.0),
        "generalization": 0.75 * retained + 0.25 * kept,
        "implementation": 0.45 * unit(none("cost_cushion") / targets["cost_cushion"]) + 0.30 * F.exp(-measure("turnover", 99.0) / targets["turnover"]) + 0.25 * F.exp(-measure("participation", 99.0) / targets["participation"]),
        "signal": 0.60 * unit(none("icir") / targets["icir"]) + 0.40 * unit(none("monotonicity")),
    }


def rated(rows: DataFrame, trials: int, targets: dict[str, float] = TARGETS) -> DataFrame:
    """rows with the components, raw_score (0 to 100), score (capped by the first of research_pass, holdout_pass, vault_pass and capacity_pass that isn't true) and state."""
    found = rows.withColumns(components(trials, targets))
    whole = sum((w * F.col(name) for name, w in WEIGHTS.items()), F.lit(0.0))
    found = found.withColumn("raw_score", 100 * whole * (FREE_SHARE + (1 - FREE_SHARE) * F.least(*CRITICAL)))
    cap, state = F.lit(100.0), F.lit(STATES[-1][1])
    for least, name in reversed(STATES[:-1]):
        state = F.when(F.col("raw_score") >= least, name).otherwise(state)
    for gate, most, name in reversed(CAPS):
        passed = F.coalesce(F.col(gate), F.lit(False))
        cap, state = F.when(~passed, most).otherwise(cap), F.when(~passed, name).otherwise(state)
    return found.withColumn("score", F.least("raw_score", cap)).withColumn("state", state)


def gated(rows: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """rows with reasons (names of the gates that aren't passed, in order; a null condition isn't) and passes."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates]))
    return rows.withColumn("reasons", failed).withColumn("passes", F.size("reasons") == 0)


def blended(rows: DataFrame, scope: str, parts: dict[str, float]) -> DataFrame:
    """rows with blend, the weighted mean of the percentiles (0 to 1, ties share theirs; a scope of one has 1) that a row's measures have in its scope. A null measure has percentile 0."""
    all_of = Window.partitionBy(scope)
    total = F.lit(0.0)
    for name, weight in parts.items():
        below = F.rank().over(all_of.orderBy(F.col(name).asc_nulls_first())) - 1
        ties = F.count(F.lit(1)).over(Window.partitionBy(scope, name))
        n = F.count(F.lit(1)).over(all_of)
        share = F.when(n == 1, 1.0).otherwise((below + (ties - 1) / 2) / (n - 1))
        total = total + weight * F.when(F.col(name).isNotNull(), share).otherwise(0.0)
    return rows.withColumn("blend", total / sum(parts.values()))
