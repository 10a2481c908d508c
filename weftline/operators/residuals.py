"""What components don't explain of a target: ridge regressions on an expanding window of sessions, without a look ahead.

The normal equations are sums, so one aggregate gives them for all folds: each row counts from the first fold on whose first session comes after the row's session
and after its label's end, and running sums over folds give every fold's training sums. The driver solves a small system for each fold; residuals
are one expression over the rows. Nothing is collected but folds x components^2 numbers.
"""

from __future__ import annotations

from math import isfinite

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.ranges import cut
from weftline.sources.panel import finite

#: Fixed value: least spread of a component in training.
FLAT = 1e-12


def with_folds(rows: DataFrame, folds: int, embargo: int, when: str = "trade_date", exit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """rows with fold, judged (not among the fold's first `embargo` sessions) and learned_from (the first fold that may train on the row; null: none); and the folds' first sessions.

    Sessions are cut into `folds` runs as even as can be, the longer ones first. They are few, so one task numbers them.
    """
    days = rows.select(when).distinct().withColumn("_i", F.row_number().over(Window.orderBy(when)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    runs = F.least(F.lit(folds), F.col("_n"))
    size, longer = F.floor(F.col("_n") / runs), F.col("_n") % runs
    early = longer * (size + 1)
    days = cut(days.withColumn("fold", F.when(F.col("_i") < early, F.floor(F.col("_i") / (size + 1))).otherwise(longer + F.floor((F.col("_i") - early) / size)).cast("int")))
    starts = days.groupBy("fold").agg(F.min(when).alias("start"), F.min("_i").alias("_first")).orderBy("fold")
    firsts = [r["start"] for r in starts.collect()]  # one a fold
    place = F.broadcast(days.join(F.broadcast(starts.select("fold", "_first")), "fold").select(when, "fold", (F.col("_i") >= F.col("_first") + embargo).alias("judged")))
    seen = F.greatest(F.col(when), F.col(exit)) if exit else F.col(when)
    learned = F.lit(None).cast("int")
    for k in range(len(firsts) - 1, 0, -1):
        learned = F.when(seen < F.lit(firsts[k]), k).otherwise(learned)
    return rows.join(place, when).withColumn("learned_from", learned), starts


def solve(n: float, x: np.ndarray, y: float, xx: np.ndarray, xy: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Intercept and slopes of the ridge regression on standardised components, in the components' own units, from sums."""
    centre = x / n
    spread = np.sqrt(np.maximum(np.diag(xx) / n - centre * centre, 0))
    spread = np.where(spread > FLAT, spread, 1.0)
    gram = (xx - n * np.outer(centre, centre)) / np.outer(spread, spread)
    slopes = np.linalg.lstsq(gram + ridge * np.eye(len(x)), (xy - y * centre) / spread, rcond=None)[0] / spread
    return y / n - slopes @ centre, slopes


def forward_residuals(rows: DataFrame, target: str, components: list[str], folds: int = 5, ridge: float = 1e-3, embargo: int = 0, when: str = "trade_date", exit: str | None = None) -> DataFrame:
    """rows with fold, prediction and residual, null in the first fold, on embargoed sessions, where a value isn't finite, and in folds with fewer than components + 2 (at least 3) rows to learn from. exit: the column of a label's last session."""
    placed, starts = with_folds(rows, folds, embargo, when, exit)
    whole = finite(F.col(target))
    for c in components:
        whole = whole & finite(F.col(c))
    placed = placed.withColumn("_whole", F.coalesce(whole, F.lit(False)))
    number = lambda c: F.col(c).cast("double")
    k = len(components)
    upper = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = [F.count(F.lit(1)).alias("n"), F.sum(number(target)).alias("y"), *[F.sum(number(c)).alias(f"x{i}") for i, c in enumerate(components)], *[F.sum(number(c) * number(target)).alias(f"y{i}") for i, c in enumerate(components)]]
    sums += [F.sum(number(components[i]) * number(components[j])).alias(f"x{i}_{j}") for i, j in upper]
    per_fold = placed.filter("_whole and learned_from is not null").groupBy("learned_from").agg(*sums).collect()
    total, fitted = None, {}
    for fold in range(1, starts.count()):
        for r in per_fold:
            if r["learned_from"] == fold:
                own = np.array([r["n"], r["y"], *[r[f"x{i}"] for i in range(k)], *[r[f"y{i}"] for i in range(k)], *[r[f"x{i}_{j}"] for i, j in upper]], float)
                total = own if total is None else total + own
        if total is not None and total[0] >= max(3, k + 2):
            xx = np.zeros((k, k))
            for (i, j), v in zip(upper, total[2 + 2 * k :], strict=True):
                xx[i, j] = xx[j, i] = v
            intercept, slopes = solve(total[0], total[2 : 2 + k], total[1], xx, total[2 + k : 2 + 2 * k], ridge)
            if isfinite(intercept) and np.isfinite(slopes).all():
                fitted[fold] = (intercept, slopes)
    prediction = F.lit(None).cast("double")
    for fold, (intercept, slopes) in fitted.items():
        value = sum((F.lit(float(b)) * number(c) for b, c in zip(slopes, components, strict=True)), F.lit(float(intercept)))
        prediction = F.when((F.col("fold") == fold) & F.col("judged") & F.col("_whole"), value).otherwise(prediction)
    return placed.withColumn("prediction", prediction).withColumn("residual", number(target) - F.col("prediction")).drop("_whole", "judged", "learned_from")
