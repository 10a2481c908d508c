"""Distinct sources of return: clusters around representatives, and a diverse choice of candidates.

Paths are arrays of numbers, one place a period; the correlation of two counts the places where both have a finite number, and exists with
LEAST of them and some spread on both sides. Only positive correlation makes two sources alike.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.functions.ranges import cut, few, numbered, shared_folder, written

#: Places that two paths must share, and the spread (sum of squares) that each must have there.
LEAST, SPREAD = 4, 1e-12
#: Undecided rows of a scope that are settled together, and rows that are held against their representatives in a task.
BATCH, SLICE = 1024, 2048


def correlations(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Correlation of each row of left with each of right; -inf where there is none. Sums over common places are matrix products of values and masks."""
    sides = []
    for x in (left, right):
        here = np.isfinite(x)
        middle = np.divide(np.where(here, x, 0).sum(axis=1), np.maximum(here.sum(axis=1), 1))
        sides.append((np.where(here, x - middle[:, None], 0), here.astype(float)))
    (a, ma), (b, mb) = sides
    n, sa, sb = ma @ mb.T, a @ mb.T, ma @ b.T
    some = np.maximum(n, 1)
    va, vb = (a * a) @ mb.T - sa * sa / some, ma @ (b * b).T - sb * sb / some
    there = (n >= LEAST) & (va > SPREAD) & (vb > SPREAD)
    found = (a @ b.T - sa * sb / some) / np.sqrt(np.where(there, va * vb, 1))
    return np.where(there, np.clip(found, -1, 1), -np.inf)


def paths_of(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column]) if len(column) else np.empty((0, 0))


def packed(paths: pd.Series) -> pd.Series:
    return paths.map(lambda x: np.array([np.nan if v is None else v for v in x], np.float64).tobytes())


def settle(path: np.ndarray, decided: np.ndarray, threshold: float) -> np.ndarray:
    """Which of some rows in order are representatives: those that no earlier one is like, and that weren't decided before."""
    like, chosen = correlations(path, path) >= threshold, []
    for k in np.flatnonzero(~decided):
        if not like[k, chosen].any():
            chosen.append(k)
    return np.isin(np.arange(len(path)), chosen)


def nearest(rows: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
    """rows with best (correlation), best_place of the representative in heads or before that is most like them; of equals the first. A representative is its own."""
    if not len(heads) or not len(rows):
        return rows
    heads = heads.sort_values("place")
    found, places = correlations(paths_of(rows["path"]), paths_of(heads["path"])), heads["place"].to_numpy()
    own = rows["place"].to_numpy()
    found = np.where(places[None, :] < own[:, None], found, -np.inf)
    at = found.argmax(axis=1)
    value, before = found[np.arange(len(rows)), at], rows["best"].to_numpy(float)
    better = value > before
    head = np.isin(own, places)
    rows["best"] = np.where(head, 1.0, np.where(better, value, before))
    rows["best_place"] = np.where(head, own, np.where(better, places[at], rows["best_place"].to_numpy()))
    return rows


STATE = "scope string, place long, path binary, best double, best_place long"


def by_scope(threshold: float):
    """All rows of a small scope at once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place").reset_index(drop=True)
        heads = rows[settle(paths_of(rows["path"]), np.zeros(len(rows), bool), threshold)]
        return nearest(rows, heads)

    return run


def representatives(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place").reset_index(drop=True)
        return rows[settle(paths_of(rows["path"]), np.zeros(len(rows), bool), threshold)][["scope", "place", "path"]]

    return run


def representative_clusters(rows: DataFrame, scope: str, order: list[Column], path: str, threshold: float = 0.85, batch: int = BATCH) -> DataFrame:
    """rows with place (in the scope's order, from 0), best_place (that of the representative) and correlation to it. Rows whose path has fewer than LEAST places are left out.

    In order, a row that no earlier representative of its scope is like becomes one; the others go to the earlier representative that
    they are most like. So there is no chain from like to like. Scopes of up to `batch` rows are settled each in one task. Of a larger scope each round settles
    the next rows, as many as hold `batch` undecided ones, and holds the new representatives against slices of all rows behind them: the work is rows
    times representatives, no group meets in one task, and rounds are at most rows / batch.
    """
    pack = F.pandas_udf(packed, "binary")
    placed = numbered(cut(rows.filter(F.size(path) >= LEAST).withColumn("scope_key", F.coalesce(F.col(scope).cast("string"), F.lit("")))), ["scope_key"], order)
    placed = cut(placed)
    start = placed.select(F.col("scope_key").alias("scope"), "place", pack(F.col(path).cast("array<double>")).alias("path"), F.lit(float("-inf")).alias("best"), F.lit(-1).cast("long").alias("best_place"))
    sizes = few(cut(start.groupBy("scope").agg(F.count(F.lit(1)).alias("rows"))))
    sized = start.join(sizes, "scope")
    folder = f"{shared_folder(rows.sparkSession)}/representatives-{uuid.uuid4().hex}"
    small = sized.filter(F.col("rows") <= batch).drop("rows").groupBy("scope").applyInPandas(by_scope(threshold), STATE)
    small.drop("path").write.parquet(f"{folder}/found")
    tables = (f"{folder}/{k}" for k in count())
    state = written(sized.filter(F.col("rows") > batch).drop("rows"), next(tables))
    while state.limit(1).count():
        bucket = F.floor(F.col("place") / batch).alias("bucket")
        open_rows = state.groupBy("scope", bucket).agg(F.count(F.when(F.col("best") < threshold, 1)).alias("open"))
        so_far = Window.partitionBy("scope").orderBy("bucket")
        fits = (F.sum("open").over(so_far) <= batch) | (F.row_number().over(so_far) == 1)
        upto = few(written(open_rows.withColumn("fits", fits).filter("fits").groupBy("scope").agg(((F.max("bucket") + 1) * batch).alias("upto")), next(tables)))
        now = state.join(upto, "scope")
        heads = written(now.filter((F.col("place") < F.col("upto")) & (F.col("best") < threshold)).select(*state.columns).groupBy("scope").applyInPandas(representatives(threshold), "scope string, place long, path binary"), next(tables))
        slices = now.groupBy("scope", "upto", F.floor(F.col("place") / SLICE).alias("slice")).agg(F.lit(1).alias("one"))
        dealt = heads.join(few(written(slices.select("scope", "slice"), next(tables))), "scope")
        held = now.withColumn("slice", F.floor(F.col("place") / SLICE)).groupBy("scope", "slice").cogroup(dealt.groupBy("scope", "slice")).applyInPandas(lambda x, y: nearest(x, y).drop(columns="slice"), f"{STATE}, upto long")
        held = written(held, next(tables))
        held.filter(F.col("place") < F.col("upto")).drop("upto", "path").write.mode("append").parquet(f"{folder}/found")
        state = written(held.filter(F.col("place") >= F.col("upto")).drop("upto"), next(tables))
    found = rows.sparkSession.read.parquet(f"{folder}/found").select(F.col("scope").alias("scope_key"), "place", "best_place", F.col("best").alias("correlation"))
    return placed.join(found, ["scope_key", "place"]).drop("scope_key")


def cluster_sizes(clusters: DataFrame, scope: str) -> DataFrame:
    """A row for each representative: its place and the number of its rows."""
    return clusters.groupBy(scope, "best_place").agg(F.count(F.lit(1)).alias("size"), F.avg("correlation").alias("mean_correlation"))


def cluster_summary(clusters: DataFrame, scope: str) -> DataFrame:
    """scope, rows, clusters, redundancy, hhi (of cluster sizes), effective (1 / hhi), largest."""
    found = cluster_sizes(clusters, scope).groupBy(scope).agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("clusters"), F.max("size").alias("largest"), F.sum(F.col("size") * F.col("size")).alias("_squares"))
    hhi = F.col("_squares") / (F.col("rows") * F.col("rows"))
    return found.select(scope, "rows", "clusters", (1 - F.col("clusters") / F.col("rows")).alias("redundancy"), hhi.alias("hhi"), (1 / hhi).alias("effective"), "largest")


def family_summary(clusters: DataFrame, scope: str, family: str) -> DataFrame:
    """scope, family, rows, clusters that have one of them, represented (clusters whose representative is one of them)."""
    return clusters.groupBy(scope, family).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("best_place").alias("clusters"), F.count(F.when(F.col("place") == F.col("best_place"), 1)).alias("represented"))


@F.pandas_udf(DoubleType())
def correlation(a: pd.Series, b: pd.Series) -> pd.Series:
    """Correlation of two paths of a row; null where there is none or their lengths differ."""
    found = np.full(len(a), np.nan)
    lengths = np.array([-1 if x is None or y is None or len(x) != len(y) else len(x) for x, y in zip(a, b, strict=True)])
    for n in np.unique(lengths[lengths >= LEAST]):
        rows = np.flatnonzero(lengths == n)
        x, y = (np.stack([np.asarray(s.iloc[i], np.float64) for i in rows]) for s in (a, b))
        here = np.isfinite(x) & np.isfinite(y)
        some = np.maximum(here.sum(axis=1), 1)[:, None]
        x, y = (np.where(here, v - np.where(here, v, 0).sum(axis=1, keepdims=True) / some, 0) for v in (x, y))
        vx, vy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        there = (here.sum(axis=1) >= LEAST) & (vx > SPREAD) & (vy > SPREAD)
        found[rows[there]] = np.clip((x * y).sum(axis=1)[there] / np.sqrt(vx * vy)[there], -1, 1)
    return pd.Series(found).astype(object).where(np.isfinite(found), None)


def diverse_candidates(rows: DataFrame, id: str, structure: str, mechanism: str, order: list[Column], path: str, cap: float = 0.80, per_mechanism: int = 3, most: int = 8) -> DataFrame:
    """id, mechanism, state, kept, correlation, place: what becomes of each candidate.

    The first of each structure in order stands for it (`structure`: the others name it in kept). In each mechanism candidates are then taken in order, unless one that was
    taken is correlated above `cap` (`path`: kept names the most correlated), until per_mechanism are (`mechanism`: what comes later). Taken ones come up for choice in turns,
    the first of each mechanism, then the second, mechanisms by their first; `most` are `chosen`, with place from 1, the others `surplus`.
    Each turn takes the first open row of all mechanisms by one aggregate and strikes what it excludes by one join, so per_mechanism turns do it, and no mechanism
    meets in a task. Candidates without a structure stand for themselves; ids break ties; a null mechanism is one of its own.
    """
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(id).alias("id"))
    base = cut(rows.select(F.col(id).alias("id"), F.col(structure).alias("structure"), F.coalesce(F.col(mechanism).cast("string"), F.lit("")).alias("mechanism"), key.alias("key"), F.col(path).cast("array<double>").alias("path")))
    named = F.when(F.col("structure").isNull(), F.concat(F.lit("="), F.col("id").cast("string"))).otherwise(F.concat(F.lit(":"), F.col("structure").cast("string")))
    base = base.withColumn("structure", named)
    firsts = few(cut(base.groupBy("structure").agg(F.min(F.struct("key")).alias("first")).select("structure", F.col("first.key.id").alias("first"))))
    held = cut(base.join(firsts, "structure"))
    alone, same = held.filter("id = first"), held.filter("id <> first")
    left, taken = alone.select("id", "mechanism", "key", "path"), []
    for turn in range(per_mechanism):
        best = cut(left.groupBy("mechanism").agg(F.min_by(F.struct("key", "path"), "key").alias("_b")).select("mechanism", "_b.*"))
        taken.append(best.withColumn("turn", F.lit(turn)))
        other = few(best.select(F.col("mechanism").alias("_m"), F.col("key").alias("_key"), F.col("path").alias("_path")))
        like = F.coalesce(correlation(F.col("path"), F.col("_path")) > cap, F.lit(False))
        left = cut(left.join(other, F.col("mechanism") == F.col("_m")).filter((F.col("key") > F.col("_key")) & ~like).select("id", "mechanism", "key", "path"))
    picked = cut(reduce(DataFrame.unionByName, taken))
    firsts_of = picked.filter("turn = 0").select("mechanism", F.col("key").alias("lead"))
    in_turn = picked.join(few(cut(firsts_of)), "mechanism").select(F.col("key.id").alias("id"), "mechanism", "turn", "lead").orderBy("turn", "lead").limit(most)
    place = F.row_number().over(Window.orderBy("turn", "lead"))  # over `most` rows
    chosen = cut(in_turn.withColumn("place", place).select(F.col("id").alias("_chosen"), "place"))
    ahead = few(picked.select(F.col("mechanism").alias("_m"), F.col("key").alias("_key"), F.col("path").alias("_path"), "turn"))
    met = alone.join(ahead, (F.col("mechanism") == F.col("_m")) & (F.col("_key") <= F.col("key")))
    met = met.withColumn("c", F.when(F.col("_key") < F.col("key"), correlation(F.col("path"), F.col("_path"))))
    like = F.max_by(F.struct(F.col("_key.id").alias("kept"), "c"), F.when(F.col("c") > cap, F.struct("c", -F.col("turn"))))
    judged = met.groupBy("id", "mechanism").agg(like.alias("like"), F.count(F.when(F.col("_key") < F.col("key"), 1)).alias("before"), F.max(F.col("_key") == F.col("key")).alias("taken"))
    judged = judged.join(F.broadcast(chosen), F.col("id") == F.col("_chosen"), "left")
    state = F.when(F.col("place").isNotNull(), "chosen").when(F.col("taken"), "surplus").when(F.col("before") >= per_mechanism, "mechanism").otherwise("path")
    judged = judged.withColumn("state", state)
    why = lambda c: F.when(F.col("state") == "path", F.col("like")[c])
    return judged.select("id", "mechanism", "state", why("kept").alias("kept"), why("c").alias("correlation"), "place").unionByName(
        same.select("id", "mechanism", F.lit("structure").alias("state"), F.col("first").alias("kept"), F.lit(None).cast("double").alias("correlation"), F.lit(None).cast("int").alias("place"))
    )
