"""Tables of results: duplicates and ranking, libraries merged, catalogues, searches in progress, calibration, summaries by task. A row is a result, a report or an attempt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distribution function of Poisson(1) at 0 to 7.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)

def equivalence(results: DataFrame, fingerprints: list[str], count: str, key: str) -> DataFrame:
    """Add group (first fingerprint that isn't null or empty, else the key), group_size, representative (most records, then smallest key) and duplicate_of (null for representatives)."""
    group = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in fingerprints], F.col(key).cast("string"))
    members = Window.partitionBy("group")
    first = F.first(key).over(members.orderBy(F.col(count).desc_nulls_last(), key))
    found = results.withColumn("group", group).withColumn("group_size", F.count(F.lit(1)).over(members)).withColumn("_first", first)
    return found.withColumn("representative", F.col("_first") == F.col(key)).withColumn("duplicate_of", F.when(F.col("_first") != F.col(key), F.col("_first"))).drop("_first")


def leaderboard(results: DataFrame, scope: str, order: list[str], key: str) -> DataFrame:
    """Add place within the scope by several columns, highest first and nulls last, then by key. Ranks representatives; duplicates take their representative's place. Needs equivalence()."""
    best = Window.partitionBy(scope).orderBy(*[F.col(c).desc_nulls_last() for c in order], key)
    placed = results.filter("representative").select(F.col("group"), F.row_number().over(best).alias("place"))
    return results.join(placed, "group", "left")


def merged(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key out of two libraries: the higher version stays, the current one in a tie. Adds state: added, updated, kept (the incoming one is older or the same) or only (not incoming)."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    keys = Window.partitionBy(key)
    rows = rows.withColumn("_place", F.row_number().over(keys.orderBy(F.col(version).desc_nulls_last(), "_new"))).withColumn("_old", F.min("_new").over(keys)).withColumn("_last", F.max("_new").over(keys))
    state = F.when(F.col("_old") == 1, "added").when(F.col("_new") == 1, "updated").when(F.col("_last") == 1, "kept").otherwise("only")
    return rows.filter("_place = 1").withColumn("state", state).drop("_new", "_place", "_old", "_last")


def catalogue(reports: DataFrame, identity: str, active: Column, scope: list[str], when: str, key: str) -> DataFrame:
    """One row an identity, the active copy where there is one (then the smallest key), with copies, archive_copies and latest: whether it is the newest of its scope (then the largest key)."""
    same = Window.partitionBy(identity)
    rows = reports.withColumn("_active", F.coalesce(active, F.lit(False)))
    rows = rows.withColumn("copies", F.count(F.lit(1)).over(same)).withColumn("archive_copies", F.sum((~F.col("_active")).cast("long")).over(same))
    rows = rows.withColumn("_copy", F.row_number().over(same.orderBy(F.desc("_active"), key))).filter("_copy = 1")
    newest = Window.partitionBy(*scope).orderBy(F.col(when).desc_nulls_last(), F.desc(key))
    return rows.withColumn("latest", F.row_number().over(newest) == 1).drop("_active", "_copy")


def search_progress(attempts: DataFrame, by: str, order: str, score: str, floor: float = 0.0) -> DataFrame:
    """Add best_before (floor at first), gain (what the attempt adds to it, 0 at least) and since_record (attempts since the best score so far was reached)."""
    past = Window.partitionBy(by).orderBy(order)
    before = past.rowsBetween(Window.unboundedPreceding, -1)
    rows = attempts.withColumn("best_before", F.greatest(F.coalesce(F.max(score).over(before), F.lit(floor)), F.lit(floor))).withColumn("_n", F.row_number().over(past))
    rows = rows.withColumn("gain", F.greatest(F.coalesce(F.col(score) - F.col("best_before"), F.lit(0.0)), F.lit(0.0)))
    record = F.max(F.when(F.col("gain") > 0, F.col("_n"))).over(past.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("since_record", (F.col("_n") - F.coalesce(record, F.lit(0))).cast("long")).drop("_n")


def calibration(ratings: DataFrame, scope: str, key: str, score: str, outcome: str, good: Column, buckets: int = 4) -> DataFrame:
    """Whether ratings order outcomes, by scope: n, spearman, shares of good outcomes in the best and worst quarter and in all, monotonicity of bucket means, calibrated.

    Rows without score or outcome don't count. Buckets cut the order by (score, key) at floor(b * n / buckets).
    """
    rows = ratings.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("_good", F.coalesce(good, F.lit(False)).cast("double"))
    all_of = Window.partitionBy(scope)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(all_of)).withColumn("_p", F.row_number().over(all_of.orderBy(score, key)))
    for c in (score, outcome):
        ties = F.count(F.lit(1)).over(Window.partitionBy(scope, c))
        rows = rows.withColumn(f"_r_{c}", F.rank().over(all_of.orderBy(c)) + (ties - 1) / 2)
    k, quarter = F.least(F.lit(buckets), F.col("n")), F.greatest(F.lit(1), F.ceil(F.col("n") / 4))
    rows = rows.withColumn("bucket", F.ceil(k * F.col("_p") / F.col("n")).cast("int")).withColumn("_bottom", F.col("_p") <= quarter).withColumn("_top", F.col("_p") > F.col("n") - quarter)
    corr = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    whole = rows.groupBy(scope).agg(
        F.max("n").alias("n"), corr(f"_r_{score}", f"_r_{outcome}").alias("spearman"), F.avg("_good").alias("all_good"),
        F.avg(F.when(F.col("_top"), F.col("_good"))).alias("top_good"), F.avg(F.when(F.col("_bottom"), F.col("_good"))).alias("bottom_good"),
    )
    means = rows.groupBy(scope, "bucket").agg(F.avg(outcome).alias("_mean")).groupBy(scope).agg(corr("bucket", "_mean").alias("monotonicity"))
    found = whole.join(means, scope)
    fits = (F.col("spearman") >= 0.25) & (F.col("top_good") >= F.col("all_good")) & (F.col("top_good") > F.col("bottom_good")) & (F.col("monotonicity") > 0)
    return found.withColumn("calibrated", F.coalesce(fits, F.lit(False)))


def task_summary(records: DataFrame, task: str, valid: Column, passed: Column, score: str, source: str) -> DataFrame:
    """By task (null: unknown): records, valid, passed (of the valid), best score of the valid (0 without any), sources: a map of counts. Counted by source first, so that a large task isn't one group."""
    v = F.coalesce(valid, F.lit(False))
    rows = records.groupBy(F.coalesce(F.col(task), F.lit("unknown")).alias(task), F.coalesce(F.col(source), F.lit("unknown")).alias("_source")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(v.cast("long")).alias("valid"), F.sum((v & F.coalesce(passed, F.lit(False))).cast("long")).alias("passed"), F.max(F.when(v, F.col(score))).alias("best")
    )
    return rows.groupBy(task).agg(
        F.sum("records").alias("records"), F.sum("valid").alias("valid"), F.sum("passed").alias("passed"), F.coalesce(F.max("best"), F.lit(0.0)).alias("best"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("_source", "records")))).alias("sources")
    )


def feedback_summary(records: DataFrame, task: str, order: str, valid: Column, passed: Column, score: str, expression: str, reasons: str, numbers: str, most: int = 12) -> DataFrame:
    """By task: records, valid, errors, passed, pass_rate (of the valid), score_mean, score_std, score_best, duplicate_rate (of expressions without blanks and case), reasons (the `most` most frequent
    with their counts, of equals the one that came first), means (of each finite number by name).

    reasons: an array column; numbers: a map column; order: tells which record came first. All are sums by (task, reason), (task, name) and (task, expression) before they meet by task. A
    null task is `unknown`; a null score counts as 0; only valid records count but for `records`.
    """
    rows = records.withColumns({"_task": F.coalesce(F.col(task).cast("string"), F.lit("unknown")), "_v": F.coalesce(valid, F.lit(False))})
    x = F.when(F.col("_v"), F.coalesce(F.col(score), F.lit(0.0)))
    whole = rows.groupBy("_task").agg(
        F.count(F.lit(1)).alias("records"), F.count(x).alias("valid"), F.count(F.when(F.col("_v") & F.coalesce(passed, F.lit(False)), 1)).alias("passed"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("score_mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("score_std"), F.coalesce(F.max(x), F.lit(0.0)).alias("score_best"),
    )
    good = rows.filter("_v")
    plain = F.lower(F.regexp_replace(expression, r"\s+", ""))
    texts = good.filter(plain != "").groupBy("_task", plain.alias("_text")).agg(F.count(F.lit(1)).alias("_n"))
    texts = texts.groupBy("_task").agg((1 - F.count(F.lit(1)) / F.sum("_n")).alias("duplicate_rate"))
    named = good.select("_task", order, F.posexplode(reasons).alias("_at", "reason")).groupBy("_task", "reason").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(order, "_at")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_task").orderBy(F.desc("count"), "_first"))
    top = named.withColumn("_place", place).filter(F.col("_place") <= most).groupBy("_task").agg(F.sort_array(F.collect_list(F.struct("_place", "reason", "count"))).alias("reasons"))
    top = top.withColumn("reasons", F.transform("reasons", lambda r: F.struct(r["reason"].alias("reason"), r["count"].alias("count"))))
    value = F.col("_value").cast("double")
    means = good.select("_task", F.explode(numbers).alias("_name", "_value")).filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).groupBy("_task", "_name").agg(F.avg(value).alias("_mean"))
    means = means.groupBy("_task").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_name", "_mean")))).alias("means"))
    found = whole.join(texts, "_task", "left").join(top, "_task", "left").join(means, "_task", "left")
    rate = F.coalesce(F.try_divide(F.col("passed").cast("double"), F.col("valid")), F.lit(0.0))
    return found.select(F.col("_task").alias(task), "records", "valid", (F.col("records") - F.col("valid")).alias("errors"), "passed", rate.alias("pass_rate"), "score_mean", "score_std", "score_best", F.coalesce("duplicate_rate", F.lit(0.0)).alias("duplicate_rate"), "reasons", "means")


def evidence(results: DataFrame, gates: list[tuple[str, Column]], first: str = "candidate") -> DataFrame:
    """Add state: the name of the last gate passed in a row from the first one, which a result without any hasn't left. gates: (state reached, condition); a null condition doesn't pass."""
    passed = [F.coalesce(c, F.lit(False)) for _, c in gates]
    state = F.lit(first)
    for k, (name, _) in enumerate(gates):
        state = F.when(reduce(lambda a, b: a & b, passed[: k + 1]), name).otherwise(state)
    return results.withColumn("state", state)


def cluster_bootstrap(rows: DataFrame, by: str, cluster: str, value: str, repeats: int = 200, seed: int = 1729) -> DataFrame:
    """lower and upper 95 % bound of the mean when whole clusters are drawn again, by group; null with fewer than two clusters.

    Clusters are summed first. Each gets a Poisson(1) number of draws in a repeat, from a hash of (seed, repeat, group, cluster), which stands for drawing with
    replacement where clusters are many; repeats are sums by (group, repeat), so no task holds all clusters.
    """
    sums = rows.filter(F.col(value).isNotNull()).groupBy(by, cluster).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c"))
    drawn = sums.select(by, cluster, "_s", "_c", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_rep"))
    text = F.concat_ws("/", F.lit(str(seed)), F.col("_rep").cast("string"), F.col(by).cast("string"), F.col(cluster).cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2.0**32
    times = sum(((u >= edge).cast("int") for edge in POISSON), F.lit(0))
    means = drawn.withColumn("_k", times).groupBy(by, "_rep").agg(F.try_divide(F.sum(F.col("_k") * F.col("_s")), F.sum(F.col("_k") * F.col("_c"))).alias("_m"))
    bounds = means.groupBy(by).agg(F.percentile("_m", 0.025).alias("lower"), F.percentile("_m", 0.975).alias("upper"))
    clusters = sums.groupBy(by).agg(F.count(F.lit(1)).alias("clusters"), F.try_divide(F.sum("_s"), F.sum("_c")).alias("mean"))
    return clusters.join(bounds, by).select(by, "clusters", "mean", *[F.when(F.col("clusters") >= 2, F.col(c)).alias(c) for c in ("lower", "upper")])
