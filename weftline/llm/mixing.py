"""Mixing sources to target weights (DataFrame functions only).

Each document gets a hash-random key. Rows are range-sorted by source and key; sums of the ranges give every
range's offset, a window inside a range gives the rest of the prefix sum, and the source's budget cuts
the sequence at the exact word. Rows that share an id share a key; the text's hash and the row's place then part them, so that
ranges stay even however often an id repeats. No task ever holds a source: neither a range nor the list of a source's
ranges grows beyond RANGE_ROWS rows or the number of ranges.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null
doc_id sorts as an empty id; rows that repeat a doc_id are mixed as separate rows; an empty table gives an
empty result; other columns are ignored, and `mixed_texts` passes them on. A source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, SPACES_RE, WORD_RE, cut, table

KEY_BITS = 60
RANGE_ROWS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Add `target` to one row per source (source, source_size): share of all words by weight, at most `most` times a source's size.

    Handing the excess of capped sources to the others by weight ends where target = min(cap, level * weight)
    with one level for all. Ordered by cap / weight, a source is capped if its ratio is not above the level that
    is left when all sources before it are capped. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    rows = rows.withColumn("whole", F.sum("source_size").over(everything) * F.lit(share)).withColumn("weights", F.sum("weight").over(everything))
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = F.try_divide(F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("capped", F.coalesce(F.col("cap") / F.col("weight") <= level, F.lit(True)))
    left = F.try_divide(
        F.col("whole") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything),
        F.col("weights") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything),
    )
    return rows.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(left * F.col("weight"))).drop("weight", "cap", "whole", "weights", "capped")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key, hash (of the text), row (a number of the row) of every document."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_RE)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.xxhash64("text").alias("hash"), "row")


def taken_words(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Add source_size, target and taken to the rows that `sized` gives."""
    base = cut(rows)
    order = [F.col("source").asc_nulls_last(), "key", "hash", "row"]
    n_ranges = max(1, -(-base.count() // RANGE_ROWS))
    # Sorted ranges are numbered by their partition.
    ranged = cut(base.repartitionByRange(n_ranges, *order).withColumn("range", F.spark_partition_id()))
    by_range = cut(ranged.groupBy("source", "range").agg(F.sum("size").alias("words")))
    sizes = by_range.groupBy("source").agg(F.sum("words").alias("source_size"))
    budget = F.floor("target").cast("long")
    plan = cut(
        targets(sizes, weights, share, most)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", budget - F.col("passes") * F.col("source_size"))
        .withColumnRenamed("source", "plan_source")
    )
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    offsets = offsets.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select("plan_source", F.col("range").alias("at_range"), "source_size", "target", "passes", "rest", "offset")
    inside = Window.partitionBy("source", "range").orderBy("key", "hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    placed = ranged.join(offsets, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("range") == F.col("at_range")))
    return placed.select("row", "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words taken, repeats counted)."""
    rows = docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())
    return taken_words(sized(rows), weights, share, most).drop("row")


def mixed_texts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: one row per document and epoch with the columns of docs, `epoch` and `epoch_words`; columns of docs by these names give way.

    The document at a source's cut keeps its first `epoch_words` words, joined by single spaces; all others
    keep their text as it is. Documents of which nothing is taken are not in the mix. Rows are told apart by their place in docs, which is
    written once for that.
    """
    docs = docs.drop("epoch", "epoch_words")
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    inner = cut(docs.toDF(*at.values()).withColumn("row", F.monotonically_increasing_id()))
    rows = inner.select(*[F.col(at[c]).alias(c) for c in ("doc_id", "source", "text")], "row")
    taken = taken_words(sized(rows), weights, share, most).filter("taken > 0").select("row", "size", "taken")
    epochs = inner.join(taken, "row").withColumn("epoch", F.explode(F.sequence(F.lit(0), ((F.col("taken") - 1) / F.col("size")).cast("int"))))
    text, words = F.col(at["text"]), F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")).cast("long")
    short = F.array_join(F.slice(F.split(F.btrim(text, F.lit(SPACE)), SPACES_RE), F.lit(1), F.col("epoch_words").cast("int")), " ")
    out = epochs.withColumn("epoch_words", words).withColumn(at["text"], F.when(F.col("epoch_words") == F.col("size"), text).otherwise(short))
    return out.select(*[F.col(inside).alias(c) for c, inside in at.items()], "epoch", "epoch_words")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(doc_id::VARCHAR), 1, 15) AS key
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS weight
  FROM base GROUP BY source),
caps AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS whole, sum(weight) OVER () AS weights FROM sizes),
levels AS (
  SELECT *, (whole - coalesce(sum(cap) OVER w, 0)) / (weights - coalesce(sum(weight) OVER w, 0)) AS level FROM caps
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flags AS (SELECT *, coalesce(cap / weight <= level, true) AS capped FROM levels),
goals AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap ELSE (whole - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / (weights - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ()) * weight END AS target
  FROM flags),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END AS rest
  FROM goals),
runs AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM base)
SELECT r.doc_id, r.size, p.source_size, p.target,
       (p.passes * r.size + greatest(0, least(r.size, p.rest - r.before)))::BIGINT AS taken
FROM runs r JOIN plans p ON r.source IS NOT DISTINCT FROM p.source
"""
