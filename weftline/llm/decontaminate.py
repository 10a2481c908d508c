"""Benchmark decontamination (DataFrame functions only): size-partitioned MinHash containment search.

Items and documents are sets of five-word shingles (A-Z lower-cased, words split at white space), hashed to
64 bits; the hash value doubles as the min-wise order. An item is contained when a document holds at least
`threshold` of its distinct shingles.

Items are put into size partitions [2^p, 2^(p+1)). A MinHash sketch of an item is its lowest k hash
values, k growing with the size as far as a contained item may have missing shingles, plus one. A document that
contains the item must therefore hold a value of its sketch, so the search loses nothing. Each partition has its own table of sketches and
its own limit, the largest value in them: a document's sketch for a partition is all its shingles up to that limit, and only these probe
the partition's table. Long items have low limits, so that few shingles of a document ask for them; short ones have high limits and small tables.
Tables are broadcast in blocks of at most `block` rows, as many blocks as needed. Each candidate pair is then verified by exact shingle
containment over the whole document, word by word.

Defined results: items or documents that are null, empty or shorter than five words have no shingle and match
nothing; rows that repeat a doc_id and text give their pairs once; repeated item_ids with several texts
are items of their own, reported under their id; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, SPACES_RE, UPPER, cut, table

WORDS = 5
THRESHOLD = 0.8
BLOCK = 1 << 20


def with_shingles(df: DataFrame, *keep: str, whole: bool = False) -> DataFrame:
    """keep, grams: hashes of all shingles in order, or with `whole` their words joined by spaces."""
    words = F.split(F.btrim(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, UPPER.lower()), F.lit(SPACE)), SPACES_RE)
    at = ", ".join(f"w[i + {k}]" for k in range(WORDS))
    kind, gram = ("string", f"concat_ws(' ', {at})") if whole else ("bigint", f"xxhash64({at})")
    grams = F.expr(f"if(size(w) < {WORDS}, cast(array() as array<{kind}>), transform(sequence(0, size(w) - {WORDS}), i -> {gram}))")
    return df.select(*keep, words.alias("w")).select(*keep, grams.alias("grams"))


def item_sketches(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The shingles of the items as words (item_key, n: the item's size, gram), and their sketches (item_key, partition, gram)."""
    keyed = items.withColumn("item_key", F.struct("item_id", F.xxhash64("text").alias("h")))
    words = cut(with_shingles(keyed, "item_key", whole=True).select("item_key", F.explode(F.array_distinct("grams")).alias("gram")).distinct())
    sizes = words.groupBy("item_key").agg(F.count(F.lit(1)).alias("n"))
    hashes = with_shingles(keyed, "item_key").dropDuplicates(["item_key"]).select("item_key", F.array_sort(F.array_distinct("grams")).alias("grams"))
    sketch = hashes.join(sizes, "item_key").withColumn("depth", (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    sketch = sketch.select("item_key", F.floor(F.log2("n")).cast("int").alias("partition"), F.explode(F.slice("grams", F.lit(1), F.col("depth"))).alias("gram"))
    return words.join(sizes, "item_key"), cut(sketch)


def below(partition: int, limit: int) -> Column:
    """A document's sketch for a size partition: its shingles up to the limit."""
    return F.transform(F.filter("grams", lambda g: g <= F.lit(limit)), lambda g: F.struct(F.lit(partition).alias("partition"), g.alias("gram")))


def blocks(df: DataFrame, column: str, rows: int, block: int) -> list[DataFrame]:
    """df cut into parts of about `block` rows by a column of uniform hash values; one part if it is small."""
    n = -(-rows // block)
    return [df] if n <= 1 else [df.filter(F.pmod(F.col(column), F.lit(n)) == k) for k in range(n)]


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Pairs with doc_id, text_hash, item_id, n_item (distinct shingles of the item), n_shared, containment."""
    grams, sketch = item_sketches(items, threshold)
    # A row per power of two.
    partitions = sketch.groupBy("partition").agg(F.max("gram").alias("limit"), F.count(F.lit(1)).alias("rows")).collect()
    rows = sum(p["rows"] for p in partitions)
    base = docs.select("doc_id", "text").withColumn("doc_key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    probes = F.concat(*[below(p["partition"], p["limit"]) for p in partitions]) if partitions else F.expr("cast(array() as array<struct<partition:int,gram:bigint>>)")
    low = with_shingles(base, "doc_key").select("doc_key", F.array_distinct("grams").alias("grams")).select("doc_key", F.explode(probes).alias("x")).select("doc_key", "x.partition", "x.gram")
    hits = None
    for part in blocks(sketch, "gram", rows, block):
        found = low.join(F.broadcast(part), ["partition", "gram"]).select("doc_key", "item_key").distinct()
        hits = found if hits is None else hits.unionByName(found)
    pairs = cut(hits.distinct())
    keys = pairs.select("doc_key").distinct()
    n = keys.count()
    # A key is a long and a hash: a block of them is a few tens of MB. Beyond that, the texts are shuffled by key.
    some = base.join(F.broadcast(keys) if n <= block else keys, "doc_key", "left_semi")
    texts = with_shingles(some, "doc_key", whole=True).select("doc_key", F.explode(F.array_distinct("grams")).alias("gram"))
    shared = None
    for part in blocks(grams.withColumn("hash", F.xxhash64("gram")), "hash", rows * 8, block):
        found = texts.join(F.broadcast(part.drop("hash")), "gram").select("doc_key", "item_key", "n", "gram").distinct()
        shared = found if shared is None else shared.unionByName(found)
    counted = shared.groupBy("doc_key", "item_key", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    return counted.filter(F.col("n_shared") >= F.ceil(F.col("n") * threshold - 1e-9)).select(
        F.col("doc_key.doc_id").alias("doc_id"), F.col("doc_key.h").alias("text_hash"), F.col("item_key.item_id").alias("item_id"), F.col("n").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment")
    )


def op4_find_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


ORACLE_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+') FROM benchmark),
grams AS (
  SELECT DISTINCT side, id, g FROM (
    SELECT side, id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS g FROM words)),
items AS (SELECT id, g, count(*) OVER (PARTITION BY id) AS n FROM grams WHERE side = 'i'),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, i.n AS n_item, count(*) AS n_shared
  FROM grams d JOIN items i ON d.g = i.g WHERE d.side = 'd' GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared::DOUBLE / n_item AS containment FROM shared WHERE 5 * n_shared >= 4 * n_item
"""
