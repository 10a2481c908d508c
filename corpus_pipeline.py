"""Corpus pipeline: language ID, line dedup, near-duplicate join, benchmark decontamination, mixing.

Each stage takes all rows that its predecessor kept and hands on the columns of `documents` (the last one returns the mix itself: texts,
a row for each epoch). `run` writes every stage's rows as Parquet into the shared checkpoint folder and goes on from the files.

Defined results: a text that language ID can't place (`und`, or a share of its best language below MIN_SCORE) goes; documents keep their
place when line dedup empties them; of each group of near duplicates the document with the group's smallest id stays (a null id
comes last, then the smallest hash of the text decides; of rows that repeat it, one); a document that contains a benchmark item goes. Empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, shared_folder, table
from weftline.llm.decontaminate import find_contained
from weftline.llm.jaccard_join import few, near_duplicates
from weftline.llm.language_id import UNKNOWN, identify
from weftline.llm.line_dedup import dedup_lines
from weftline.llm.mixing import mixed_texts

#: Clean text in two or three languages passes, letters without a language don't.
MIN_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough."""
    found = identify(docs)
    return found.filter((F.col("language.lang_pred") != UNKNOWN) & (F.col("language.score") >= MIN_SCORE)).drop("language")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are in ten documents or more; n_chars follows."""
    found = dedup_lines(docs).withColumn("text", F.col("lines.kept"))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    found = cut(near_duplicates(docs).groupBy("doc_id", "text_hash").agg(F.first("group").alias("group"), F.count(F.lit(1)).alias("rows")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "rows")).alias("x")
    # Documents without shingles are in no group and stay.
    alone = found.filter("group is null").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "rows")
    stays = cut(found.filter("group is not null").groupBy("group").agg(first).select("x.d", "x.h", "x.rows").unionByName(alone))
    same = lambda keys: docs["doc_id"].eqNullSafe(keys["d"]) & (F.xxhash64(docs["text"]) == keys["h"])
    once = few(stays.filter("rows = 1"))
    kept = docs.join(once, same(once), "left_semi")
    again = stays.filter("rows > 1")
    if again.limit(1).count():
        often = few(again)
        kept = kept.unionByName(docs.join(often, same(often), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    leaks = cut(find_contained(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct())
    leaks = few(leaks)
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["d"]) & (F.xxhash64(docs["text"]) == leaks["h"]), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per document and epoch, with epoch and epoch_words."""
    return mixed_texts(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The language model's decisions can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(out)
    return docs
