"""Sources and sinks besides the panel: ledgers, CSV, result logs, manifests, databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.relational import latest


def write_ledger(rows: DataFrame, path: str) -> None:
    """Parquet with zstd; an empty ledger keeps its columns."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(rows: DataFrame, path: str, seq: str, gzip: bool = False) -> None:
    """CSV part files in the order of seq, each with a header; the sort is by range, so no task holds all rows."""
    rows.orderBy(seq).write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def latest_results(spark: SparkSession, path: str, schema: str, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key of a log that is only appended to."""
    return latest(spark.read.schema(schema).json(path), keys, *order)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, modified and sha256 of artifacts; a file is hashed by one task, which holds it (artifacts are below 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def identity(spark: SparkSession, path: str) -> str:
    """One hash over the paths, sizes and times of a source's files, without reading them: it changes when the source does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length", F.xxhash64("path", "length", "modificationTime").alias("hash"))
    # Sums don't depend on the order of files, and no task gathers them.
    sums = (F.count(F.lit(1)), F.sum("length"), F.sum(F.col("hash").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("hash")))
    return files.agg(F.sha2(F.concat_ws("|", *[F.coalesce(s, F.lit(0)).cast("string") for s in sums]), 256)).first()[0]


def read_database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a database by JDBC; partitionColumn, lowerBound, upperBound and numPartitions need dbtable instead of query."""
    source = {"dbtable": query} if "partitionColumn" in options else {"query": query}
    return spark.read.format("jdbc").options(url=url, **source, **options).load()


def split_by(rows: DataFrame, column: str, path: str) -> None:
    """One folder for each value of a column."""
    rows.write.mode("overwrite").partitionBy(column).parquet(path)
