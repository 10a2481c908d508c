"""Versions of a source that changes under its readers: two equal looks before a load, and readers that stay on a whole version.

A look fingerprints the source's files without reading them. Files that are being written differ from look to look; only a source that two looks in a row found
equal, and that isn't the published one, is read, written as a version of its own, and looked at once more: if it changed meanwhile, the version is
dropped. A row in the pointer table then publishes it. Versions are never changed, so a reader that began on one ends on it.

Looks and pointers are Parquet tables in the target folder, so a watcher that starts again goes on where the last one ended. A source that
can't be read, though it stands still, publishes nothing and is tried again when it changed.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.files import identity

LOOKS = "look long, fingerprint string, state string, at timestamp"
POINTERS = "version long, path string, fingerprint string, rows long, at timestamp"
#: States of a look.
CHANGED, SAME, PUBLISHED, UNREADABLE, MOVED = "changed", "same", "published", "unreadable", "moved"


def kept_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that is only appended to; empty before its first row."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def append(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    names = [c.split()[0] for c in schema.split(", ")]
    table = spark.createDataFrame([row], schema.rpartition(", ")[0]).withColumn(names[-1], F.current_timestamp())
    table.coalesce(1).write.mode("append").parquet(path)


class Watcher:
    """Looks at `source` (a Parquet folder) and keeps versions of it below `target`."""

    def __init__(self, spark: SparkSession, source: str, target: str) -> None:
        self.spark, self.source, self.target = spark, source, target

    def last(self, name: str, schema: str, order: str):
        return kept_table(self.spark, f"{self.target}/{name}", schema).orderBy(F.desc(order)).first()

    def fingerprint(self) -> str:
        return identity(self.spark, self.source)

    def look(self) -> str:
        """One look; the state that it found or reached."""
        before, now, published = self.last("looks", LOOKS, "look"), self.fingerprint(), self.last("pointers", POINTERS, "version")
        if published and published["fingerprint"] == now:
            state = SAME
        elif not before or before["fingerprint"] != now:
            state = CHANGED
        elif before["state"] == UNREADABLE:
            state = UNREADABLE
        else:
            state = self.publish(now, published["version"] + 1 if published else 1)
        append(self.spark, f"{self.target}/looks", LOOKS, (before["look"] + 1 if before else 1, now, state))
        return state

    def publish(self, fingerprint: str, version: int) -> str:
        path = f"{self.target}/versions/{version}-{uuid.uuid4().hex}"
        try:
            self.spark.read.option("recursiveFileLookup", True).parquet(self.source).write.parquet(path)
        except (PySparkException, Py4JJavaError):
            return UNREADABLE
        if self.fingerprint() != fingerprint:
            return MOVED
        append(self.spark, f"{self.target}/pointers", POINTERS, (version, path, fingerprint, self.spark.read.parquet(path).count()))
        return PUBLISHED

    def start(self, checkpoint: str, seconds: float):
        """A streaming query that looks every so many seconds until it is stopped."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda _, __: self.look()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The published version; it stays whole while later ones are published."""
    found = kept_table(spark, f"{target}/pointers", POINTERS).orderBy(F.desc("version")).first()
    if not found:
        raise LookupError(f"no version is published below {target}")
    return spark.read.parquet(found["path"])
