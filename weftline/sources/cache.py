"""Factor columns and feature matrices kept as Parquet, found again by what they were computed from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame

from weftline.plans.compiler import factors
from weftline.plans.expression import oriented, parse
from weftline.sources.panel import KEY

#: Part of every key; a change in how columns are computed needs another one.
PROTOCOL = "columns-1"


def column_key(panel: DataFrame, expressions: dict[str, str], identity: str) -> str:
    """Key of the columns: protocol, the panel's identity and schema, names and canonical expressions with their sign."""
    signed = {name: [sign, node.text()] for name, text in expressions.items() for sign, node in [oriented(parse(text, panel.columns))]}
    return hashlib.sha256(json.dumps([PROTOCOL, identity, panel.dtypes, signed], sort_keys=True).encode()).hexdigest()


def complete(df: DataFrame, path: str) -> bool:
    """Whether a write to the path has ended."""
    jvm = df.sparkSession._jvm
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(done)


def cached_factors(panel: DataFrame, expressions: dict[str, str], root: str, identity: str) -> DataFrame:
    """ts_code, trade_date and a column for each expression, read from root, where they are written if they aren't there whole.

    identity says which data the panel holds (a version or a path with its time); a panel with other data needs another one. A write that broke off is done again.
    Two jobs that write the same key write the same rows, but not at one time: give each its own root or let one fill it first.
    """
    path = f"{root.rstrip('/')}/{column_key(panel, expressions, identity)}"
    if not complete(panel, path):
        factors(panel, expressions).select(*KEY, *expressions).write.mode("overwrite").parquet(path)
    return panel.sparkSession.read.parquet(path)
