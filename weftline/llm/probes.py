"""Sums of values that documents look up by 64-bit keys in a table too large to send along.

The table is dealt by key into shards, packed as sorted arrays. A pass over documents packs the keys that it
can't resolve on its own, by shard, with the number of the document each belongs to; one row holds what one
piece of the input asks of one shard. Each shard answers with a sum for each document. Texts never move.

A document's number is its partition's number and its place in it; the pass is cut (written once) before its
numbers are used, so a lost executor can't renumber documents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from weftline.llm.common import look_up

#: Columns of a probe row: shard, slice, number of the piece's first document, packed keys (u64) and document places (i32).
PROBE = "shard int, slice int, base long, keys binary, rows binary"
#: May follow: a packed number (f32) for each key, for a second sum.
EXTRA = "extra binary"


def first_number() -> int:
    """Number of the first document of this task's partition."""
    return TaskContext.get().partitionId() << 40


def by_shard(shards: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts hashes by shard (hash modulo shards), and where each shard starts in it."""
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def probe_rows(shards: int, slices: int, base: int, hashes: np.ndarray, rows: np.ndarray, extra: np.ndarray | None = None, by: np.ndarray | None = None) -> list[tuple]:
    """Probe rows of one piece, dealt by the keys or by `by`. A shard's probes are spread over `slices` tasks by piece."""
    order, at = by_shard(shards, hashes if by is None else by)
    part = (base * 0x9E3779B97F4A7C15 >> 32) % slices
    return [(k, part, base, hashes[own].tobytes(), rows[own].astype(np.int32).tobytes(), *([] if extra is None else [extra[own].astype(np.float32).tobytes()])) for k in range(shards) if len(own := order[at[k] : at[k + 1]])]


ANSWER = "base long, rows binary, totals binary, hits binary, more binary"


def answered(second: Callable[[np.ndarray, np.ndarray], np.ndarray] | None):
    """Sums and numbers of hits by document, packed by piece, of the probes of one shard and slice; with `second` also sums of second(value, extra)."""

    def answer(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(probes) and len(index):
            keys, values = np.frombuffer(index["index_keys"].iloc[0], np.uint64), np.frombuffer(index["index_values"].iloc[0], np.float64)
            for base, packed, places, extra in zip(probes["base"], probes["keys"], probes["rows"], probes["extra"] if second else probes["rows"], strict=True):
                got = look_up(keys, values, np.frombuffer(packed, np.uint64), np.nan)
                rows = np.frombuffer(places, np.int32)[hit := ~np.isnan(got)]
                if len(rows):
                    hits, sums = np.bincount(rows), np.bincount(rows, got[hit])
                    some = np.flatnonzero(hits)
                    more = np.bincount(rows, second(got[hit], np.frombuffer(extra, np.float32)[hit]))[some].tobytes() if second else b""
                    found.append((base, some.astype(np.int32).tobytes(), sums[some].tobytes(), hits[some].astype(np.int32).tobytes(), more))
        return pd.DataFrame(found, columns=["base", "rows", "totals", "hits", "more"]).astype({"base": "int64"})

    return answer


def merged(answers: pd.DataFrame) -> pd.DataFrame:
    """One row for each document of a piece, from the answers of all shards."""
    rows = np.concatenate([np.frombuffer(x, np.int32) for x in answers["rows"]])
    totals = np.bincount(rows, np.concatenate([np.frombuffer(x, np.float64) for x in answers["totals"]]))
    hits = np.bincount(rows, np.concatenate([np.frombuffer(x, np.int32) for x in answers["hits"]])).astype(np.int64)
    more = np.concatenate([np.frombuffer(x, np.float64) for x in answers["more"]])
    more = np.bincount(rows, more) if len(more) else np.zeros(len(hits))
    some = np.flatnonzero(hits)
    return pd.DataFrame({"number": int(answers["base"].iloc[0]) + some, "total": totals[some], "hits": hits[some], "more": more[some]})


def grouped(probes: DataFrame, index: DataFrame, slices: int = 1) -> PandasCogroupedOps:
    """Probes of each shard and slice beside their shard. index: one row per shard with shard, keys (sorted u64) and values (f64)."""
    copies = index.select(F.col("shard").alias("index_shard"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("index_slice"), F.col("keys").alias("index_keys"), F.col("values").alias("index_values"))
    return probes.groupBy("shard", "slice").cogroup(copies.groupBy("index_shard", "index_slice"))


def sums(probes: DataFrame, index: DataFrame, slices: int = 1, second: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """number, total, hits, more (the sum of `second`, or 0) for each document with a hit. index as for grouped()."""
    answers = grouped(probes, index, slices).applyInPandas(answered(second), ANSWER)
    return answers.groupBy("base").applyInPandas(merged, "number long, total double, hits long, more double")
