"""Line dedup: a sharded minimal perfect hash over distinct line hashes indexes fingerprint and count arrays.

A line's key is the line without white space at both ends and with A-Z lower-cased; keys are hashed to 128 bits.
Spark counts in how many documents each hash occurs (map-side first, so a line of a third of all documents costs
one row per task). The distinct hashes are dealt to shards; each shard's minimal perfect hash maps its n hashes
to 0..n-1 and indexes an array of 32-bit fingerprints and one of counts. Documents probe the arrays: their line
hashes travel to the shards as packed numbers, never the lines, and only the positions of lines to drop come
back. A shard whose lines occur very often is probed in several slices, so no task holds a hot line's documents.

Defined results: a null or empty text is one empty line; empty keys are never dropped; a document is a row, so
rows that repeat a text count one by one; if two rows agree in doc_id and text they get the same result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, SPACE, cut, mix64, table

KEYS_PER_SHARD = 1 << 16
PROBES_PER_SLICE = 1 << 18
BITS_PER_KEY = 2
SPACE_BYTES = SPACE.encode()


def line_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the lines with a key that isn't empty, and their hashes as rows of two longs."""
    digest = xxhash.xxh3_128_digest
    keys = [line.strip(SPACE_BYTES) for line in (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n")]
    hashed = b"".join([digest(k) for k in keys if k])
    return np.array([i for i, k in enumerate(keys) if k], dtype=np.int32), np.frombuffer(hashed, dtype="<i8").reshape(-1, 2)


def hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct line hashes."""
    for batch in batches:
        found = [np.unique(line_hashes(t.as_py())[1], axis=0) for t in batch.column(0)]
        both = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], names=["hi", "lo"])


def probes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lines as row key, position, hash and number in the task."""
    number = 0
    for batch in batches:
        found = [line_hashes(t.as_py()) for t in batch.column(2)]
        sizes = [len(at) for at, _ in found]
        row = np.repeat(np.arange(len(sizes)), sizes)
        both = np.concatenate([h for _, h in found]) if found else np.empty((0, 2), dtype=np.int64)
        at = np.concatenate([a for a, _ in found]) if found else np.empty(0, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(at), *[pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], pa.array(np.arange(number, number + len(at)))],
            names=["doc_id", "text_hash", "at", "hi", "lo", "number"],
        )
        number += len(at)


def level_hash(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    return mix64(mix64(hi ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) + lo)


def fingerprints(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return (mix64(lo ^ mix64(~hi)) >> np.uint64(32)).astype(np.uint32)


def build_shard(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> dict:
    """Minimal perfect hash by levels: keys alone at their bit of a level settle there, the others go on to the next level."""
    hi, lo = hi.view(np.uint64), lo.view(np.uint64)
    left, sizes, levels = np.arange(len(hi)), [], []
    while len(left):
        size = max(64, len(left) * BITS_PER_KEY)
        at = (level_hash(hi[left], lo[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        sizes.append(size)
        left = left[~alone[at]]
    index = {"sizes": np.array(sizes, dtype=np.int64), "bits": np.packbits(np.concatenate(levels)) if levels else np.empty(0, np.uint8), "prints": np.empty(len(hi), np.uint32), "counts": np.empty(len(hi), np.int64)}
    slots = slots_of(index, hi, lo)
    index["prints"][slots], index["counts"][slots] = fingerprints(hi, lo), counts
    return index


def slots_of(index: dict, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Slot of each hash; -1 for hashes that no level knows."""
    bits = np.unpackbits(index["bits"])
    rank = np.cumsum(bits, dtype=np.int64) - 1
    slots, left, start = np.full(len(hi), -1, dtype=np.int64), np.arange(len(hi)), 0
    for level, size in enumerate(index["sizes"]):
        at = start + (level_hash(hi[left], lo[left], level) % np.uint64(size)).astype(np.int64)
        here = bits[at] == 1
        slots[left[here]] = rank[at[here]]
        left, start = left[~here], start + size
    return slots


def probe_shard(index: dict, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Document count of each hash; 0 for those that aren't in the index."""
    hi, lo = hi.view(np.uint64), lo.view(np.uint64)
    slots = slots_of(index, hi, lo)
    known = slots >= 0
    known[known] = index["prints"][slots[known]] == fingerprints(hi[known], lo[known])
    return np.where(known, index["counts"][np.where(known, slots, 0)] if len(index["counts"]) else 0, 0)


def line_index(docs: DataFrame) -> DataFrame:
    """One row per shard: shard, n, load (sum of counts), shards, and the arrays as binaries."""
    counts = cut(docs.select("text").mapInArrow(hashes_of, "hi long, lo long").groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("docs")))
    shards = max(1, -(-counts.count() // KEYS_PER_SHARD))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        index = build_shard(rows["hi"].to_numpy(), rows["lo"].to_numpy(), rows["docs"].to_numpy())
        packed = {k: [v.tobytes()] for k, v in index.items()}
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "shards": [shards], "n": [len(rows)], "load": [int(rows["docs"].sum())], **packed})

    dealt = counts.withColumn("shard", F.pmod("hi", F.lit(shards)))
    return cut(dealt.groupBy("shard").applyInPandas(build, "shard long, shards long, n long, load long, sizes binary, bits binary, prints binary, counts binary"))


def frequent_lines(docs: DataFrame, index: DataFrame, at_least: int) -> DataFrame:
    """doc_id, text_hash, positions: the lines of each document whose keys are in `at_least` documents or more by the index."""
    first = index.select("shards").first()
    shards = first["shards"] if first else 1
    probes = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(probes_of, "doc_id long, text_hash long, at int, hi long, lo long, number long")
    slices = index.select("shard", F.ceil(F.col("load") / F.lit(float(PROBES_PER_SLICE))).cast("long").alias("slices"))
    probes = probes.withColumn("shard", F.pmod("hi", F.lit(shards))).join(slices, "shard").withColumn("slice", F.pmod(F.col("number"), F.col("slices"))).drop("number")
    copies = index.join(slices, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("shard", F.col("slice").cast("long"), "sizes", "bits", "prints", "counts")

    def probe(rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if len(rows) and len(shard):
            kinds = {"sizes": np.int64, "bits": np.uint8, "prints": np.uint32, "counts": np.int64}
            index = {k: np.frombuffer(shard[k].iloc[0], dtype=kind) for k, kind in kinds.items()}
            rows = rows[probe_shard(index, rows["hi"].to_numpy(), rows["lo"].to_numpy()) >= at_least]
        else:
            rows = rows[:0]
        return rows[["doc_id", "text_hash", "at"]]

    found = probes.groupBy("shard", "slice").cogroup(copies.groupBy("shard", "slice")).applyInPandas(probe, "doc_id long, text_hash long, at int")
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("positions"))


def drop_lines(text: pd.Series, positions: pd.Series) -> pd.DataFrame:
    out = []
    for t, gone in zip(text, positions, strict=True):
        lines = (t or "").split("\n")
        dropped = set() if gone is None else set(gone)
        out.append(("\n".join([x for i, x in enumerate(lines) if i not in dropped]) if dropped else t or "", len(lines), len(dropped)))
    return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, at_least: int = 10) -> DataFrame:
    """All columns of docs, and a struct `lines` with kept (text without the lines to drop), n_lines and n_dropped; a column of docs by that name gives way."""
    docs = docs.drop("lines")
    gone = frequent_lines(docs, line_index(docs), at_least)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (inner[f"c{docs.columns.index(c)}"] for c in ("doc_id", "text"))
    both = inner.join(gone, doc_id.eqNullSafe(gone["doc_id"]) & (F.xxhash64(text) == gone["text_hash"]), "left")
    lines = F.pandas_udf(drop_lines, "kept string, n_lines long, n_dropped long")(text, F.col("positions"))
    return both.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], lines.alias("lines"))


def op2_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH numbered AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT row_no, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM numbered),
keyed AS (SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row_no) >= 10),
marked AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id
"""
