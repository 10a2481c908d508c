"""What several operators of this folder share: word rules, lineage cuts and the fold hash."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts name it (fixed values): space and \x09-\x0D, and nothing else.
SPACE = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, where all are one machine, may do without."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


#: Spark then removes a query's shuffle files when the query ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files, so that lost executors don't bring back its whole lineage. What was shuffled for it goes then: nothing reads it again."""
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    was = conf.get(RELEASE, "false")
    conf.set(RELEASE, "true")
    try:
        return df.select("*").checkpoint()  # a query of its own, which takes the setting as it is now
    finally:
        conf.set(RELEASE, was)


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id's text modulo `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a whole text with A-Z lower-cased, as UTF-8. bytes.split() splits at exactly the white space named above."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Numbers for words as they come up, kept between texts: words[w] is w's number, order[i] the word with number i."""

    def __init__(self) -> None:
        super().__init__()
        self.order: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.order)
        self.order.append(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Batches cut between rows so that a piece has about `most` bytes of text in column number `text`; a longer text is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of all runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, none: float = 0) -> np.ndarray:
    """Values of the asked keys in sorted keys; `none` for those not among them."""
    if not len(keys):
        return np.full(len(asked), none, dtype=values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], none)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
