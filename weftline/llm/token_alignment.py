"""Alignment of two tokenizers' tokens over whole texts.

Texts are cut at spaces where no token of either side can span (see CHUNK), a chunk is encoded once while a worker remembers it, and
the ids are written as blocks of documents (a table in the shared folder). Token lengths in bytes come
from tables by id; their running sums are the ends of a block's tokens. Two sorted lists of ends are merged: where both end, a
group closes, and each stretch between two ends of either lies in just one token of each side, so it is a link. Each block gives its
pairs of ids with their numbers of links; Spark groups them to corpus-wide counts, takes each id's highest on either side, and
joins both back to the blocks' pairs. A block meets its own pairs by a cogroup, aligns again, and adds up its documents' links.

No task holds more than a block: BLOCK_LETTERS letters of text, or one longer document. A pair that is frequent everywhere has one row a block, whatever
its links. Highest counts by id are broadcast: there are at most as many as the vocabulary has ids.

Defined results: a text that is null or empty, or whose tokens of either side don't spell it, has no tokens, zeros and an empty digest;
a null doc_id and repeated rows keep a row each, and repeats count again; an empty table gives an empty result; other columns are ignored.
Tokenizer files are read by the driver, from paths that are parameters, and reach executors as broadcasts of their bytes (some MB).
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Words, cut, expand, shared_folder, table

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_LETTERS, CALL_LETTERS = 1 << 20, 1 << 17
#: A space between a character that is none and one that is surely no white space. Byte-level tokens hold a space only in front of others or among
#: white space, and pieces hold one only in front (checked when a model is read), so both sides begin a token there.
CHUNK = re.compile(r"(?<=[^ ]) (?=[!-~\w])")
#: A chunk that can stand behind another one.
PLAIN = re.compile(r"[!-~\w](.*[^ ])?\Z", re.DOTALL)
#: Chunks and letters of them that a worker remembers.
MOST_CHUNKS, MOST_LETTERS = 200_000, 1 << 22
SHIFT = 32
BLOCKS = "block long, documents binary, nulls binary, a_lengths binary, b_lengths binary, a binary, b binary"
LINKS = "doc_id long, a_place long, b_place long, a int, b int, start long, end long"
GROUPS = "doc_id long, number long, a array<int>, b array<int>, start long, end long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Ids and bytes of a byte-level tokenizer's file; it gets the text with a space before it."""

    def __init__(self, content: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for entry, number in self.tokenizer.get_vocab().items():
            self.bytes[number] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch([f" {text}" for text in texts], add_special_tokens=False)]


class Pieces:
    """Ids and bytes of a piece model; it puts a space before the text itself."""

    def __init__(self, content: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=content)
        piece = self.model.id_to_piece
        if spanning := [p for p in map(piece, range(self.model.get_piece_size())) if "▁" in p.lstrip("▁")]:
            raise ValueError(f"pieces span spaces: {spanning[:3]}")
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def id_type(sizes) -> type:
    """Of packed ids of a vocabulary."""
    return np.uint16 if len(sizes) <= 1 << 16 else np.int32


def squeezed(ids: np.ndarray) -> bytes:
    """Packed ids of a block, compressed: they are written once and shuffled once."""
    return zstandard.compress(ids.tobytes(), 3)


class Side:
    """Ids of the remembered chunks on one side, one chunk after the other, and whether they spell their chunks."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.type = tokenizer, id_type(tokenizer.bytes)
        self.sizes = np.array([len(x) for x in tokenizer.bytes], np.int64)
        self.ids, self.lengths, self.right = np.empty(0, self.type), np.empty(0, np.int64), np.empty(0, bool)

    def spells(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.tokenizer.bytes.__getitem__, ids)) == f" {text}".encode()

    def add(self, chunks: list[str], together: bool) -> None:
        """together: the chunks may be encoded as one text, for a token begins at each."""
        if together and self.spells(ids := self.tokenizer.encode([text := " ".join(chunks)])[0], text):
            stops = np.cumsum([len(c.encode()) + 1 for c in chunks])
            lengths = np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), stops) + 1, prepend=0)
            right = np.ones(len(chunks), bool)
        else:
            found = self.tokenizer.encode(chunks)
            right = [self.spells(x, c) for x, c in zip(found, chunks, strict=True)]
            ids, lengths = [i for x in found for i in x], [len(x) for x in found]
        self.ids = np.concatenate([self.ids, np.array(ids, self.type)])
        self.lengths, self.right = np.concatenate([self.lengths, lengths]), np.concatenate([self.right, right])

    def of(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, and how many each has."""
        lengths = self.lengths[chunks]
        return self.ids[expand((np.cumsum(self.lengths) - self.lengths)[chunks], lengths)], lengths


class Encoder:
    """Both sides' ids of texts, by chunk."""

    def __init__(self, *tokenizers) -> None:
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.words, self.letters, self.sides = Words(), 0, [Side(t) for t in self.tokenizers]

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side ids of all texts, and how many each text has."""
        if len(self.words) > MOST_CHUNKS or self.letters > MOST_LETTERS:
            self.forget()
        split = [CHUNK.split(t) if t else [] for t in texts]
        counts, old = np.array([len(x) for x in split], np.int64), len(self.words)
        chunks = self.words.numbers([c for x in split for c in x])
        if new := self.words.order[old:]:
            self.letters += sum(map(len, new))
            for together, some in groupby(new, key=lambda c: bool(PLAIN.match(c))):
                some = list(some)
                for start, stop in calls(some, CALL_LETTERS):
                    for side in self.sides:
                        side.add(some[start:stop], together)
        texts_of = np.repeat(np.arange(len(texts)), counts)
        wrong = np.bincount(texts_of, ~np.logical_and(*[side.right[chunks] for side in self.sides]), len(texts)) > 0
        kept, out = ~wrong[texts_of], []
        for side in self.sides:
            ids, lengths = side.of(chunks[kept])
            out.append((ids, np.bincount(texts_of[kept], lengths, len(texts)).astype(np.int64)))
        return out


_READ: dict[bytes, Encoder] = {}


def encoder(byte_level: bytes, pieces: bytes) -> Encoder:
    """A worker process keeps the encoder it used last, with the chunks that it remembers."""
    key = hashlib.sha256(byte_level + pieces).digest()
    if key not in _READ:
        _READ.clear()
        _READ[key] = Encoder(ByteLevel(byte_level), Pieces(pieces))
    return _READ[key]


def calls(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` letters."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > most:
            yield start, k
            start, size = k, 0
        size += len(text or "") + 16
    if start < len(texts):
        yield start, len(texts)


def encoded(a_file, b_file, block_letters: int = BLOCK_LETTERS):
    """Blocks of documents with the ids of both sides. Columns: doc_id as text (it may be null), text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(a_file.value, b_file.value)
        number = TaskContext.get().partitionId() << 32
        for frame in frames:
            documents, texts = frame["doc_id"].tolist(), frame["text"].tolist()
            for start, stop in calls(texts, block_letters):
                (a, n_a), (b, n_b) = encode(texts[start:stop])
                ids = np.array([int(d or 0) for d in documents[start:stop]], np.int64)
                nulls = np.array([d is None for d in documents[start:stop]], np.uint8)
                yield pd.DataFrame({"block": [number], **{k: [x.tobytes()] for k, x in (("documents", ids), ("nulls", nulls), ("a_lengths", n_a), ("b_lengths", n_b))}, "a": [squeezed(a)], "b": [squeezed(b)]})
                number += 1

    return run


class Aligned:
    """A block's tokens, links and groups. Tokens of all its documents stand one after the other; documents end where both sides end."""

    def __init__(self, row, a_sizes: np.ndarray, b_sizes: np.ndarray) -> None:
        self.documents, self.nulls = np.frombuffer(row.documents, np.int64), np.frombuffer(row.nulls, np.uint8).astype(bool)
        self.n_a, self.n_b = np.frombuffer(row.a_lengths, np.int64), np.frombuffer(row.b_lengths, np.int64)
        self.a, self.b = (np.frombuffer(zstandard.decompress(x), id_type(sizes)).astype(np.int32) for x, sizes in ((row.a, a_sizes), (row.b, b_sizes)))
        a_ends, b_ends = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        #: A bit for each byte at which a side's token ends.
        n_bytes = int(a_ends[-1]) if len(a_ends) else 0
        a_bit, b_bit = np.zeros(n_bytes + 1, bool), np.zeros(n_bytes + 1, bool)
        a_bit[a_ends], b_bit[b_ends] = True, True
        self.ends = np.flatnonzero(a_bit | b_bit)
        a_bit, b_bit = a_bit[self.ends], b_bit[self.ends]
        self.closes = a_bit & b_bit
        #: Tokens of either side that end before a link's end, so the number of the token in which the link lies.
        self.link_a, self.link_b = np.cumsum(a_bit) - a_bit, np.cumsum(b_bit) - b_bit
        self.pairs = self.a[self.link_a].astype(np.int64) << SHIFT | self.b[self.link_b]
        #: Links up to and with each document's last one.
        stops = np.searchsorted(self.link_a, np.cumsum(self.n_a)) if len(self.ends) else np.zeros(len(self.n_a), np.int64)
        self.bounds = np.concatenate([[0], stops])

    def by_document(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return np.diff(sums[self.bounds])

    def digests(self) -> list[str]:
        """Of each document's groups as text, a side's ids joined by commas, the sides by a bar, groups by semicolons."""
        at = np.flatnonzero(self.closes)
        a_stops, b_stops = self.link_a[at] + 1, self.link_b[at] + 1  # of each group
        a_group, b_group = (np.repeat(np.arange(len(x)), np.diff(x, prepend=0)) for x in (a_stops, b_stops))
        # A's ids of a group stand before B's: each token's place, and the mark after it.
        a_place = np.arange(len(self.a)) + np.concatenate([[0], b_stops])[a_group]
        b_place = np.arange(len(self.b)) + a_stops[b_group]
        ids, marks = np.empty(len(self.a) + len(self.b), np.int32), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[a_place], ids[b_place] = self.a, self.b
        marks[a_place[a_stops - 1]], marks[b_place[b_stops - 1]] = ord("|"), ord(";")
        ends = np.cumsum(self.n_a + self.n_b)
        marks[ends[(self.n_a > 0)] - 1] = 0
        # Each token's digits and its mark, from a table by id; zeros between them go.
        rows = self.decimals(int(ids.max(initial=0)) + 1)[ids]
        rows[:, -1] = marks
        text, stops = rows[rows > 0].tobytes(), np.concatenate([[0], np.cumsum(np.count_nonzero(rows, axis=1))])
        starts, found = ends - self.n_a - self.n_b, []
        for start, stop in zip(stops[starts].tolist(), stops[ends].tolist(), strict=True):
            found.append(hashlib.sha256(text[start:stop]).hexdigest() if stop > start else "")
        return found

    @staticmethod
    def decimals(n: int) -> np.ndarray:
        """A row for each number below n: its decimal digits as letters, zeros before them, and room for a mark."""
        width, numbers = len(str(n - 1)), np.arange(n)
        rows = np.zeros((n, width + 1), np.uint8)
        for k in range(width):
            power = 10 ** (width - 1 - k)
            rows[:, k] = np.where((numbers >= power) | (power == 1), numbers // power % 10 + ord("0"), 0)
        return rows


def listed(a_sizes: np.ndarray, b_sizes: np.ndarray, what: str):
    """Rows of LINKS or GROUPS, a document's in order; places are of bytes of the text with its space, and of tokens."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                block = Aligned(row, a_sizes, b_sizes)
                a_first, b_first = np.cumsum(block.n_a) - block.n_a, np.cumsum(block.n_b) - block.n_b
                begins = np.concatenate([[0], block.ends[:-1]]) if len(block.ends) else block.ends
                for k in np.flatnonzero(block.n_a):
                    place = slice(block.bounds[k], block.bounds[k + 1])
                    x, y, base = block.link_a[place] - a_first[k], block.link_b[place] - b_first[k], begins[place.start]
                    document = pd.array([pd.NA if block.nulls[k] else block.documents[k]], dtype="Int64")
                    if what == "links":
                        found = {"a_place": x, "b_place": y, "a": block.a[block.link_a[place]], "b": block.b[block.link_b[place]], "start": begins[place] - base, "end": block.ends[place] - base}
                    else:
                        at = np.flatnonzero(block.closes[place])
                        sides = [np.split(ids[first : first + n], (t[at] + 1)[:-1]) for ids, first, n, t in ((block.a, a_first[k], block.n_a[k], x), (block.b, b_first[k], block.n_b[k], y))]
                        stops = block.ends[place][at] - base
                        found = {"number": np.arange(len(at)), "a": sides[0], "b": sides[1], "start": np.concatenate([[0], stops[:-1]]), "end": stops}
                    size = len(found["end"])
                    yield pd.DataFrame({"doc_id": document.repeat(size), **found})

    return run


def pairs_of(a_sizes: np.ndarray, b_sizes: np.ndarray):
    """block, pair (both ids in one number) and links of each pair of each block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                pairs, links = np.unique(Aligned(row, a_sizes, b_sizes).pairs, return_counts=True)
                yield pd.DataFrame({"block": row.block, "pair": pairs, "links": links})

    return run


def totals(a_sizes: np.ndarray, b_sizes: np.ndarray):
    """RESULT of a block's documents, from the block's row and its pairs with their counts."""

    def run(blocks: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        found = []
        order = np.argsort(pairs["pair"].to_numpy())
        keys, counts, best = (pairs[c].to_numpy()[order] for c in ("pair", "count", "best_of_b"))
        for row in blocks.itertuples():
            block = Aligned(row, a_sizes, b_sizes)
            at = np.searchsorted(keys, block.pairs)
            frame = {"n_a": block.n_a, "n_b": block.n_b, "n_groups": block.by_document(block.closes), "n_links": np.diff(block.bounds), "n_best": block.by_document(best[at]), "count_sum": block.by_document(counts[at])}
            found.append(pd.DataFrame({"doc_id": pd.array(block.documents, dtype="Int64"), **frame, "groups_sha256": block.digests()}))
            found[-1].loc[block.nulls, "doc_id"] = pd.NA
        return pd.concat(found)

    return run


class Alignment:
    """Encodes docs (doc_id, text) once; its tables then come from the written blocks."""

    def __init__(self, docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, block_letters: int = BLOCK_LETTERS) -> None:
        spark = docs.sparkSession
        contents = []
        for path in (byte_level, pieces):
            with open(path, "rb") as f:
                contents.append(f.read())
        files = [spark.sparkContext.broadcast(c) for c in contents]
        self.sizes = [np.array([len(x) for x in kind(c).bytes], np.int64) for kind, c in zip((ByteLevel, Pieces), contents, strict=True)]
        folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
        rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        rows.mapInPandas(encoded(*files, block_letters), BLOCKS).write.parquet(folder)
        self.blocks = spark.read.schema(BLOCKS).parquet(folder)
        self.block_pairs = cut(self.blocks.mapInPandas(pairs_of(*self.sizes), "block long, pair long, links long"))

    def links(self) -> DataFrame:
        """A row for each link."""
        return self.blocks.mapInPandas(listed(*self.sizes, "links"), LINKS)

    def groups(self) -> DataFrame:
        """A row for each group, with the ids of both sides."""
        return self.blocks.mapInPandas(listed(*self.sizes, "groups"), GROUPS)

    def pairs(self) -> DataFrame:
        """pair, a, b, count (its links in all documents), best_of_a, best_of_b (does no pair of that id have more)."""
        counts = self.block_pairs.groupBy("pair").agg(F.sum("links").alias("count"))
        counts = cut(counts.select("pair", F.shiftright("pair", SHIFT).alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b"), "count"))
        for side in ("a", "b"):
            highest = counts.groupBy(side).agg(F.max("count").alias("highest"))
            counts = counts.join(F.broadcast(highest), side).withColumn(f"best_of_{side}", F.col("count") == F.col("highest")).drop("highest")
        return counts

    def documents(self) -> DataFrame:
        """RESULT of every row of docs."""
        about = self.block_pairs.select("block", "pair").join(cut(self.pairs().select("pair", "count", "best_of_b")), "pair")
        return self.blocks.groupBy("block").cogroup(about.groupBy("block")).applyInPandas(totals(*self.sizes), RESULT)


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(table(spark, sf_dir, "documents")).documents()
