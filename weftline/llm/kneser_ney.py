"""Quality classifier: interpolated modified Kneser-Ney n-grams of trusted text, perplexity by packed shards in rounds.

The model is fitted on all documents whose label says good quality and not toxic, but for a quarter by hash that is held
out for the thresholds. Texts are laid out once as packed numbers of words. N-grams (pairs and triples) are then counted in
rounds by the word before the last: all that a pair's or a triple's probability needs but for single words' counts
lies in one round, so that only one round's n-grams are on disks. First rounds count what discounts and single words need
(continuation counts, counts of counts); second rounds count again, now with the discounts, give every n-gram its value, and
look the documents up at once. In a round, n-grams travel packed, first to the shard of their context (totals, back-off
weights), then to that of their suffix (continuation counts, lower order), so that no word's n-grams share one task.

Written in back-off form, the log probability of a text is a sum over its n-grams of one value each: a word has the log of
its unigram probability, plus the log of its back-off weight as the next word's context; a pair as a context has the log of
its back-off weight; a pair or triple has what it changes of that. So documents need one sum over tables of values (see
probes.py): frequent n-grams go along with the tasks, words that a bit table rules out need no look-up, all others are
looked up in their shard. The order is 1, 2 or 3.

A document is kept if its perplexity is at most its language's threshold: a quantile of the perplexities of
trusted documents that the model hasn't seen. Languages with fewer than `fewest` of these, and rows without a language, share the threshold of all.

Defined results: null texts and texts without words have n_words 0, a null perplexity, and aren't kept; repeated rows are scored
one by one; if no trusted row exists, all words are equally unknown and every document with words is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import probes
from weftline.llm.common import Words, cut, look_up, lower_words, mix64, pieces, table, text_bytes, word_hashes
from weftline.llm.jaccard_join import few

ORDER = 3
QUANTILE = 0.995
FEWEST = 20
#: Rounds in which n-grams are counted and looked up, by the word before the last, so that only one round's are on disks.
ROUNDS = 16
#: Text for which a round more is made, up to ROUNDS.
ROUND_BYTES = 1 << 23
HOT = 1 << 18
PER_SHARD = 1 << 16
SLICE_BYTES = 1 << 28
#: Text that is scored at a time, for a bounded memory of the tasks.
SCORE_BYTES = 1 << 22
BITS = 1 << 26
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Not words, since words have no white space.
START, END = b" start", b" end"
#: Stands for the hashes of all words that the model doesn't have.
OTHER = np.uint64(0)


def bit_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(24)) % np.uint64(bits)


def word_bits(bits: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(bits, np.uint8)
        table[bit_of(words_of(frame)["word"], bits)] = 1
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "bits": [np.packbits(table).tobytes()]})

    return run


class Filter:
    """A bit table of the model's words, which goes along with the tasks: a word without its bit is in no n-gram of the model."""

    def __init__(self, shards: int, rows: list, bits: int):
        self.shards, self.own, self.bits = shards, bits, np.zeros(bits * shards // 8, np.uint8)
        for r in rows:
            self.bits[r["shard"] * bits // 8 : (r["shard"] + 1) * bits // 8] = np.frombuffer(r["bits"], np.uint8)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        at = (keys % np.uint64(self.shards)) * np.uint64(self.own) + bit_of(keys, self.own)
        return (self.bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


class Sequences:
    """Word numbers of texts, each with START and END, one text after the other. START has number 0."""

    def __init__(self) -> None:
        self.words, self.hashes, self.known = Words(), np.empty(0, np.uint64), np.empty(0, bool)

    def __call__(self, texts: list[list[bytes]], known: Filter | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct words, START first and then the most frequent, and each position's number among them. Words that aren't known share OTHER."""
        if len(self.words) > 1 << 18:
            self.words, self.hashes, self.known = Words(), self.hashes[:0], self.known[:0]
        flat = [START]
        for found in texts:
            flat += [START, *found, END]
        numbers = self.words.numbers(flat)
        self.hashes = np.concatenate([self.hashes, word_hashes(self.words.order[len(self.hashes) :])])
        if known:
            self.known = np.concatenate([self.known, known.may_have(self.hashes[len(self.known) :])])
            numbers = np.where(self.known[numbers], numbers, len(self.hashes))
        times = np.bincount(numbers, minlength=len(self.hashes) + 1)
        times[numbers[0]] = len(numbers) + 1
        own = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
        codes = np.empty(len(times), np.uint32)
        codes[own] = np.arange(len(own), dtype=np.uint32)
        return np.append(self.hashes, OTHER)[own], codes[numbers[1:]]


#: A piece of text: number of its first document, positions of each text (i32), hashes of its words (u64), number of each position's word (u32, by bytes, zstd).
PIECE = "base long, lengths binary, words binary, codes binary"
ROW = "number long, doc_id long, lang string, n_words long"


def laid_out(known=None):
    """doc_id, lang, text -> pieces, and a row for each document. `known` has the model's words; where they are still to be learned, texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences, base = Sequences(), probes.first_number()
        for piece in pieces(batches, 2, SCORE_BYTES):
            texts = [lower_words(t) for t in piece.column(2).to_pylist()]
            rows = piece
            if not known:
                rows = piece.filter(pa.array([bool(t) for t in texts]))
                texts = [t for t in texts if t]
            if not texts:
                continue
            lengths, (hashes, codes) = np.array([len(t) + 2 for t in texts], np.int32), sequences(texts, known and known.value)
            k = len(texts)
            own = [pa.array(np.arange(base, base + k)), rows.column(0), rows.column(1), pa.array(lengths.astype(np.int64) - 2)]
            columns = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in own]
            packed = [(base, pa.int64()), (lengths.tobytes(), pa.binary()), (hashes.tobytes(), pa.binary()), (pa.compress(codes.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True), pa.binary())]
            columns += [pa.concat_arrays([pa.nulls(k, t), pa.array([x], t)]) for x, t in packed]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "doc_id", "lang", "n_words", "base", "lengths", "words", "codes"])
            base += k

    return run


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, hashes of words and codes of a piece."""
    lengths = np.frombuffer(row["lengths"], np.int32)
    codes = np.frombuffer(pa.decompress(row["codes"], int(lengths.sum()) * 4, "zstd", asbytes=True), np.uint8)
    return lengths, np.frombuffer(row["words"], np.uint64), np.ascontiguousarray(codes.reshape(4, -1).T).view(np.uint32)[:, 0]


def joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(before) * FACTOR + word


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix64(joined(x, y) + np.uint64(2))


def triple(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return mix64(joined(joined(x, y), z) + np.uint64(3))


def of_turn(hashes: np.ndarray, codes: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Positions of words (START is none) after a word that the model has and that falls to this turn."""
    mine = (mix64(hashes) % np.uint64(rounds) == turn) & (hashes != OTHER)
    return np.flatnonzero(mine[codes[:-1]] & (codes[1:] != 0)) + 1


#: Of n-grams: gram is 0 for pairs that are counted themselves, since they start with START or are of the highest order.
COUNTED = np.dtype([("gram", "u8"), ("suffix", "u8"), ("first", "u8"), ("last", "u8"), ("c", "i8")])
VALUED = np.dtype([("gram", "u8"), ("context", "u8"), ("suffix", "u8"), ("c", "i8"), ("p", "f8"), ("total", "f8"), ("back", "f8")])
LOWER = np.dtype([("gram", "u8"), ("suffix", "u8"), ("c", "i8"), ("share", "f8"), ("over", "f8"), ("p", "f8"), ("total", "f8"), ("back", "f8")])
#: Of words: adjusted count; as a context the sum of its pairs' adjusted counts, and how many of these are 1, 2 and more.
WORDS = np.dtype([("word", "u8"), ("a", "i8"), ("total", "i8"), ("m1", "i8"), ("m2", "i8"), ("m3", "i8")])


def dealt(shards: int, by: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """shard, and each column's bytes of it."""
    order, at = probes.by_shard(shards, by)
    for k in range(shards):
        if len(own := order[at[k] : at[k + 1]]):
            yield (k, *[c[own].tobytes() for c in columns])


def read(packed, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in packed if x is not None] or [np.empty(0, kind)])


def occurring(order: int, turn: int, rounds: int, shards: int, valued: bool):
    """Pieces -> packed n-grams by shard: of the suffix, or (valued) of the context along with the words' values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, hashes, codes = opened(row)
                at = np.flatnonzero(codes) if order == 1 else of_turn(hashes, codes, turn, rounds)
                if not len(at):
                    continue
                y, z = hashes[codes[at - 1]], hashes[codes[at]]
                suffix = z if order == 1 else pair(y, z)
                deep = (codes[at - 1] != 0) if order == 3 else np.zeros(len(at), bool)
                x = hashes[codes[at - 2]]
                gram = np.where(deep, triple(x, y, z), np.uint64(0))
                _, first, c = np.unique(np.where(deep, gram, suffix), return_index=True, return_counts=True)
                out = np.empty(len(first), VALUED if valued else COUNTED)
                out["gram"], out["suffix"], out["c"] = gram[first], suffix[first], c
                if valued:
                    out["context"] = pair(x[first], y[first])
                    words = [np.frombuffer(pa.decompress(row[name], len(hashes) * 8, "zstd", asbytes=True), np.float64) for name in ("p", "total", "back")]
                    for name, values, code in zip(("p", "total", "back"), words, (codes[at], codes[at - 1], codes[at - 1]), strict=True):
                        out[name] = values[code[first]]
                else:
                    out["first"], out["last"] = y[first], z[first]
                by = np.where(out["gram"] != 0, out["context"], out["suffix"]) if valued else out["suffix"]
                got = list(dealt(shards, by, out))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in got], pa.int32()), pa.array([r[1] for r in got], pa.binary())], names=["shard", "rows"])

    return run


def merged_grams(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest n-grams, one row each; their counts; pairs that are counted themselves."""
    longest, own = rows[rows["gram"] != 0], rows[rows["gram"] == 0]
    _, first, back = np.unique(longest["gram"], return_index=True, return_inverse=True)
    return longest[first], np.bincount(back, longest["c"], len(first)).astype(np.int64), own


def merged_pairs(longest: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each pair stands first in longest + own, adjusted counts (n-grams that end with the pair, or its own count), and the pair of each row."""
    suffix = np.concatenate([longest["suffix"], own["suffix"]])
    _, first, back = np.unique(suffix, return_index=True, return_inverse=True)
    return first, np.bincount(back, np.concatenate([np.ones(len(longest)), own["c"]]), len(first)).astype(np.int64), back


def kinds(a: np.ndarray) -> list[int]:
    return [*[int((a == k).sum()) for k in (1, 2, 3, 4)], int(a.sum()), len(a)]


def summed(rows: np.ndarray) -> np.ndarray:
    word, back = np.unique(rows["word"], return_inverse=True)
    out = np.empty(len(word), WORDS)
    out["word"] = word
    for name in WORDS.names[1:]:
        out[name] = np.bincount(back, rows[name], len(word))
    return out


COUNTS = "shard int, rows binary, size long, stats binary"


def word_rows(shards: int, words: np.ndarray, stats: list[int]) -> pd.DataFrame:
    found = list(dealt(shards, words["word"], words))
    none = np.zeros(len(stats), np.int64).tobytes()
    return pd.DataFrame([(k, pa.compress(x, "zstd", asbytes=True), len(x), none if i else np.array(stats, np.int64).tobytes()) for i, (k, x) in enumerate(found)], columns=["shard", "rows", "size", "stats"])


def counts_of(order: int, shards: int):
    """Packed n-grams of a shard -> words by shard, and counts of counts of the orders 2 and 3."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        longest, c, own = merged_grams(read(frame["rows"], COUNTED))
        at, a, _ = merged_pairs(longest, own)
        rows = np.concatenate([longest, own])[at]
        out = np.zeros(len(rows) * (1 if order == 1 else 2), WORDS)
        out["word"][: len(rows)], out["a"][: len(rows)] = rows["last"], a if order == 1 else 1
        if order == 1:
            return word_rows(shards, summed(out), [0] * 12)
        as_context = out[len(rows) :]
        as_context["word"], as_context["total"], as_context["m1"], as_context["m2"], as_context["m3"] = rows["first"], a, a == 1, a == 2, a > 2
        return word_rows(shards, summed(out), [*kinds(a), *kinds(c)])

    return run


def words_of(frame: pd.DataFrame) -> np.ndarray:
    return read([pa.decompress(x, int(n), "zstd", asbytes=True) for x, n in zip(frame["rows"], frame["size"], strict=True)], WORDS)


def merged_words(frame: pd.DataFrame) -> pd.DataFrame:
    packed = summed(words_of(frame)).tobytes()
    stats = np.sum([np.frombuffer(x, np.int64) for x in frame["stats"]], axis=0)
    return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "rows": [pa.compress(packed, "zstd", asbytes=True)], "size": [len(packed)], "stats": [stats.tobytes()]})


def word_kinds(frame: pd.DataFrame) -> pd.DataFrame:
    a = words_of(frame)["a"]
    return pd.DataFrame({"stats": [np.array(kinds(a[a > 0]), np.int64).tobytes()]})


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from counts of counts; a fixed share where the counts don't give one."""
    y = n1 / (n1 + 2 * n2) if n1 else 0
    raw = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.1), k - 0.1) for k, d in zip((1, 2, 3), raw, strict=True))


def cost(d: tuple[float, float, float], a: np.ndarray) -> np.ndarray:
    return np.array(d)[np.clip(a, 1, 3) - 1]


class Weights:
    """Discounts of the three orders, and what follows for single words."""

    def __init__(self, one: np.ndarray, two: np.ndarray, three: np.ndarray):
        self.d = [discounts(*map(int, x[:4])) for x in (one, two, three)]
        self.total = int(one[4])
        spare = self.d[0][0] * one[0] + self.d[0][1] * one[1] + self.d[0][2] * (one[5] - one[0] - one[1])
        self.unknown = float(spare / one[4] / (one[5] + 1))

    def words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability (0 for START) and back-off weight (1 for what is no context) of each word."""
        p = np.where(words["a"] > 0, (words["a"] - cost(self.d[0], words["a"])) / self.total + self.unknown, 0)
        spare = sum(words[name] * d for name, d in zip(("m1", "m2", "m3"), self.d[1], strict=True))
        return p, np.where(words["total"] > 0, spare / np.maximum(words["total"], 1), 1)


#: A shard of values by key, and its most frequent keys with theirs.
INDEX = "shard int, keys binary, values binary, hot_keys binary, hot_values binary"


def index_row(shard: int, keys: np.ndarray, values: np.ndarray, often: np.ndarray, hot: int) -> pd.DataFrame:
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.sort(np.argsort(-often[order], kind="stable")[:hot])
    return pd.DataFrame({"shard": [shard], "keys": [keys.tobytes()], "values": [values.tobytes()], "hot_keys": [keys[first].tobytes()], "hot_values": [values[first].tobytes()]})


def word_index(weights: Weights, hot: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        words = words_of(frame)
        p, back = weights.words(words)
        values = np.log(np.where(p > 0, p / weights.unknown, 1)) + np.log(back)
        return index_row(int(frame["shard"].iloc[0]), words["word"], values, words["a"] + words["total"], hot)

    return run


def word_questions(shards: int):
    """Pieces -> what each asks of a shard of words: places in the piece's list of words, and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["base", "words"]).to_pylist():
                hashes = np.frombuffer(row["words"], np.uint64)
                got = list(dealt(shards, hashes, np.arange(len(hashes), dtype=np.int32), hashes))
                columns = [pa.array([r[0] for r in got], pa.int32()), pa.array([row["base"]] * len(got), pa.int64()), *[pa.array([r[i] for r in got], pa.binary()) for i in (1, 2)]]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "base", "places", "keys"])

    return run


def word_answers(weights: Weights):
    def run(asked: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        words, out = words_of(frame), []
        p, back = weights.words(words)
        for base, places, keys in zip(asked["base"], asked["places"], asked["keys"], strict=True):
            at = np.searchsorted(words["word"], np.frombuffer(keys, np.uint64))  # every asked word is there
            out.append((base, places, p[at].tobytes(), words["total"][at].astype(np.float64).tobytes(), back[at].tobytes()))
        return pd.DataFrame(out, columns=["base", "places", "p", "total", "back"]).astype({"base": "int64"})

    return run


def with_words(piece: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    order = np.argsort(read(answers["places"], np.dtype("i4")))
    return piece.assign(**{name: [pa.compress(read(answers[name], np.dtype("f8"))[order].tobytes(), "zstd", asbytes=True)] for name in ("p", "total", "back")})


def by_context(weights: Weights, shards: int):
    """Packed n-grams of a shard of contexts -> the same with their context's shares, by shard of the suffix; back-off weights by shard of their own."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        longest, c, own = merged_grams(read(frame["rows"], VALUED))
        context, back = np.unique(longest["context"], return_inverse=True)
        less = cost(weights.d[2], c)
        total, spare = np.bincount(back, c, len(context)), np.bincount(back, less, len(context))
        out = np.zeros(len(longest) + len(own), LOWER)
        for name in ("gram", "suffix", "c", "p", "total", "back"):
            out[name] = np.concatenate([longest[name], own[name]])
        out["share"][: len(longest)] = (c - less) / total[back]
        out["over"][: len(longest)] = (spare / total)[back]
        rows = [(k, x, None, None, None) for k, x in dealt(shards, out["suffix"], out)]
        rows += [(k, None, *x) for k, *x in dealt(shards, ~context, ~context, np.log(spare / total), total)]
        return pd.DataFrame(rows, columns=["shard", "rows", "keys", "values", "often"])

    return run


def by_suffix(weights: Weights, hot: int):
    """What by_context gives for one shard -> its values: of pairs, of longest n-grams and (key inverted) of contexts."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = read(frame["rows"], LOWER)
        longest, own = rows[rows["gram"] != 0], rows[rows["gram"] == 0]
        at, a, pair_of = merged_pairs(longest, own)
        pairs = np.concatenate([longest, own])[at]
        p = (a - cost(weights.d[1], a)) / pairs["total"] + pairs["back"] * pairs["p"]
        lower = p[pair_of[: len(longest)]]
        values = np.log(longest["share"] + longest["over"] * lower) - np.log(longest["over"]) - np.log(lower)
        keys = np.concatenate([pairs["suffix"], longest["gram"], read(frame["keys"], np.dtype("u8"))])
        values = np.concatenate([np.log(p) - np.log(pairs["back"]) - np.log(pairs["p"]), values, read(frame["values"], np.dtype("f8"))])
        often = np.concatenate([a, longest["c"], read(frame["often"], np.dtype("f8"))])
        return index_row(int(frame["shard"].iloc[0]), keys, values, often, hot)

    return run


def scored(shared, order: int, turn: int | None, rounds: int, shards: int, slices: int):
    """Pieces -> probe rows, and with null keys a row of the sums of the values known here; of single words if turn is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_values = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                lengths, hashes, codes = opened(row)
                owners = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
                if turn is None:
                    at = np.flatnonzero((hashes != OTHER)[codes])
                    keys = by = hashes[codes[at]]
                else:
                    at = of_turn(hashes, codes, turn, rounds)
                    y, z = hashes[codes[at - 1]], hashes[codes[at]]
                    pairs, x = pair(y, z), hashes[codes[at - 2]]
                    two = np.flatnonzero(z != OTHER)
                    before = np.flatnonzero((codes[at - 1] != 0) & (x != OTHER)) if order == 3 else two[:0]
                    three = before[z[before] != OTHER]
                    context = ~pair(x[before], y[before])
                    keys = np.concatenate([pairs[two], triple(x[three], y[three], z[three]), context])
                    by = np.concatenate([pairs[two], pairs[three], context])
                    at = at[np.concatenate([two, three, before])]
                owners = owners[at]
                got = look_up(hot_keys, hot_values, keys, np.nan)
                here = ~np.isnan(got)
                totals = np.bincount(owners[here], got[here], len(lengths))
                out = probes.probe_rows(shards, slices, row["base"], keys[~here], owners[~here], by=by[~here])
                out.append((int(row["base"] >> 40) % shards, 0, row["base"], None, totals.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "slice", "base", "keys", "rows"])

    return run


def answered(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """What a shard answers, and the sums that came along."""
    known = asked["keys"].isna()
    here = asked[known].rename(columns={"rows": "totals"}).assign(rows=None)
    return pd.concat([here[["base", "rows", "totals"]], probes.answered(None)(asked[~known], index)[["base", "rows", "totals"]]], ignore_index=True)


def added(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of a piece's documents, from those at hand and those of the shards."""
    totals = read(frame["totals"][frame["rows"].isna()], np.dtype("f8")).copy()
    for rows, more in zip(frame["rows"], frame["totals"], strict=True):
        if rows is not None:
            totals[np.frombuffer(rows, np.int32)] += np.frombuffer(more, np.float64)
    return pd.DataFrame({"base": [int(frame["base"].iloc[0])], "totals": [totals.tobytes()]})


def sums(texts: DataFrame, index: DataFrame, order: int, turn: int | None, rounds: int, shards: int, slices: int) -> DataFrame:
    """base, totals (packed f64, one for each document of the piece): sums of the values in the index."""
    hot = index.select("hot_keys", "hot_values").collect()
    keys, values = (read([r[name] for r in hot], np.dtype(kind)) for name, kind in (("hot_keys", "u8"), ("hot_values", "f8")))
    at = np.argsort(keys)
    shared = texts.sparkSession.sparkContext.broadcast((keys[at], values[at]))
    asked = texts.mapInArrow(scored(shared, order, turn, rounds, shards, slices), probes.PROBE)
    found = cut(probes.grouped(asked, index.select("shard", "keys", "values"), slices).applyInPandas(answered, "base long, rows binary, totals binary").groupBy("base").applyInPandas(added, "base long, totals binary"))
    shared.destroy()
    return found


def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """base, totals -> number, total."""
    for batch in batches:
        for row in batch.to_pylist():
            totals = np.frombuffer(row["totals"], np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row["base"], row["base"] + len(totals))), pa.array(totals)], names=["number", "total"])


def drop_unused(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the files of cuts that nothing refers to any more (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, n_words, perplexity of every row of docs under a model of the texts of `trusted`."""
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("lang", "string"))]
    learned = cut(trusted.select(*none, "text").mapInArrow(laid_out(), f"{ROW}, {PIECE}"))
    positions = learned.agg(F.sum("n_words")).first()[0] or 0
    learned = learned.filter("base is not null").select("base", "lengths", "words", "codes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    if not positions:
        rows = docs.mapInArrow(laid_out(docs.sparkSession.sparkContext.broadcast(Filter(1, [], 8))), f"{ROW}, {PIECE}").filter("number is not null")
        return rows.select("doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, F.lit(1.0)).alias("perplexity"))
    size = text_bytes(docs)
    rounds = max(1, min(ROUNDS, size // ROUND_BYTES)) if order > 1 else 1
    shards = 1 << max(0, math.ceil(math.log2(positions / rounds / PER_SHARD)))
    slices = max(1, -(-size // (SLICE_BYTES * shards)))
    words, turns = None, -(-rounds // 4)  # only the trusted texts are on disks yet
    for turn in range(turns):
        counts = learned.mapInArrow(occurring(order, turn, turns, shards, False), "shard int, rows binary")
        counts = counts.groupBy("shard").applyInPandas(counts_of(order, shards), COUNTS)
        words = cut((counts if words is None else words.unionByName(counts)).groupBy("shard").applyInPandas(merged_words, COUNTS))
        del counts
        drop_unused(docs.sparkSession)
    stats = np.sum([np.frombuffer(r[0], np.int64) for r in words.select("stats").collect()], axis=0)
    one = np.sum([np.frombuffer(r[0], np.int64) for r in words.groupBy("shard").applyInPandas(word_kinds, "stats binary").collect()], axis=0)
    weights = Weights(one, stats[:6], stats[6:])
    own = max(8, BITS // shards)
    known = docs.sparkSession.sparkContext.broadcast(Filter(shards, words.groupBy("shard").applyInPandas(word_bits(own), "shard int, bits binary").collect(), own))
    laid = cut(docs.mapInArrow(laid_out(known), f"{ROW}, {PIECE}"))
    known.destroy()
    rows, texts = laid.filter("number is not null").select("number", "doc_id", "lang", "n_words"), laid.filter("base is not null").select("base", "lengths", "words", "codes")
    index = cut(words.groupBy("shard").applyInPandas(word_index(weights, HOT // shards), INDEX))
    found = sums(texts, index, order, None, rounds, shards, slices)
    if order > 1:
        answers = learned.mapInArrow(word_questions(shards), "shard int, base long, places binary, keys binary").groupBy("shard").cogroup(words.groupBy("shard"))
        answers = answers.applyInPandas(word_answers(weights), "base long, places binary, p binary, total binary, back binary")
        learned = cut(learned.groupBy("base").cogroup(answers.groupBy("base")).applyInPandas(with_words, f"{PIECE}, p binary, total binary, back binary"))
        del answers, index
        drop_unused(docs.sparkSession)
        for turn in range(rounds):
            grams = learned.mapInArrow(occurring(order, turn, rounds, shards, True), "shard int, rows binary")
            grams = grams.groupBy("shard").applyInPandas(by_context(weights, shards), "shard int, rows binary, keys binary, values binary, often binary")
            index = cut(grams.groupBy("shard").applyInPandas(by_suffix(weights, HOT // shards // rounds), INDEX))
            found = found.unionByName(sums(texts, index, order, turn, rounds, shards, slices))
            del grams, index
            drop_unused(docs.sparkSession)
    totals = found.groupBy("base").applyInPandas(whole_sums, "base long, totals binary").mapInArrow(apart, "number long, total double")
    log_p = F.col("total") + F.lit(math.log(weights.unknown)) * (F.col("n_words") + 1)
    return rows.join(totals, "number").select("doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, F.exp(-log_p / (F.col("n_words") + 1))).alias("perplexity"))


def whole_sums(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"base": [int(frame["base"].iloc[0])], "totals": [np.sum([np.frombuffer(x, np.float64) for x in frame["totals"]], axis=0).tobytes()]})


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, keep."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).filter("quality = 1 and toxic = 0")
    good = cut(good.select("doc_id", F.xxhash64(F.lit(5), "doc_id").alias("key")))
    trusted = docs.join(few(good.filter(F.pmod("key", F.lit(4)) != 0).select("doc_id")), "doc_id", "left_semi").select("text")
    rows = cut(perplexities(docs, trusted, order))
    unseen = rows.filter("perplexity is not null").join(good.filter(F.pmod("key", F.lit(4)) == 0).select("doc_id"), "doc_id", "left_semi")
    bound = lambda name: F.percentile_approx("perplexity", quantile, 10000).alias(name)
    by_language = unseen.filter("lang is not null").groupBy("lang").agg(bound("own"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FEWEST).select("lang", "own")
    whole = unseen.agg(bound("whole"))
    limit = F.coalesce("own", "whole", F.lit(float("inf")))
    # A row per language, counted: documents stay where they are, whatever share of them one language has.
    found = rows.join(few(cut(by_language)), "lang", "left").join(F.broadcast(whole))
    return found.select("doc_id", "lang", "n_words", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("keep"))


def op10_classify_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
