"""Language-model scoring: causal self-attention over subword ids, trained in numpy, with overlapping context windows.

Words (A-Z lower-cased) are cut into subword ids by a public tokenizer's vocabulary, whose path is a parameter; every
text ends with END. The probability of a subword is that of its class, from self-attention over the subwords before
it, times its share in the class. Shares, word counts, the choice of classes (by counts and neighbours) and the attention's
weights all come from all training documents. The weights are fitted in ROUNDS: each task goes through its part of the
training text from the round's common weights, and Spark averages what the tasks come to, by the text each has seen.
Every block of text is gone through once; where that is less than STEPS * BLOCKS blocks, as often as it takes.

A text is laid out in windows of 2 * STRIDE positions that overlap by half: each position is scored once, in the window where it
stands in the second half, with STRIDE to 2 * STRIDE - 1 positions before it. Windows of many texts form one
batch for masked attention. Attention has no absolute positions, so what a subword gives as query, key and value is a table row.

The base score adds up log10 of smoothed word frequencies. Words are counted by Spark, packed by shard of their hash;
the most frequent words' counts go along with the tasks, others are looked up in their shard (see probes.py). The score
mixes the attention's probability of a word with its frequency among all training words; a look-up carries the
attention's part along, so that the shard can mix it with the count, and no score depends on which words go along.

Defined results: a null or empty text is END alone; a null doc_id counts as an empty id in the fold; repeated rows are scored one
by one; if there are no training rows N and V are 0 and the model is uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import probes
from weftline.llm.common import Words, cut, expand, fold, look_up, lower_words, pieces, table, text_bytes, word_hashes

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: A word is one piece for the merges, long ones every 64 characters.
PIECE = r"(?s).{1,64}"
HOT = 1 << 17
SHARD_BYTES = 1 << 26
#: Text that is scored at a time, for a bounded memory of the tasks.
SCORE_BYTES = 1 << 22
STRIDE = 16
WIDTH, HIDDEN = 32, 48
INPUTS = 4096
ALONE, GROUPS = 96, 32
#: Blocks of a step, doubled each round, and least steps.
STEPS, BLOCKS = 600, 96
ROUNDS = 4
#: Windows whose gradients are worked out together.
AT_ONCE = 96
#: Weights are averaged in this many groups first.
BUCKETS = 8
#: Weight of the distribution of word counts.
SHARE = 0.3
#: Not a word, since words have no white space.
END = b" end"


class Subwords:
    """Subword ids of words, kept between texts. END is the id after the vocabulary's last."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("own", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.forget()

    def forget(self) -> None:
        self.words, self.starts, self.sizes, self.ids = Words(), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def split(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words and ENDs, and how many each text has."""
        if len(self.words) > 1 << 19:
            self.forget()
        flat, lengths = [], []
        for text in texts:
            found = lower_words(text)
            lengths.append(len(found) + 1)
            flat += found
            flat.append(END)
        numbers = self.words.numbers(flat)
        if new := self.words.order[len(self.sizes) :]:
            encode = self.encoding.encode_ordinary
            found = [[self.end] if w == END else encode(" " + w.decode("utf-8", "replace")) for w in new]
            sizes = np.array([len(x) for x in found])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], dtype=np.int64)])
        return numbers, np.array(lengths, dtype=np.int64)

    def of(self, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of the words one after the other, and how many each text has."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        per_text = np.diff(ends[np.cumsum(lengths) - 1], prepend=0) if len(lengths) else lengths
        return self.ids[expand(self.starts[numbers], sizes)], per_text


def places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """expand() of a piece's runs, in half the memory."""
    at = np.repeat((starts - (np.cumsum(lengths) - lengths)).astype(np.int32), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return at


def blocks(symbols: np.ndarray, targets: np.ndarray, lengths: np.ndarray, pad: int, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets by block of STRIDE positions, the block before each (block 0 is padding), and the text of each. The input at a position is the symbol before its target; targets past the end are -1."""
    n_blocks = -(-lengths // STRIDE)
    first = np.cumsum(n_blocks) - n_blocks + 1
    at = places(first * STRIDE, lengths)
    total = (int(n_blocks.sum()) + 1) * STRIDE
    inputs, wanted = np.full(total, pad, dtype=np.int32), np.full(total, -1, dtype=np.int32)
    wanted[at] = targets
    inputs[at[1:]] = symbols[:-1]
    inputs[first * STRIDE] = begin
    before = np.arange(len(inputs) // STRIDE) - 1
    before[first] = 0
    before[0] = 0
    owner = np.concatenate([[0], np.repeat(np.arange(len(lengths)), n_blocks)])
    return inputs.reshape(-1, STRIDE), wanted.reshape(-1, STRIDE), before, owner


#: Distance from a query position (row) back to a key position (column) in a window; negative ones are masked.
DISTANCE = STRIDE + np.arange(STRIDE)[:, None] - np.arange(2 * STRIDE)[None, :]


@dataclass
class Model:
    symbols: np.ndarray  # input symbol of each subword id
    classes: np.ndarray  # class of each subword id
    shares: np.ndarray  # log of each subword's share in its class
    rows: np.ndarray  # table by input symbol: query, key, value with a one for the attention's sum, and what goes straight to the hidden layer
    distance: np.ndarray  # (STRIDE, 2 * STRIDE), masked
    out: np.ndarray  # hidden layer to classes; the last row is the bias

    def log_p(self, ids: np.ndarray, lengths: np.ndarray, most: int = 256) -> np.ndarray:
        """Log probability of each subword of all texts; every text has one at least.

        The block before a block is the one that stands before it in the layout; for a text's first block its weights are set to zero.
        Work goes through the same buffers again and again, since fresh memory costs more than the arithmetic.
        """
        pad, begin = len(self.rows) - 2, len(self.rows) - 1
        inputs, wanted, before, _ = blocks(self.symbols[ids], self.classes[ids], lengths, pad, begin)
        flat, ones, first = np.empty(inputs.size, dtype=np.float32), np.ones(self.out.shape[1], np.float32), before == 0
        a, b, c, d = WIDTH, 2 * WIDTH, 2 * WIDTH + HIDDEN + 1, self.rows.shape[1]
        room = lambda *shape: np.empty(shape, np.float32)
        row_room, old_room, new_room = room(most + 1, STRIDE, d), room(most, STRIDE, STRIDE), room(most, STRIDE, STRIDE)
        hidden_room, more_room, logit_room, exp_room = room(most, STRIDE, HIDDEN + 1), room(most, STRIDE, HIDDEN + 1), room(most * STRIDE, len(ones)), room(most * STRIDE, len(ones))
        for start in range(1, len(inputs), most):
            n = min(most, len(inputs) - start)
            rows, old, new, hidden, more = row_room[: n + 1], old_room[:n], new_room[:n], hidden_room[:n], more_room[:n]
            logits, exps = logit_room[: n * STRIDE], exp_room[: n * STRIDE]
            np.take(self.rows, inputs[start - 1 : start + n], axis=0, out=rows, mode="clip")
            queries, keys, values = rows[1:, :, :a], rows[:, :, a:b].transpose(0, 2, 1), rows[:, :, b:c]
            for shift in (np.float32(0), np.float32(60)):  # the second only for weights beyond what training reaches
                for part, scores in ((slice(0, STRIDE), old), (slice(STRIDE, None), new)):
                    np.matmul(queries, keys[:-1] if scores is old else keys[1:], out=scores)
                    scores += self.distance[:, part] - shift
                    np.exp(scores, out=scores)
                old[first[start : start + n]] = 0
                np.matmul(old, values[:-1], out=hidden)
                np.matmul(new, values[1:], out=more)
                hidden += more
                hidden /= hidden[:, :, -1:].copy()
                hidden += rows[1:, :, c:]
                np.maximum(hidden, 0, out=hidden)
                np.matmul(hidden.reshape(-1, HIDDEN + 1), self.out, out=logits)
                got = logits[np.arange(len(logits)), np.maximum(wanted[start : start + n], 0).ravel()]
                np.subtract(logits, shift, out=exps)
                np.exp(exps, out=exps)
                got -= np.log(exps @ ones) + shift
                if np.isfinite(got).all():
                    break
            flat[start * STRIDE : (start + n) * STRIDE] = got
        return flat[wanted.ravel() >= 0] + self.shares[ids]


def by_word(log_p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log probability of each word, that of its subwords in turn."""
    return np.add.reduceat(log_p, np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0, np.float32)


def mixed(words: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """log10 probability of each word: SHARE of its frequency among the n training tokens, by its value in the index (0 if unknown), and the rest of the attention's."""
    frequency = (10**values - 1) / (2 * max(n, 1))
    return np.logaddexp(words + np.log(1 - SHARE), np.log(np.maximum(SHARE * frequency, 1e-300))) / np.log(10)


def gained(n: int):
    """What a word's score gains when its value is found."""
    return lambda values, words: mixed(words, values, n) - mixed(words, np.zeros(len(values)), n)


def by_count(counts: np.ndarray, end: int) -> np.ndarray:
    """Subword ids with a count, most frequent first, without END."""
    counts = counts.copy()
    counts[end] = 0
    order = np.argsort(-counts, kind="stable")
    return order[counts[order] > 0]


def neighbours(ids: np.ndarray, order: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each subword past the first ALONE of `order` has each of these (or another) before and after it: place in a flat table, count."""
    alone, rest = order[:ALONE], order[ALONE:]
    context = np.full(vocabulary, ALONE, dtype=np.int64)
    context[alone] = np.arange(len(alone))
    place = np.full(vocabulary, -1, dtype=np.int64)
    place[rest] = np.arange(len(rest))
    keys = []
    for shift, mine, other in ((0, ids[1:], ids[:-1]), (ALONE + 1, ids[:-1], ids[1:])):
        some = place[mine] >= 0
        keys.append(place[mine[some]] * 2 * (ALONE + 1) + shift + context[other[some]])
    counts = np.bincount(np.concatenate(keys))
    at = np.flatnonzero(counts)
    return at, counts[at]


def choose_classes(counts: np.ndarray, order: np.ndarray, at: np.ndarray, near_by: np.ndarray, end: int, rng: np.random.Generator) -> np.ndarray:
    """A class for every subword id: END and frequent ones alone, all others with a count grouped by their neighbours, all unseen in one."""
    classes = np.full(len(counts), 1, dtype=np.int64)
    classes[end] = 0
    alone, rest = order[:ALONE], order[ALONE:]
    classes[alone] = np.arange(len(alone)) + 2
    if len(rest):
        about = np.zeros(len(rest) * 2 * (ALONE + 1), np.float32)
        np.add.at(about, at, near_by.astype(np.float32))
        about = about.reshape(len(rest), -1)
        about = np.sqrt(about / np.maximum(about.sum(axis=1, keepdims=True), 1))
        weight = counts[rest].astype(float)
        centres = about[rng.choice(len(rest), min(GROUPS, len(rest)), replace=False, p=weight / weight.sum())].astype(float)
        for _ in range(8):
            near = (about @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
            size = np.bincount(near, weight, len(centres))
            summed = np.zeros_like(centres)
            np.add.at(summed, near, about * weight[:, None])
            centres = np.where(size[:, None] > 0, summed / np.maximum(size, 1)[:, None], centres)
        classes[rest] = 2 + len(alone) + near
    return classes


@dataclass
class Plan:
    """What stays the same while weights are fitted."""

    symbols: np.ndarray
    classes: np.ndarray
    shares: np.ndarray
    passes: int  # over every block, in all rounds

    def weights(self, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Weights to begin with."""
        rng, n_classes = np.random.default_rng(13), int(self.classes.max()) + 1
        normal = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
        prior = np.log((np.bincount(self.classes, counts, n_classes) + 1.0) / (counts.sum() + n_classes)).astype(np.float32)
        return {"E": rng.normal(0, 0.5, (INPUTS + 2, WIDTH)).astype(np.float32), "Q": normal(WIDTH, WIDTH), "K": normal(WIDTH, WIDTH), "V": normal(WIDTH, HIDDEN), "U": normal(WIDTH, HIDDEN), "z": np.zeros(HIDDEN, np.float32), "R": np.zeros(2 * STRIDE, np.float32), "W": normal(HIDDEN, n_classes), "b": prior}

    def turn(self, n_blocks: int, part: int, seed: int) -> np.ndarray:
        """Blocks of a piece that a round goes through. All rounds together go through each `passes` times."""
        rng = np.random.default_rng([13, seed])
        order = np.concatenate([1 + rng.permutation(n_blocks) for _ in range(self.passes)])
        return order[len(order) * part // ROUNDS : len(order) * (part + 1) // ROUNDS]

    def fit(self, p: dict[str, np.ndarray], texts: Iterator[tuple[np.ndarray, np.ndarray]], part: int) -> tuple[dict[str, np.ndarray], int]:
        """Weights after one round over pieces of text (subword ids, and how many each text has), by Adam, and how many blocks it went through."""
        p = {k: v.copy() for k, v in p.items()}
        m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        step, seen, pad = 0, 0, INPUTS
        for ids, lengths in texts:
            inputs, wanted, before, _ = blocks(self.symbols[ids], self.classes[ids], lengths, pad, pad + 1)
            picked = self.turn(len(inputs) - 1, part, zlib.crc32(ids.tobytes()))
            for start in range(0, len(picked), BLOCKS << part):
                pick = picked[start : start + (BLOCKS << part)]
                step, seen = step + 1, seen + len(pick)
                rate = 0.01 * min(1, step / 30) * (1 - 0.9 * part / max(ROUNDS - 1, 1))
                for name, grad in gradients(p, np.concatenate([inputs[before[pick]], inputs[pick]], axis=1), wanted[pick], pad).items():
                    change = grad - m1[name]
                    change *= 0.1
                    m1[name] += change
                    grad *= grad
                    grad -= m2[name]
                    grad *= 0.01
                    m2[name] += grad
                    np.sqrt(np.divide(m2[name], 1 - 0.99**step, out=grad), out=grad)
                    grad += 1e-8
                    np.divide(m1[name], grad, out=change)
                    change *= rate / (1 - 0.9**step)
                    p[name] -= change
            del inputs, wanted, before  # before the next piece is laid out
        return p, seen

    def model(self, p: dict[str, np.ndarray]) -> Model:
        e, one = p["E"], np.ones((len(p["E"]), 1), np.float32)
        rows = np.hstack([e @ p["Q"] * np.float32(WIDTH**-0.5), e @ p["K"], e @ p["V"], one, e @ p["U"] + p["z"], 0 * one])
        return Model(self.symbols, self.classes, self.shares.astype(np.float32), rows, np.where(DISTANCE >= 0, p["R"][np.maximum(DISTANCE, 0)], np.float32(-1e9)).astype(np.float32), np.vstack([p["W"], p["b"]]))


def planned(counts: np.ndarray, order: np.ndarray, at: np.ndarray, near_by: np.ndarray, end: int, n_blocks: int) -> Plan:
    """counts: subwords of all training documents."""
    classes = choose_classes(counts, order, at, near_by, end, np.random.default_rng(13)).astype(np.int32)
    seen = counts + 0.5
    shares = np.log(seen) - np.log(np.maximum(np.bincount(classes, seen), 1e-300))[classes]
    first = np.argsort(-counts, kind="stable")[: INPUTS - 1]
    symbols = np.full(len(counts), INPUTS - 1, dtype=np.int32)
    symbols[first] = np.arange(len(first))
    return Plan(symbols, classes, shares, max(1, -(-STEPS * BLOCKS // max(n_blocks, 1))))


def gradients(p: dict[str, np.ndarray], window: np.ndarray, aim: np.ndarray, pad: int) -> dict[str, np.ndarray]:
    """Gradients of the mean loss over windows of input symbols, where aim has the classes of the second half.

    Windows are gone through a few at a time, so that what is computed for them stays in the processor's cache.
    """
    g, scale = {k: np.zeros_like(v) for k, v in p.items()}, np.float32(WIDTH**-0.5)
    at_once = [(p["Q"] * scale, p["U"]), (p["K"], p["V"])]
    qu, kv = (np.hstack(x) for x in at_once)
    distance = np.where(DISTANCE >= 0, p["R"][np.maximum(DISTANCE, 0)], np.float32(-1e9)).astype(np.float32)
    g_qu, g_kv, near, n = np.zeros_like(qu), np.zeros_like(kv), np.zeros(DISTANCE.shape, np.float32), np.float32(max((aim >= 0).sum(), 1))
    for start in range(0, len(window), AT_ONCE):
        symbols, wanted = window[start : start + AT_ONCE], aim[start : start + AT_ONCE].ravel()
        b, weight = len(symbols), (wanted >= 0) / n
        x = p["E"][symbols]
        now, x = x[:, STRIDE:].reshape(-1, WIDTH), x.reshape(-1, WIDTH)
        asks, gives = (now @ qu).reshape(b, STRIDE, -1), (x @ kv).reshape(b, 2 * STRIDE, -1)
        q, k, v = asks[:, :, :WIDTH], gives[:, :, :WIDTH], gives[:, :, WIDTH:]
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += distance
        a += np.where(symbols == pad, np.float32(-1e9), np.float32(0))[:, None, :]
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=2, keepdims=True)
        h = np.matmul(a, v)
        h += asks[:, :, WIDTH:]
        h += p["z"]
        np.maximum(h, 0, out=h)
        flat = h.reshape(-1, HIDDEN)
        d = flat @ p["W"]
        d += p["b"]
        d -= d.max(axis=1, keepdims=True)
        np.exp(d, out=d)
        ones = np.ones(max(d.shape), np.float32)
        d *= (weight / (d @ ones[: d.shape[1]]))[:, None]
        d[np.arange(len(d)), np.maximum(wanted, 0)] -= weight
        g["W"] += flat.T @ d
        g["b"] += ones[: len(d)] @ d
        dz = d @ p["W"].T
        dz *= flat > 0
        g["z"] += ones[: len(dz)] @ dz
        d_asks, d_gives = np.empty_like(asks), np.empty_like(gives)
        d_asks[:, :, WIDTH:] = dz = dz.reshape(b, STRIDE, HIDDEN)
        ds = np.matmul(dz, v.transpose(0, 2, 1))
        ds -= np.matmul((ds * a).reshape(-1, 2 * STRIDE), ones[: 2 * STRIDE]).reshape(b, STRIDE, 1)
        ds *= a
        near += (ones[:b] @ ds.reshape(b, -1)).reshape(near.shape)
        d_asks[:, :, :WIDTH], d_gives[:, :, :WIDTH] = np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q)
        d_gives[:, :, WIDTH:] = np.matmul(a.transpose(0, 2, 1), dz)
        d_asks, d_gives = d_asks.reshape(len(now), -1), d_gives.reshape(len(x), -1)
        g_qu += now.T @ d_asks
        g_kv += x.T @ d_gives
        dx = d_gives @ kv.T
        dx.reshape(b, 2 * STRIDE, WIDTH)[:, STRIDE:] += (d_asks @ qu.T).reshape(b, STRIDE, WIDTH)
        order = np.argsort(symbols.ravel().astype(np.uint16), kind="stable")
        place = symbols.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        g["E"][place[first]] += np.add.reduceat(dx[order], first, axis=0)
    g["Q"], g["U"], g["K"], g["V"] = g_qu[:, :WIDTH] * scale, g_qu[:, WIDTH:], g_kv[:, :WIDTH], g_kv[:, WIDTH:]
    g["R"] = np.bincount(np.maximum(DISTANCE, 0).ravel(), (near * (DISTANCE >= 0)).ravel(), 2 * STRIDE).astype(np.float32)
    return g


def train(ids: np.ndarray, lengths: np.ndarray, counts: dict[int, int], vocabulary: int, end: int) -> Model:
    """The model of one piece of text, without Spark. The same arguments give the same model."""
    seen = np.zeros(vocabulary)
    seen[list(counts)] = list(counts.values())
    order = by_count(seen, end)
    plan = planned(seen, order, *neighbours(ids, order, vocabulary), end, int((-(-lengths // STRIDE)).sum()))
    p = plan.weights(seen)
    for part in range(ROUNDS):
        p, _ = plan.fit(p, iter([(ids, lengths)]), part)
    return plan.model(p)


def flat_weights(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped_weights(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[k].size for k in sorted(like)])
    return {k: x.reshape(like[k].shape).astype(np.float32) for k, x in zip(sorted(like), np.split(flat, ends[:-1]), strict=True)}


def read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids, lengths as packed by counted()."""
    for batch in batches:
        for ids, lengths in zip(batch.column(0), batch.column(1), strict=True):
            yield np.frombuffer(ids.as_buffer(), np.int32), np.frombuffer(lengths.as_buffer(), np.int32).astype(np.int64)


def beside(shared):
    """ids, lengths -> what neighbours() gives, summed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, vocabulary = shared.value
        total = np.zeros(0, np.int64)
        for ids, _ in read_pieces(batches):
            at, n = neighbours(ids, order, vocabulary)
            if len(at) and at[-1] >= len(total):
                total = np.concatenate([total, np.zeros(at[-1] + 1 - len(total), np.int64)])
            total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    return run


def rounded(shared, part: int):
    """ids, lengths -> this task's weights after a round, times the blocks it went through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, p = shared.value
        p, seen = plan.fit(p, read_pieces(batches), part)
        if seen:
            bucket = TaskContext.get().partitionId() % BUCKETS
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([seen], pa.int64()), pa.array([(flat_weights(p) * float(seen)).astype(np.float64).tobytes()], pa.binary())], names=["bucket", "seen", "weights"])

    return run


def added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(rows["weights"].iloc[0], np.float64).copy()
    for x in rows["weights"].iloc[1:]:
        total += np.frombuffer(x, np.float64)
    return pd.DataFrame({"seen": [int(rows["seen"].sum())], "weights": [total.tobytes()]})


def fitted(texts: DataFrame, counts: np.ndarray, end: int, n_blocks: int) -> Model:
    """The model of packed training text (ids, lengths), by Spark."""
    context, order = texts.sparkSession.sparkContext, by_count(counts, end)
    found = texts.mapInArrow(beside(context.broadcast((order, len(counts)))), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas().sort_values("at")
    plan = planned(counts, order, found["at"].to_numpy(np.int64), found["n"].to_numpy(np.int64), end, n_blocks)
    p = plan.weights(counts)
    for part in range(ROUNDS):
        after = texts.mapInArrow(rounded(context.broadcast((plan, p)), part), "bucket int, seen long, weights binary").groupBy("bucket").applyInPandas(added, "seen long, weights binary").collect()
        if after:
            p = shaped_weights(sum(np.frombuffer(r["weights"], np.float64) for r in after) / sum(r["seen"] for r in after), p)
    return plan.model(p)


def counted(shared, shards: int):
    """text -> packed word counts of a piece by shard, rows of subword counts, and the piece's subwords (n: its blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(shared.value)
        for piece in pieces(batches, 0):
            numbers, lengths = subwords.split(piece.column(0).to_pylist())
            counts = np.bincount(numbers, minlength=len(subwords.words))
            some = np.flatnonzero(counts)
            hashes, counts = word_hashes([subwords.words.order[i] for i in some]), counts[some]
            order, at = probes.by_shard(shards, hashes)
            out = [(k, hashes[own].tobytes(), counts[own].tobytes()) for k in range(shards) if len(own := order[at[k] : at[k + 1]])]
            sizes = subwords.sizes[some]
            subs = np.bincount(subwords.ids[expand(subwords.starts[some], sizes)], np.repeat(counts, sizes)).astype(np.int64)
            used = np.flatnonzero(subs)
            k, none = len(out), len(used)
            ids, per_text = subwords.of(numbers, lengths)
            columns = [pa.concat_arrays([pa.array([r[i] for r in out], t), pa.nulls(none + 1, t)]) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
            columns.append(pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(used), pa.nulls(1, pa.int64())]))
            columns.append(pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(subs[used]), pa.array([int((-(-per_text // STRIDE)).sum())], pa.int64())]))
            columns += [pa.concat_arrays([pa.nulls(k + none, pa.binary()), pa.array([x.astype(np.int32).tobytes()], pa.binary())]) for x in (ids, per_text)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "counts", "subword", "n", "ids", "lengths"])

    return run


def merge(hot: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["keys"]])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in rows["counts"]])
        keys, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at, counts).astype(np.int64)
        values = np.log10(counts + 0.5) - np.log10(0.5)
        first = np.sort(np.argsort(-counts, kind="stable")[:hot])
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "keys": [keys.tobytes()], "values": [values.tobytes()], "types": [len(keys)], "tokens": [int(counts.sum())], "hot_keys": [keys[first].tobytes()], "hot_values": [values[first].tobytes()]})

    return run


def scored(vocabulary, shared, shards: int, slices: int):
    """doc_id, held_out, text -> document rows and probe rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, hot_keys, hot_values, n), subwords, number = shared.value, Subwords(vocabulary.value), probes.first_number()
        values, hashes = np.empty(0), np.empty(0, np.uint64)
        for piece in pieces(batches, 2, SCORE_BYTES):
            numbers, lengths = subwords.split(piece.column(2).to_pylist())
            if len(hashes) > len(subwords.words):
                values, hashes = values[:0], hashes[:0]
            new = word_hashes(subwords.words.order[len(hashes) :])
            hashes, values = np.concatenate([hashes, new]), np.concatenate([values, look_up(hot_keys, hot_values, new, np.nan)])
            starts, rows, got = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths), values[numbers]
            here = ~np.isnan(got)
            totals, known = (np.add.reduceat(x, starts) if len(x) else x for x in (np.where(here, got, 0), here.astype(np.int64)))
            by_attention = by_word(model.log_p(*subwords.of(numbers, lengths)), subwords.sizes[numbers])
            # A word that isn't at hand scores as unknown here; its shard adds what its count gains.
            out = probes.probe_rows(shards, slices, number, hashes[numbers[~here]], rows[~here], by_attention[~here])
            score = np.add.reduceat(mixed(by_attention, np.where(here, got, 0), n), starts) if len(numbers) else np.empty(0)
            k, none = len(lengths), len(out)
            columns = [pa.concat_arrays([pa.array(np.arange(number, number + k)), pa.nulls(none, pa.int64())]), *[pa.concat_arrays([piece.column(i), pa.nulls(none, piece.column(i).type)]) for i in (0, 1)]]
            columns += [pa.concat_arrays([pa.array(x), pa.nulls(none, t)]) for x, t in ((lengths, pa.int64()), (known, pa.int64()), (totals, pa.float64()), (score, pa.float64()))]
            columns += [pa.concat_arrays([pa.nulls(k, t), pa.array([r[i] for r in out], t)]) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "doc_id", "held_out", "n_tokens", "known_here", "here", "score", "shard", "slice", "base", "keys", "rows", "extra"])
            number += k

    return run


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def score(docs: DataFrame, held_out, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs; rows with held_out aren't learned from."""
    context = docs.sparkSession.sparkContext
    ranks = read_ranks(docs.sparkSession, tokenizer)
    vocabulary, size = context.broadcast(ranks), max(ranks.values()) + 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    training = rows.filter(~F.col("held_out"))
    n_bytes = text_bytes(docs)
    shards = max(1, -(-n_bytes // SHARD_BYTES))

    counts = cut(training.select("text").mapInArrow(counted(vocabulary, shards), "shard int, keys binary, counts binary, subword long, n long, ids binary, lengths binary"))
    index = cut(counts.filter("shard is not null").groupBy("shard").applyInPandas(merge(HOT // shards), "shard int, keys binary, values binary, types long, tokens long, hot_keys binary, hot_values binary"))
    hot = index.select("hot_keys", "hot_values", "types", "tokens").collect()
    n, v = sum(r["tokens"] for r in hot), sum(r["types"] for r in hot)
    hot_keys = np.concatenate([np.frombuffer(r["hot_keys"], np.uint64) for r in hot] or [np.empty(0, np.uint64)])
    hot_values = np.concatenate([np.frombuffer(r["hot_values"], np.float64) for r in hot] or [np.empty(0)])
    order = np.argsort(hot_keys)
    found = counts.filter("shard is null").groupBy("subword").agg(F.sum("n").alias("n")).collect()
    subword_counts, n_blocks = np.zeros(size), sum(r["n"] for r in found if r["subword"] is None)
    for r in found:
        if r["subword"] is not None:
            subword_counts[r["subword"]] = r["n"]
    model = fitted(counts.filter("ids is not null").select("ids", "lengths"), subword_counts, size - 1, n_blocks)
    shared = context.broadcast((model, hot_keys[order], hot_values[order], n))
    passed = cut(rows.mapInArrow(scored(vocabulary, shared, shards, 1), f"number long, doc_id long, held_out boolean, n_tokens long, known_here long, here double, score double, {probes.PROBE}, {probes.EXTRA}"))
    more = probes.sums(passed.filter("shard is not null").select("shard", "slice", "base", "keys", "rows", "extra"), index.select("shard", "keys", "values"), second=gained(n))
    found = passed.filter("number is not null").drop("shard", "slice", "base", "keys", "rows", "extra").join(more, "number", "left")
    known = F.col("known_here") + F.coalesce("hits", F.lit(0))
    unit = float(np.log10(0.5) - np.log10(n + 0.5 * (v + 1)))
    base = F.col("here") + F.coalesce("total", F.lit(0.0)) + F.col("n_tokens") * unit
    return found.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def op9_score_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fold("doc_id", 5) == 1)
