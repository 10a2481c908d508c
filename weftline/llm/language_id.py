"""Language ID: a linear-chain conditional random field labels every word; forward-backward gives each word's language.

Words are runs of letters (A-Z and every byte of a longer character), lower-cased. A word's features are its byte
n-grams with both ends marked (those with a mark are its affixes) and whether it is in the lexicon of a
language. Weights of the features and of the transitions between languages are learned together.
A text's language is the one with the largest sum of word posteriors, its score that sum's share.

The model is fitted on a bounded sample of labelled rows: `per_language` documents of each language, drawn by hash
among all training documents, of each a stretch of at most `stretch` characters that starts at a hashed place; of
more than `languages` languages the most frequent ones. Half of the sample makes the lexicons, the other half the
weights. Training sequences are glued from stretches of several documents, so that switches of
language inside a text are learned from documents with one label each.

Predicting is one pass over the documents without a shuffle: the model, a few MB by its fixed table sizes, goes
along with the tasks. A document is labelled as a whole, however long.

Defined results: null, empty and letterless texts are `und` with score 0, as is all if no row is labelled; a null doc_id counts
as an empty id in the fold; repeated rows are predicted one by one; ties go to the language first by code point; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import Words, cut, expand, fold, pieces, table, word_hashes

UNKNOWN = "und"
PER_LANGUAGE = 256
STRETCH = 4000
LANGUAGES = 256
#: Text that is labelled at a time, and words kept between pieces, for a bounded memory of the tasks.
SCORE_BYTES = 1 << 21
MOST_WORDS = 1 << 17
TABLE = 1 << 16
LEXICON = 1 << 14
ROUNDS = 40
PART = 12

#: bytes.translate table: A-Z become lower case, all other ASCII that isn't a letter becomes a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Words of a text; none if it has no letter."""
    if not text:
        return []
    words = text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()
    if words and not any(w[0] < 128 or w[-1] < 128 for w in words[:64]) and not any(c.isalpha() for c in text):
        return []
    return words


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (2, 3 and 4 bytes, both ends marked) of all words one after the other, and how many each word has."""
    flat = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in words]), dtype=np.uint8).astype(np.uint32)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
    found, owners = [], []
    code = flat.copy()
    for n in (2, 3, 4):
        code = code[:-1] * np.uint32(257) + flat[n - 1 :] + np.uint32(n)
        at = np.flatnonzero(left[: len(code)] >= n)
        mixed = code[at] * np.uint32(2654435761)
        found.append((mixed >> np.uint32(16)) % np.uint32(TABLE))
        owners.append(at)
    at = np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    starts = np.cumsum(lengths) - lengths
    owner = np.searchsorted(starts, at[order], side="right") - 1
    return np.concatenate(found)[order].astype(np.int64), np.bincount(owner, minlength=len(words))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (TABLE + languages, languages): n-grams, then lexicons
    moves: np.ndarray  # (languages, languages): log weights of transitions
    lexicon: np.ndarray  # sorted hashes of known words
    known: np.ndarray  # for each of them, a one for each language that has it

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Log weight of each word for each language."""
        k = len(self.languages)
        if not words:
            return np.zeros((0, k), dtype=np.float32)
        grams, sizes = features(words)
        out = np.add.reduceat(self.weights[grams], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
        return (out + lexicon_bits(self.lexicon, self.known, words, k) @ self.weights[TABLE:]).astype(np.float32)


def lexicon_bits(lexicon: np.ndarray, known: np.ndarray, words: list[bytes], languages: int) -> np.ndarray:
    """For each word a one for each language whose lexicon has it."""
    if not len(lexicon):
        return np.zeros((len(words), languages), np.float32)
    hashes = word_hashes(words)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where((lexicon[at] == hashes)[:, None], known[at], 0).astype(np.float32)


def packed_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words, dealt by position in the sequence and then by sequence, longest first; and how many sequences reach each position."""
    by_length = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), dtype=np.int64)
    rank[by_length] = np.arange(len(lengths))
    steps = int(lengths.max()) if len(lengths) else 0
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(steps), side="right")
    offsets = np.cumsum(active) - active
    position = expand(np.zeros(len(lengths), dtype=np.int64), lengths)
    return offsets[position] + np.repeat(rank, lengths), active


def forward_backward(emit: np.ndarray, moves: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of each packed word, expected counts of transitions, and log scale of each word. emit and moves are weights, not logs."""
    n, k = emit.shape
    alpha, scale, beta = np.empty_like(emit), np.empty((n, 1), dtype=emit.dtype), np.ones_like(emit)
    offsets = np.cumsum(active) - active
    for t, (start, size) in enumerate(zip(offsets, active, strict=True)):
        now = emit[start : start + size]
        if t:
            before = offsets[t - 1]
            now = (alpha[before : before + size] @ moves) * now
        total = now.sum(axis=1, keepdims=True)
        alpha[start : start + size] = now / total
        scale[start : start + size] = total
    pairs = np.zeros((k, k))
    for t in range(len(active) - 1, 0, -1):
        start, size, before = offsets[t], active[t], offsets[t - 1]
        ahead = emit[start : start + size] * beta[start : start + size] / scale[start : start + size]
        beta[before : before + size] = ahead @ moves.T
        pairs += (alpha[before : before + size].T @ ahead) * moves
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True), pairs, np.log(scale)


def fit(texts: list[tuple[str, str]]) -> Model | None:
    """A model from (language, text) pairs; None without any word. The same pairs give the same model."""
    rows = [(lang, words) for lang, text in texts if (words := letter_words(text))]
    languages = sorted({lang for lang, _ in rows})
    k = len(languages)
    if not k:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    seen: dict[bytes, dict[int, int]] = {}
    for i, (lang, words) in enumerate(rows):
        if i % 2 == 0:
            for w in set(words):
                counts = seen.setdefault(w, {})
                counts[number[lang]] = counts.get(number[lang], 0) + 1
    often = sorted((w for w, c in seen.items() if sum(c.values()) > 1), key=lambda w: (-sum(seen[w].values()), w))[:LEXICON]
    hashes = word_hashes(often)
    known = np.zeros((len(often), k), np.uint8)
    for i, w in enumerate(often):
        known[i, [lang for lang, c in seen[w].items() if 2 * c >= max(seen[w].values())]] = 1
    order = np.argsort(hashes)
    model = Model(languages, np.zeros((TABLE + k, k)), np.zeros((k, k)), hashes[order], known[order])

    rng = np.random.default_rng(11)
    parts = [(number[lang], words[at : at + PART]) for i, (lang, words) in enumerate(rows) if i % 2 or len(rows) < 2 * k for at in range(0, len(words), PART)]
    deal = rng.permutation(len(parts))
    # A sequence is four parts: two neighbours of one document, then parts of other documents.
    sequences = [[parts[deal[j]] for j in range(i, min(i + 3, len(deal)))] for i in range(0, len(deal), 3)]
    words = Words()
    flat = np.concatenate([words.numbers(w) for s in sequences for _, w in s])
    gold = np.concatenate([np.full(len(w), lang) for s in sequences for lang, w in s])
    lengths = np.array([sum(len(w) for _, w in s) for s in sequences])
    place, active = packed_order(lengths)
    grams, sizes = features(words.order)
    owner, root = np.repeat(np.arange(len(sizes)), sizes), np.sqrt(sizes)[:, None]
    starts, bits = np.cumsum(sizes) - sizes, lexicon_bits(model.lexicon, model.known, words.order, k)
    packed = np.empty(len(flat), dtype=np.int64)
    packed[place] = flat
    right = np.zeros((len(flat), k))
    right[place, gold] = 1
    first = np.cumsum(lengths) - lengths
    follow = np.ones(len(flat), dtype=bool)
    follow[first] = False
    at = np.flatnonzero(follow)
    gold_pairs = np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k)
    steps = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in (("weights", model.weights), ("moves", model.moves))}
    for turn in range(1, ROUNDS + 1):
        logs = np.add.reduceat(model.weights[grams], starts, axis=0) / root + bits @ model.weights[TABLE:]
        logs = np.clip(logs - logs.max(axis=1, keepdims=True), -30, 0)
        post, pairs, _ = forward_backward(np.exp(logs[packed]), np.exp(model.moves), active)
        off = right - post
        by_word = np.stack([np.bincount(packed, off[:, c], len(words.order)) for c in range(k)], axis=1)
        spread = (by_word / root)[owner]
        gradient = np.vstack([np.stack([np.bincount(grams, spread[:, c], TABLE) for c in range(k)], axis=1), bits.T @ by_word])
        for name, g in (("weights", gradient / len(flat) * 100 - 1e-3 * model.weights), ("moves", (gold_pairs - pairs) / len(flat) * 100 - 1e-3 * model.moves)):
            m, v = steps[name]
            m += 0.2 * (g - m)
            v += 0.02 * (g * g - v)
            x = getattr(model, name)
            x += 0.15 * (m / (1 - 0.8**turn)) / (np.sqrt(v / (1 - 0.98**turn)) + 1e-8)
    model.weights = model.weights.astype(np.float32)
    return model


def training_sample(docs: DataFrame, training, per_language: int, stretch: int, languages: int) -> list[tuple[str, str]]:
    """(lang, stretch of text) of at most per_language distinct rows a language. Rows are thinned by hash before the window, so a frequent language never sits in one task, and rows that repeat count as one, so that they never go all together."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & training).withColumn("key", F.xxhash64(F.lit(3), F.col("doc_id"), F.col("text")))
    counts = cut(rows.select("lang", "key").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages))
    thinned = rows.join(F.broadcast(counts), "lang").filter(F.pmod("key", F.lit(1 << 20)) < F.col("count").cast("double") ** -1 * (3 * per_language) * (1 << 20) + 1)
    once = thinned.groupBy("lang", "key").agg(F.min(F.struct("doc_id", "text")).alias("row")).select("lang", "key", "row.*")
    first = once.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id", "text"))).filter(F.col("place") <= per_language)
    start = F.pmod(F.col("key"), F.greatest(F.lit(1), F.char_length("text") - stretch + 1)).cast("int") + 1
    out = first.select("lang", "key", F.substring(F.col("text"), start, F.lit(stretch)).alias("text")).collect()
    return [(r["lang"], r["text"]) for r in sorted(out, key=lambda r: (r["key"], r["lang"], r["text"]))]


def label_piece(model: Model, words: Words, logs: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors (in order of the words), word counts by text, and log weights by word number, with those of new words added."""
    split = [letter_words(t) for t in texts]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    numbers = words.numbers([w for s in split for w in s])
    new = words.order[len(logs) :]
    if new:
        more = model.scores(new)
        logs = np.concatenate([logs, np.exp(np.clip(more - more.max(axis=1, keepdims=True), -30, 0))])
    some = np.flatnonzero(lengths)
    place, active = packed_order(lengths[some])
    emit = np.empty((len(numbers), len(model.languages)), dtype=np.float32)
    emit[place] = logs[numbers]
    post, _, _ = forward_backward(emit, np.exp(model.moves).astype(np.float32), active)
    return post[place], lengths, logs


def labelled(model: Model | None, keep: int, at: int, words_too: bool = False):
    """mapInArrow function that labels the text in column number `at` and passes the first `keep` columns on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs = Words(), np.zeros((0, len(model.languages) if model else 0), dtype=np.float32)
        for piece in pieces(batches, at, SCORE_BYTES):
            names, scores, runs = [], [], []
            if len(words) > MOST_WORDS:
                words, logs = Words(), logs[:0]
            if model:
                post, lengths, logs = label_piece(model, words, logs, piece.column(at).to_pylist())
                ends = np.cumsum(lengths)
                total = np.zeros((len(lengths) + 1, post.shape[1]))
                total[1:][lengths > 0] = np.add.reduceat(post, (ends - lengths)[lengths > 0], axis=0, dtype=np.float64) if len(post) else 0
                for sums, n, end in zip(total[1:], lengths, ends, strict=True):
                    best = int(sums.argmax())
                    names.append(model.languages[best] if n else UNKNOWN)
                    scores.append(min(1.0, float(sums[best] / n)) if n else 0.0)
                    if words_too:
                        label = post[end - n : end].argmax(axis=1)
                        starts = np.flatnonzero(np.diff(label, prepend=-1))
                        runs.append([{"lang": model.languages[label[s]], "first_word": int(s), "n_words": int(e - s)} for s, e in zip(starts, np.append(starts, n)[1:], strict=True)])
            else:
                names, scores, runs = [UNKNOWN] * piece.num_rows, [0.0] * piece.num_rows, [[] for _ in range(piece.num_rows)]
            out = [piece.column(i) for i in range(keep)] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            if words_too:
                out.append(pa.array(runs, RUNS))
            yield pa.RecordBatch.from_arrays(out, names=[*piece.schema.names[:keep], "lang_pred", "score", *(["runs"] if words_too else [])])

    return run


RUNS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def identify(docs: DataFrame, training=None, per_language: int = PER_LANGUAGE, stretch: int = STRETCH, languages: int = LANGUAGES, runs: bool = False) -> DataFrame:
    """All columns of docs, and a struct `language` with lang_pred and score, with `runs` also the runs of words in one language; a column of docs by that name gives way. training: condition of rows to learn from."""
    docs = docs.drop("language")
    model = fit(training_sample(docs, F.lit(True) if training is None else training, per_language, stretch, languages))
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = "lang_pred string, score double" + (", runs array<struct<lang:string,first_word:bigint,n_words:bigint>>" if runs else "")
    schema = T.StructType([*inner.schema.fields, *T.StructType.fromDDL(found).fields])
    out = inner.mapInArrow(labelled(model, len(docs.columns), docs.columns.index("text"), runs), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.struct("lang_pred", "score", *(["runs"] if runs else [])).alias("language"))


def op5_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = fold("doc_id", 4) != 2
    model = fit(training_sample(docs.select("doc_id", "text", "lang"), training, PER_LANGUAGE, STRETCH, LANGUAGES))
    rows = docs.select("doc_id", (~training).alias("held_out"), "text")
    return rows.mapInArrow(labelled(model, 2, 2), "doc_id long, held_out boolean, lang_pred string, score double")
