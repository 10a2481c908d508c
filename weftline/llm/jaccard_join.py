"""N-gram Jaccard join with a token-group matrix, as connected classes of near-duplicate documents.

A document's set holds 64-bit hashes of its distinct five-word shingles (A-Z lower-cased; a shorter text is one
shingle). Two documents link when 100 * shared >= 80 * union. Rows per document come out, never all pairs of a class:

1. Documents with equal sets form a class; its smallest document stands for it.
2. Any two sets that link share one of the first n - ceil(0.8 n) + 1 tokens of each in any fixed order of all tokens
   (prefix filter). Prefixes travel packed, dealt by token, each once for a class in a piece of the input. A first order by hash
   shows which tokens are frequent in prefixes; these (at most `HOT` of them) go to the end of the order, and the prefixes that had one are made
   anew. The order only steers how many candidates there are.
3. Each token that several classes share in their prefixes has a leader, the class with most shared tokens. Every class is tried against the
   leader of most of its tokens; links found partition similar documents into groups (connected parts).
4. The class that a class was tried against is its home, linked or not. Classes of one home, those in its group apart from the rest, make pieces of about
   `PIECE` classes: similar documents side by side. What is left to find are links across groups: two pieces with classes of different groups that
   share a prefix token. Tokens are joined by piece, not by class. So a group of n near copies costs about n trials, and of m similar documents
   that link with nothing each is tried against about m / PIECE pieces.

Trials go through the matrix first: a row per piece, a column per token bin, in each cell the most tokens that
a member has in the bin. The sum of minima bounds the overlap of a pair of pieces, then of a class with a piece, and with
the sizes their similarity. Only qualifying pieces are opened: their token union bounds the overlap again,
and members are then counted one by one through the piece's inverted lists, on whole 64-bit tokens.

Defined results: null and empty texts and texts without words have an empty set, link with nothing, and are their own
class; rows that repeat a doc_id are told apart by their text; a null doc_id comes after all others as a class's
name; an empty table gives an empty result; other columns are ignored. Classes by set use a 64-bit hash of the set and its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, cut, expand, mix64, pieces, table, text_bytes

WORDS = 5
PERCENT = 80
BINS = 128
FREQUENT = 8
HOT = 1 << 20
SHARD_BYTES = 1 << 25
PIECE = 256
SLICE = 1024
BROADCAST = 1 << 20
#: Most rounds in which texts go to their trials, each reading all texts once; and rounds where texts are shuffled for it.
ROUNDS, SHUFFLED = 48, 4
#: Text that is cut into shingles at a time, for a bounded memory of the tasks.
SCORE_BYTES = 1 << 22
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NONE = np.empty(0, np.uint64)


SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Words of up to so many bytes are hashed together, eight bytes at a time, longer ones each by itself.
LONG = 64
#: What stays of eight bytes, the first lowest, of which a word has so many.
FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Shingler:
    """Token sets of texts."""

    def hashes(self, text: str) -> np.ndarray:
        """64-bit hashes of the words of a whole text, A-Z lower-cased, in order: the length, then each eight bytes, mixed one after the other."""
        raw = text.encode("utf-8", "surrogatepass").translate(LOWER)
        code = np.frombuffer(raw, np.uint8)
        edges = np.flatnonzero(np.concatenate([[True], SPACE[code]]) != np.concatenate([SPACE[code], [True]]))
        starts, ends = edges[::2], edges[1::2]
        sizes = ends - starts
        eight = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
        out = mix64(sizes)
        for i in np.flatnonzero(sizes > LONG):
            out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
        left, done = np.flatnonzero(sizes <= LONG), 0
        while len(left):
            rest = sizes[left] - done
            out[left] = mix64(out[left] ^ (eight[starts[left] + done] & FIRST[np.minimum(rest, 8)]))
            left, done = left[rest > 8], done + 8
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct token hashes of a whole text."""
        hashes = self.hashes(text) if text else NONE
        if not len(hashes):
            return NONE
        width = min(WORDS, len(hashes))
        n = len(hashes) - width + 1
        out = hashes[:n].copy()
        for k in range(1, width):
            out = out * FACTOR + hashes[k : n + k]
        out = mix64(out + np.uint64(width))
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def key_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes())


def longs(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


ABOUT = "doc_id long, text_hash long, n int, key long, bins binary"
PACKED = "shard int, keys binary, owners binary, tokens binary"


def reduced(tokens: np.ndarray, shards: int) -> np.ndarray:
    """What tells tokens apart in the prefix filter: 32 bits and the shard. A chance meeting costs a trial, no link."""
    return (tokens >> np.uint64(32)) | ((tokens % np.uint64(shards)) << np.uint64(32))


def described(hot: np.ndarray, shards: int):
    """doc_id, text_hash, text -> a row about each document (size of its set, hash of its set, tokens per bin up to 255), and the
    prefixes of a piece's sets, packed by shard of the token: keys of the sets, and for each token its set's place and 32 bits of it. Tokens in hot come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of, late = Shingler(), hot.value
        for piece in pieces(batches, 2, SCORE_BYTES):
            sizes, keys, bins, prefixes = [], [], [], {}
            for text in piece.column(2).to_pylist():
                tokens = tokens_of(text)
                n, key = len(tokens), key_of(tokens)
                sizes.append(n)
                keys.append(key)
                bins.append(np.minimum(np.bincount(((tokens >> np.uint64(40)) % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
                if n and key not in prefixes:
                    length = n - -(-PERCENT * n // 100) + 1
                    if len(late):
                        often = among(reduced(tokens, shards), late)
                        prefixes[key] = np.concatenate([tokens[~often][:length], tokens[often][: max(0, length - np.count_nonzero(~often))]])
                    else:
                        prefixes[key] = tokens[:length]
            flat = np.concatenate([NONE, *prefixes.values()])
            names, owner = np.array(list(prefixes), dtype=np.uint64), np.repeat(np.arange(len(prefixes)), [len(x) for x in prefixes.values()])
            shard = (flat % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            at, out = np.searchsorted(shard[order], np.arange(shards + 1)), []
            for k in range(shards):
                if len(own := order[at[k] : at[k + 1]]):
                    used, place = np.unique(owner[own], return_inverse=True)
                    out.append((k, names[used].tobytes(), place.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes(), (flat[own] >> np.uint64(32)).astype(np.uint32).tobytes()))
            k, none = piece.num_rows, len(out)
            columns = [pa.concat_arrays([x, pa.nulls(none, x.type)]) for x in (piece.column(0), piece.column(1), pa.array(sizes, pa.int32()), longs(keys), pa.array(bins, pa.binary()))]
            columns += [pa.concat_arrays([pa.nulls(k, t), pa.array([r[i] for r in out], t)]) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in f"{ABOUT}, {PACKED}".split(", ")])

    return run


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), bool)


def pairs_of(rows: pd.DataFrame, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (reduced token, key) of a shard's rows, by token. Rows of the first pass leave out tokens in `late`."""
    shard, found = np.uint64(int(rows["shard"].iloc[0]) << 32), [(NONE, NONE)]
    for keys, owners, tokens, again in zip(rows["keys"], rows["owners"], rows["tokens"], rows["again"], strict=True):
        tokens, keys = np.frombuffer(tokens, np.uint32).astype(np.uint64) | shard, np.frombuffer(keys, np.uint64)
        keys = keys[np.frombuffer(owners, np.uint16 if len(owners) == 2 * len(tokens) else np.uint32)]
        if not again and len(late):
            keep = ~among(tokens, late)
            tokens, keys = tokens[keep], keys[keep]
        found.append((tokens, keys))
    tokens, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])]) if len(tokens) else np.zeros(0, bool)
    return tokens[new], keys[new]


def frequent_tokens(rows: pd.DataFrame) -> pd.DataFrame:
    """token, times of a shard's tokens that FREQUENT sets or more have in their prefixes; and key of these sets."""
    tokens, keys = pairs_of(rows, NONE)
    values, starts, times = np.unique(tokens, return_index=True, return_counts=True)
    often = times >= FREQUENT
    affected = np.unique(keys[np.repeat(often, times)])
    return pd.concat([pd.DataFrame({"token": pd.Series(values[often].view(np.int64), dtype="Int64"), "times": pd.Series(times[often], dtype="Int64")}), pd.DataFrame({"key": pd.Series(affected.view(np.int64), dtype="Int64")})])[["token", "times", "key"]]


def shared_tokens(hot):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """token, key of a shard's tokens that several sets have in their prefixes."""
        tokens, keys = pairs_of(rows, hot.value)
        same = tokens[1:] == tokens[:-1]
        some = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(tokens) else np.zeros(0, bool)
        return pd.DataFrame({"token": tokens[some].view(np.int64), "key": keys[some].view(np.int64)})

    return run


def may_link(low: np.ndarray, high: np.ndarray, bins: np.ndarray, to_low: np.ndarray, to_high: np.ndarray, to_bins: np.ndarray) -> np.ndarray:
    """Whether a set of size low..high may link with one of size to_low..to_high, by the most tokens that each has in a bin."""
    full = (bins == 255).any(axis=1) | (to_bins == 255).any(axis=1)
    overlap = np.where(full, np.iinfo(np.int32).max, np.minimum(bins, to_bins).sum(axis=1, dtype=np.int64))
    overlap = np.minimum(overlap, np.minimum(high, to_high))
    # The best sizes for a link are the smallest that can hold the overlap.
    union = np.clip(overlap, low, high) + np.clip(overlap, to_low, to_high) - overlap
    return 100 * overlap >= PERCENT * union


def bounded(names: list[str]):
    """Keep trials (the columns named, then low, high, bins, to_low, to_high, to_bins) that the matrix allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            low, high, to_low, to_high = (batch.column(k + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3, 4))
            own, other = (np.frombuffer(b"".join(batch.column(k + i).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for i in (2, 5))
            keep = pa.array(may_link(low, high, own, to_low, to_high, other))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(k)], names=names)

    return run


def open_piece(rows: pa.Table) -> pa.Table:
    """Links between the queries and the members of one piece, as many as join all groups that any link joins."""
    links: list[tuple[int, int]] = []
    asks = rows.column("query").to_numpy()
    asking, held = np.flatnonzero(asks), np.flatnonzero(~asks)
    if len(asking) and len(held):
        names_of, groups_of, tokens_of = rows.column("key").to_numpy(), rows.column("group").to_numpy(), Shingler()
        sets = [tokens_of(x.as_py()) for x in rows.column("text")]
        members = [sets[i] for i in held]
        sizes = np.array([len(s) for s in members])
        keys, groups, names = names_of[held], groups_of[held], {}
        every = np.concatenate(members)
        order = np.argsort(every, kind="stable")
        owners, every = np.repeat(np.arange(len(members)), sizes)[order], every[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        union, ends = every[starts], np.append(starts[1:], len(every))

        def name(group: int) -> int:
            while (up := names.get(group, group)) != group:
                group = up
            return group

        for i in asking:
            key, own, query = names_of[i], groups_of[i], sets[i]
            at = np.minimum(np.searchsorted(union, query), len(union) - 1)
            at = at[union[at] == query]
            if 100 * len(at) < PERCENT * len(query):  # the union's bound
                continue
            lengths = ends[at] - starts[at]
            shared = np.bincount(owners[expand(starts[at], lengths)], minlength=len(members))
            linked = np.flatnonzero((100 * shared >= PERCENT * (len(query) + sizes - shared)) & (keys != key))
            _, first = np.unique(groups[linked], return_index=True)
            for to in linked[first]:
                a, b = name(own), name(groups[to])
                if a != b:
                    names[max(a, b)] = min(a, b)
                    links.append((key, keys[to]))
    return pa.table({c: pa.array([x[k] for x in links], pa.int64()) for k, c in enumerate(("a", "b"))})


def few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows by count; else as it is, for a shuffled join. For cut tables."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def matrix(members: DataFrame, about: DataFrame) -> DataFrame:
    """The matrix: piece, low, high (sizes of its sets), most (packed bins), many (number of its sets). members: piece, key."""
    rows = members.join(about, "key").groupBy("piece").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.collect_list("bins").alias("bins"))
    return rows.select("piece", "low", "high", F.pandas_udf(most_in_bins, "binary")("bins").alias("most"), F.size("bins").alias("many"))


def sizes_allow(low: str, high: str, to_low: str, to_high: str):
    return (F.col(high) * 100 >= F.col(to_low) * PERCENT) & (F.col(to_high) * 100 >= F.col(low) * PERCENT)


def each_once(texts: DataFrame, repeats: DataFrame) -> DataFrame:
    """Texts by doc_id and text_hash, of repeated rows (their keys, by d and h) one: copies are dropped where they are before any is moved."""
    same = texts["doc_id"].eqNullSafe(repeats["d"]) & (texts["text_hash"] == repeats["h"])
    often = texts.join(repeats, same, "left_semi").groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    return texts.join(repeats, same, "left_anti").unionByName(often)


def try_pieces(trials: DataFrame, members: DataFrame, rows: DataFrame, classes: DataFrame, texts: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """Links (a, b) among trials (key, piece): matrix bound first, then the qualifying pieces are opened. members: piece, key; rows: their matrix; classes: with the `group` that each is known to be in."""
    own = classes.select("key", F.col("n").alias("low"), F.col("n").alias("high"), "bins")
    asked = trials.join(own, "key").join(rows.select("piece", F.col("low").alias("to_low"), F.col("high").alias("to_high"), F.col("most").alias("to_bins")), "piece").filter(sizes_allow("low", "high", "to_low", "to_high"))
    left = cut(asked.select("key", "piece", "low", "high", "bins", "to_low", "to_high", "to_bins").mapInArrow(bounded(["key", "piece"]), "key long, piece long"))
    opened = left.groupBy("piece").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(SLICE))).cast("long").alias("slices"))
    queries = left.join(opened, "piece").select("key", "piece", F.pmod(F.xxhash64("key"), "slices").alias("slice"), F.lit(True).alias("query"))
    inside = members.join(opened, "piece").select("key", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(False).alias("query"))
    roles = cut(queries.unionByName(inside).join(classes.select("key", "group", "doc_id", "text_hash"), "key"))
    # Texts travel, not their tokens: these take more than twice the room. They travel once, to their trials, and only those of a round lie on disks at a time.
    rounds = rounds_for(roles.count())
    texts, links = (texts if repeats is None else each_once(texts, repeats)).select("doc_id", "text_hash", "text"), None
    for k in range(rounds):
        own = roles.filter(F.pmod(F.xxhash64("piece", "slice"), F.lit(rounds)) == k)
        same = texts["doc_id"].eqNullSafe(own["doc_id"]) & (texts["text_hash"] == own["text_hash"])
        asked = texts.join(few(own), same).select(own["key"], own["group"], "piece", "slice", "query", "text")
        found = asked.groupBy("piece", "slice").applyInArrow(open_piece, "a long, b long")
        found = found if rounds == 1 else cut(found)
        links = found if links is None else links.unionByName(found)
    return links


def rounds_for(rows: int) -> int:
    """Rounds in which so many rows are joined with texts: as many as let a round's rows be sent along, so that the texts need no shuffle for the join, or a few with a shuffled join where that would be more than ROUNDS."""
    if rows <= BROADCAST:
        return 1
    enough = -(-2 * rows // max(BROADCAST, 1))
    return enough if enough <= ROUNDS else SHUFFLED


def most_in_bins(bins: pd.Series) -> pd.Series:
    return bins.map(lambda rows: np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, BINS).max(axis=0).tobytes())


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """key -> group, the smallest key that it reaches by links (a, b). links may come out otherwise when they are made again, so both directions come from one reading. Each round hangs every node below the smallest node near it, then shortens the paths; rounds grow with the logarithm of the longest path."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(links.select(F.explode(both).alias("x")).select("x.a", "x.b").distinct())
    group = cut(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("group")))
    while True:
        near = edges.join(group, edges["b"] == group["key"]).groupBy(F.col("a").alias("near")).agg(F.min("group").alias("low"))
        hung = group.join(near, F.col("key") == F.col("near")).select("key", F.col("group").alias("was"), F.least("group", "low").alias("group"))
        # The smallest name that any member of a group saw goes to the whole group.
        names = hung.groupBy("was").agg(F.min("group").alias("name"))
        step = cut(hung.join(names, "was").select("key", "was", F.least("group", "name").alias("group")))
        jump = step.select(F.col("key").alias("up"), F.col("group").alias("top"))
        after = cut(step.join(jump, step["group"] == jump["up"], "left").select("key", "was", F.least("group", F.coalesce("top", "group")).alias("group")))
        moved = after.filter("group <> was").limit(1).count()
        group = after.select("key", "group")
        if not moved:
            break
    return nodes.join(group, "key", "left").select("key", F.coalesce("group", "key").alias("group"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, and group: the key of its component, which no other has even where ids repeat or are null (null without shingles)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    n_bytes = text_bytes(docs)
    shards = max(1, -(-n_bytes // SHARD_BYTES))

    context, packed = docs.sparkSession.sparkContext, ("shard", "keys", "owners", "tokens")
    passed = cut(texts.mapInArrow(described(context.broadcast(NONE), shards), f"{ABOUT}, {PACKED}"))
    about_documents = passed.filter("shard is null").select("doc_id", "text_hash", "n", "key", "bins")
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    classes = cut(about_documents.filter("n > 0").groupBy("key", "n").agg(F.min(F.struct(first.alias("first"), "bins")).alias("x")).select("key", "n", "x.first.doc_id", "x.first.text_hash", "x.bins"))
    nodes = classes.select("key")
    # A class's text is opened once, however many rows repeat it.
    repeats = cut(about_documents.filter("n > 0").groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("d", "h"))
    repeats = few(repeats) if repeats.limit(1).count() else None

    # Tokens frequent in prefixes come last in the order. That changes only the prefixes that have one; these are made anew.
    plain = passed.filter("shard is not null").select(*packed, F.lit(False).alias("again"))
    frequent = cut(plain.groupBy("shard").applyInPandas(frequent_tokens, "token long, times long, key long"))
    late = frequent.filter("token is not null").orderBy(F.desc("times"), "token").limit(HOT).select("token").toPandas()["token"].to_numpy()
    hot = context.broadcast(np.sort(late.astype(np.int64).view(np.uint64)))
    affected = cut(frequent.filter("key is not null").select("key").distinct().join(classes, "key").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")))
    few_affected = affected.count() <= BROADCAST
    # Where they are too many to send along, all texts' prefixes are made anew rather than the texts moved.
    some = texts.join(F.broadcast(affected), texts["doc_id"].eqNullSafe(affected["d"]) & (texts["text_hash"] == affected["h"]), "left_semi") if few_affected else texts
    both = some.mapInArrow(described(hot, shards), f"{ABOUT}, {PACKED}").filter("shard is not null").select(*packed, F.lit(True).alias("again"))
    both = plain.unionByName(both) if few_affected else both
    shared = cut(both.groupBy("shard").applyInPandas(shared_tokens(hot), "token long, key long"))

    # Each class is tried against the class that leads most of its tokens. A token's leader is the class with most shared tokens: of a text and its edited copies, the text.
    weights = shared.groupBy("key").agg(F.count(F.lit(1)).alias("weight"))
    weighed = shared.join(weights, "key")
    leaders = weighed.groupBy("token").agg(F.max(F.struct("weight", "key")).alias("x")).select("token", F.col("x.key").alias("leader"), F.col("x.weight").alias("lead"))
    led = shared.join(leaders, "token").filter("key <> leader").groupBy("key", "leader", "lead").agg(F.count(F.lit(1)).alias("times"))
    trials = cut(led.groupBy("key").agg(F.max_by("leader", F.struct("times", "lead", "leader")).alias("piece")))
    about = classes.select("key", "n", "bins")
    heads = cut(trials.select("piece").distinct())
    alone = heads.select("piece", F.col("piece").alias("key"))
    stars = cut(try_pieces(trials, alone, matrix(alone, about), classes.withColumn("group", F.col("key")), texts, repeats))
    groups = cut(connected(nodes, stars))

    # Pieces of classes that have the same home, those in its group apart from the rest.
    home = F.when(F.col("head").isNotNull(), F.col("key")).otherwise(F.coalesce("piece", "key"))
    homes = weights.select("key").join(trials, "key", "left").join(heads.select(F.col("piece").alias("key"), F.lit(True).alias("head")), "key", "left").select("key", home.alias("home"))
    homes = cut(homes.join(groups, "key").join(groups.select(F.col("key").alias("home"), F.col("group").alias("home_group")), "home").select("key", "home", "group", (F.col("group") == F.col("home_group")).alias("inside")))
    sizes = homes.groupBy("home", "inside").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(PIECE))).cast("long").alias("parts"))
    placed = cut(homes.join(sizes, ["home", "inside"]).select("key", "group", F.xxhash64("home", "inside", F.pmod(F.xxhash64("key"), "parts")).alias("piece")))
    members = placed.select("piece", "key")

    # A token tells of two pieces, or of one with itself, if it is in prefixes of different groups there.
    known = shared.join(placed, "key").groupBy("token", "piece").agg(F.min("group").alias("x"), F.max("group").alias("y"))
    mixed = known.groupBy("token").agg(F.min("x").alias("x"), F.max("y").alias("y")).filter("x <> y").select("token")
    known = cut(known.join(mixed, "token", "left_semi"))
    other = known.select("token", F.col("piece").alias("to"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    one = (F.col("x") == F.col("y")) & (F.col("to_x") == F.col("to_y")) & (F.col("x") == F.col("to_x"))
    pairs = known.join(other, (known["token"] == other["token"]) & (F.col("piece") <= F.col("to")) & ~one).select("piece", "to").distinct()
    rows = cut(matrix(members, about))
    pairs = pairs.join(rows.toDF("piece", "low", "high", "bins", "many"), "piece").join(rows.toDF("to", "to_low", "to_high", "to_bins", "to_many"), "to").filter(sizes_allow("low", "high", "to_low", "to_high"))
    # The smaller piece's classes ask the larger piece.
    turned = F.col("to_many") < F.col("many")
    ask, answer = F.when(turned, F.col("to")).otherwise(F.col("piece")), F.when(turned, F.col("piece")).otherwise(F.col("to"))
    pairs = pairs.select(ask.alias("piece"), answer.alias("to"), "low", "high", "bins", "to_low", "to_high", "to_bins").mapInArrow(bounded(["piece", "to"]), "piece long, to long")
    across = cut(pairs).join(members, "piece").select("key", F.col("to").alias("piece"))
    more = try_pieces(across, members, rows, classes.join(groups, "key"), texts, repeats)
    whole = connected(nodes, stars.unionByName(more))

    named = classes.join(whole, "key").select("key", "n", "group", "doc_id")
    names = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    by_class = named.join(names, "group").select(F.col("key").alias("class_key"), F.col("n").alias("class_n"), "component_id", "group")
    with_words, without = about_documents.filter("n > 0"), about_documents.filter("n = 0")
    found = with_words.join(few(cut(by_class)), (F.col("key") == F.col("class_key")) & (F.col("n") == F.col("class_n")))
    wordless = without.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    return found.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "group").unionByName(wordless)


def op8_join_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "group")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
  SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""
