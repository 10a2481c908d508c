"""Operators with their bounds lowered, so that small tables need several ranges, pieces, shards, slices and blocks; and the pipeline against a plain version."""

import hashlib
import math
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import attention_lm, chat_format, common, decontaminate, jaccard_join, kneser_ney, language_id, line_dedup, mixing, search

DATA = "/root/testdata/sf0.001"
UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text):
    return (text or "").encode().translate(UPPER).split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(ids, sets):
    """Smallest id that each id reaches by links."""
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    held = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            held[s].append(i)
    for a, b in {p for own in held.values() for p in combinations(sorted(own), 2)}:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def test_ranges_stay_even_where_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 500)
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise(None).alias("source"), F.when(F.col("id") % 2 == 0, F.lit("one two three")).otherwise(F.concat(F.lit("w "), "id")).alias("text"))
    got = mixing.mix(rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"), F.count(F.lit(1)).alias("rows")).collect()
    assert sum(r["rows"] for r in got) == 20_000 and all(r["taken"] == math.floor(r["target"]) and r["over"] <= 0 for r in got)
    kept = []
    monkeypatch.setattr(mixing, "cut", lambda df, f=mixing.cut: kept.append(f(df)) or kept[-1])
    whole = mixing.mixed_texts(rows).agg(F.sum("epoch_words")).first()[0]
    assert whole == sum(r["taken"] for r in got)
    sizes = [r["count"] for df in kept if "range" in df.columns and "row" in df.columns for r in df.groupBy("source", "range").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 3000


def test_another_template_reads_back(spark):
    template = chat_format.Template(opening="[[{role}|", closing="]]end\n", moves={("start", "user"): "asked", ("asked", "assistant"): "answered"}, controls=("[[", "]"))
    turns = [(1, 0, "user", "a [[user| b ]]end\n \\ c"), (1, 1, "assistant", "]]end\n[[x|]"), (2, 0, "u|s[er", None), (2, 1, None, "["), (3, 0, "user", "{role} <turn:user> {x}")]
    rows = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chat(rows, template), template).collect()}
    for conv, own in ((c, [t for t in turns if t[0] == c]) for c in (1, 2, 3)):
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert got[conv]["n_turns"] == len(own)
    assert got[1]["valid"] and not got[2]["valid"] and got[1]["loss_chars"] == len(turns[1][3])
    bare = "".join(r["text"] for r in chat_format.format_chat(rows.filter("conv_id = 1 and turn = 1"), template).collect())
    assert bare.count("]]end") == 1
    for wrong in ({"controls": ("<turn",)}, {"opening": "<turn:{role}"}, {"closing": "##END", "controls": ("<turn", "##")}, {"closing": "]]end", "controls": ("<turn", "]]")}):
        with pytest.raises(ValueError):
            chat_format.Template(**wrong)


def test_lines_in_several_slices(spark, monkeypatch):
    texts = [f"often\nalone {i}\n often " for i in range(40)] + ["same\ntext"] * 30 + ["rare"] * 9
    docs = spark.createDataFrame([(None if i % 10 == 0 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = sorted(hashlib.sha256("\n".join(x for x in t.split("\n") if x.strip() not in ("often", "same", "text")).encode()).hexdigest() for t in texts)
    monkeypatch.setattr(line_dedup, "PROBES_PER_SLICE", 7)
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 5)
    assert sorted(hashlib.sha256(r["lines"]["kept"].encode()).hexdigest() for r in line_dedup.dedup_lines(docs).collect()) == want


def test_search_in_many_shards_and_blocks_of_queries(table, monkeypatch):
    docs = {r["doc_id"]: Counter(words(r["text"])) for r in table.collect()}
    df = Counter(w for c in docs.values() for w in c)
    mean, n = sum(sum(c.values()) for c in docs.values()) / len(docs), len(docs)
    idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    want = []
    for q in (i for i in docs if i % 20 == 0):
        scores = {i: round(sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in docs[q] if w in c), 5) for i, c in docs.items()}
        want += [(q, s) for i, s in sorted(((i, s) for i, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:10]]
    for name, value in (("SHARD_BYTES", 60_000), ("QUERIES", 3), ("OPEN", 2), ("MOST_COMMON", 20), ("TERM_SHARD_BYTES", 100_000), ("BATCH", 2)):
        monkeypatch.setattr(search, name, value)
    got = search.search(table.select("doc_id", "text").repartition(9), table.select("doc_id", "text").filter("doc_id % 20 = 0")).collect()
    assert sorted((r["query_id"], round(r["score"], 3)) for r in got) == sorted((q, round(s, 3)) for q, s in want)


def test_near_duplicates_across_small_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]

    def changed(source, n):
        out = list(source)
        for at in rng.choice(len(out), n, replace=False):
            out[at] = f"x{rng.integers(1 << 30)}"
        return " ".join(out)

    other = base[:30] + [f"v{k}" for k in range(30)]
    texts = [" ".join(base), *[changed(base, k % 4) for k in range(60)], *[changed(other, k % 3) for k in range(30)], *[" ".join(base[:20] + [f"u{i}_{k}" for k in range(8)]) for i in range(15)], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = components(range(len(texts)), {i: shingles(t) for i, t in enumerate(texts)})
    for pieces in (4, 256):
        monkeypatch.setattr(jaccard_join, "PIECE", pieces)
        monkeypatch.setattr(jaccard_join, "SLICE", 3)
        assert {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()} == want


def test_leaks_in_size_partitions(spark):
    rng = np.random.default_rng(6)
    word = lambda: f"t{rng.integers(400)}"
    items = [" ".join(word() for _ in range(n)) for n in (5, 6, 9, 12, 20, 40, 90, 200)]
    texts = [" ".join([word() for _ in range(30)] + item.upper().split()[: max(5, int(len(item.split()) * part))] + [word() for _ in range(30)]) for item in items for part in (1, 0.9, 0.8, 0.5)]
    sides = [[(i, t) for i, t in enumerate(x)] for x in (texts, items)]
    docs, bench = spark.createDataFrame(sides[0], "doc_id long, text string"), spark.createDataFrame(sides[1], "item_id long, text string")
    want = [(i, k) for (i, t), (k, item) in product(*sides) if 5 * len(shingles(t) & shingles(item)) >= 4 * len(shingles(item))]
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_contained(docs, bench).collect()) == sorted(want)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_contained(docs, bench, block=60).collect()) == sorted(want)


def test_forward_backward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(2)
    emit, moves = rng.random((5, 3)), rng.random((3, 3))
    lengths = np.array([3, 2])
    place, active = language_id.packed_order(lengths)
    packed = np.empty_like(emit)
    packed[place] = emit
    post, _, _ = language_id.forward_backward(packed, moves, active)
    start = 0
    for n in lengths:
        own, total = np.zeros((n, 3)), 0
        for path in product(range(3), repeat=int(n)):
            weight = np.prod([emit[start + t, c] for t, c in enumerate(path)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:])])
            total += weight
            own[range(n), path] += weight
        np.testing.assert_allclose(post[place][start : start + n], own / total, rtol=1e-9)
        start += n


def test_language_of_held_out_documents(table):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    found = language_id.identify(table, language_id.fold("doc_id", 4) != 2).collect()
    own = [r for r in found if held(r["doc_id"]) and r["lang"] and len(words(r["text"])) >= 5]
    assert len(own) > 20 and sum(r["language"]["lang_pred"] == r["lang"] for r in own) >= 0.95 * len(own)
    assert all(0 <= r["language"]["score"] <= 1 for r in found)


def test_more_than_64_languages(spark):
    letter = "abcdefghijklmnopqrst"
    texts = [(k, " ".join(f"{letter[k % 20]}{letter[k // 20]}{letter[j]}" for j in (i, 19 - i, (i * 7) % 20)) * 3, f"l{k:02}") for k in range(70) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    found = language_id.identify(docs).collect()
    assert len({r["language"]["lang_pred"] for r in found}) > 64


def test_the_language_model_beats_the_base_on_known_words(spark):
    # What follows a word depends on it; both models know all words.
    rng = np.random.default_rng(3)
    after = rng.permutation(40)
    texts = []
    for _ in range(400):
        w = [int(rng.integers(40))]
        for _ in range(30):
            w.append(int(after[w[-1]]) if rng.random() < 0.9 else int(rng.integers(40)))
        texts.append(" ".join(f"k{x}" for x in w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = [r for r in attention_lm.score(docs, attention_lm.fold("doc_id", 5) == 1).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert gain > 0.2, gain


def test_quality_agrees_with_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = kneser_ney.classify(docs, labels).join(labels, "doc_id").filter("toxic = 0").select("quality", "keep").collect()
    kept = lambda q: np.mean([r["keep"] for r in found if r["quality"] == q])
    assert kept(1) >= 0.95 and kept(0) <= 0.15, (kept(1), kept(0))


def test_pipeline_against_a_plain_version(spark, table):
    """From what language ID keeps on, each stage is done again in Python."""
    bench = [shingles(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bench = [b for b in bench if b and len(next(iter(b))) == 5]
    now, stages = corpus_pipeline.language_stage(spark, table, DATA).cache(), dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    mine = [r for r in table.collect() if r["lang"] and len(words(r["text"])) >= 20]
    assert len([r for r in mine if r["doc_id"] in texts]) >= 0.97 * len(mine)
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").translate(UPPER)
    seen = Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")} if k)
    texts = {i: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10) for i, t in texts.items()}
    group = components(texts, {i: shingles(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if group[i] == i}
    texts = {i: t for i, t in texts.items() if not any(5 * len(b & shingles(t)) >= 4 * len(b) for b in bench)}
    for name in ("line_dedup", "near_duplicates", "decontamination"):
        now = stages[name](spark, now, DATA).cache()
    assert {r["doc_id"]: r["text"] for r in now.collect()} == texts
    mixed, plan = stages["mixing"](spark, now, DATA).collect(), mixing.mix(now).collect()
    assert Counter((r["doc_id"]) for r in mixed for _ in range(r["epoch_words"])) == Counter({r["doc_id"]: r["taken"] for r in plan if r["taken"]})
    empty = table.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
        assert empty.count() == 0, name


def test_token_sets_of_long_texts_and_long_words():
    tokens_of, long = jaccard_join.Shingler(), jaccard_join.LONG
    words = ["A", "b", "é\x85", "x" * long, "x" * (long + 1), "y" * (3 * long), "Zz"]
    text = " \n".join(words[i * i % len(words)] + str(i % 5) for i in range(2000))
    plain = [w.lower() for w in text.split(" \n")]
    hashes = tokens_of.hashes(text)
    assert len(hashes) == 2000 and len(set(zip(plain, hashes.tolist()))) == len(set(plain)) == len(set(hashes.tolist()))
    assert len(tokens_of(text)) == len({tuple(plain[i : i + 5]) for i in range(1996)})
    assert (tokens_of("q " + " ".join(words[3:6])) == tokens_of(" ".join(["Q", *words[3:6]]) + "\t")).all() and len(tokens_of(" ")) == len(tokens_of(None)) == 0


def morse(letters, bits):
    word = letters[0]
    for _ in range(bits):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


def test_words_that_collide_in_polynomials_stay_apart(spark):
    tokens_of = jaccard_join.Shingler()
    for bits in (3, 6, 10, 12):  # Thue-Morse words and their complements agree modulo powers of two under any odd base
        assert len(set(tokens_of.hashes(f"{morse('ab', bits)} {morse('ba', bits)}").tolist())) == 2
    texts = [" ".join([morse(x, 10)] * 5) for x in ("ab", "ba")]
    found = jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {0: 0, 1: 1}


def test_rows_that_repeat_are_opened_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    rows = rows.unionByName(spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(f"{text} w1000").alias("text")))
    rows = rows.unionByName(spark.createDataFrame([(0, f"w2000 {text}"), (5, "another text of six words here")], "doc_id long, text string"))
    found = {(r["doc_id"], r["component_id"]): r["count"] for r in jaccard_join.near_duplicates(rows.repartition(8)).groupBy("doc_id", "component_id").count().collect()}
    assert found == {(1, 0): 100_000, (None, 0): 100_000, (0, 0): 1, (5, 5): 1}


def test_languages_whose_rows_repeat_are_learned(spark):
    english, german = "the quick brown fox jumps over the lazy dog while rain falls", "der schnelle braune fuchs springt über den faulen hund während regen fällt"
    for k in range(4):
        rows = spark.range(3000).select(F.lit(10**6 + k).alias("doc_id"), F.lit(f"{german} {k}").alias("text"), F.lit("de").alias("lang"))
        rows = rows.unionByName(spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{english} "), F.col("id") + k).alias("text"), F.lit("en").alias("lang")))
        sample = Counter(lang for lang, _ in language_id.training_sample(rows, F.lit(True), 50, 100, 10))
        assert sample == {"de": 1, "en": 50}


def test_links_that_come_out_otherwise_when_they_are_made_again(spark):
    """Each reading of the links gives other stars over the same parts, as links between pieces do whose rows come in another order."""

    def stars(frames):
        rng = np.random.default_rng()
        for frame in frames:
            for part in frame["id"]:
                head = int(rng.integers(9))
                yield pd.DataFrame({"a": [part * 9 + k for k in range(9) if k != head], "b": part * 9 + head})

    nodes, links = spark.range(360).select(F.col("id").alias("key")), spark.range(40).mapInPandas(stars, "a long, b long")
    assert {r["key"]: r["group"] for r in jaccard_join.connected(nodes, links).collect()} == {k: k // 9 * 9 for k in range(360)}


def test_a_cut_leaves_no_shuffled_files(spark):
    files = lambda: set(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))
    old, texts = files(), spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").cast("string").alias("t"))
    rows = common.cut(texts.groupBy("k").agg(F.max("t").alias("t")))
    for _ in range(50):
        if not (left := files() - old):
            break
        time.sleep(0.1)
    assert not left and rows.count() == 7


def test_near_duplicates_too_many_to_send_along(spark, monkeypatch):
    base = " ".join(f"w{k}" for k in range(40))
    texts = [f"{base} v{i % 7} x{i}" for i in range(60)] + [f"{base[:60]} u{i}" for i in range(20)] + [base, base, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "BROADCAST", 0)
    found = jaccard_join.near_duplicates(docs)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == components(range(len(texts)), {i: shingles(t) for i, t in enumerate(texts)})


def test_texts_go_to_their_trials_in_rounds(spark, monkeypatch):
    """Rows of trials that are too many to send along go in rounds; no round joins all texts by a shuffle."""
    base = [" ".join(f"w{g}_{k}" for k in range(40)) for g in range(12)]
    texts = [f"{base[i % 12]} x{i}" for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    joined, few = [], jaccard_join.few
    monkeypatch.setattr(jaccard_join, "BROADCAST", 100)
    monkeypatch.setattr(jaccard_join, "few", lambda df: (joined.append(df.count()) if "slice" in df.columns else None, few(df))[1])
    found = jaccard_join.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i % 12 for i in range(240)}
    assert sum(joined) > 200 and max(joined) <= 100 and len(joined) >= 5


def test_a_search_leaves_alone_what_only_its_block_could_raise():
    import pyarrow as pa

    texts = ["alpha beta gamma delta", "alpha", *[f"w{i} v{i}" for i in range(98)]]
    terms, docs, counts, lengths = search.term_counts(texts)
    starts = search.runs(terms)
    row = {"ids": np.arange(100), "missing": np.zeros(100, bool), "terms": terms[starts], "starts": starts, "docs": docs.astype(np.int32), "counts": counts.astype(np.int32), "lengths": lengths.astype(np.int32)}
    shard = search.Shard({k: pa.scalar(v.tobytes()) for k, v in row.items()}, 2.0)
    asked = np.sort(search.term_counts(texts[:1])[0])
    one = lambda limit: next(shard.search(asked, np.arange(4), np.array([0, 4]), np.ones(4), np.array([limit]), 10))
    assert sorted(one(-1.0)[0]) == [0, 1] and list(one(2.0)[0]) == [0]
    assert [search.turns(n) for n in (1, 2, 5, 33)] == [[1], [1, 2], [1, 3, 5], [1, 6, 33]]


def test_a_training_step_is_the_gradient_and_keeps_little_in_memory():
    import tracemalloc

    rng, pad = np.random.default_rng(5), attention_lm.INPUTS
    counts = np.ones(500)
    plan = attention_lm.Plan(np.arange(500), np.arange(500) % 130, np.zeros(500), 1)
    p = plan.weights(counts)
    p["R"] = rng.normal(0, 0.3, len(p["R"])).astype(np.float32)
    window, aim = rng.integers(0, 500, (768, 2 * attention_lm.STRIDE)), rng.integers(0, 130, (768, attention_lm.STRIDE))
    window[::7, : attention_lm.STRIDE], aim[5, 9:] = pad, -1
    tracemalloc.start()
    whole = attention_lm.gradients(p, window, aim, pad)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20, peak

    def loss(p):
        p = {k: v.astype(float) for k, v in p.items()}
        x = p["E"][window]
        now, distance = x[:, attention_lm.STRIDE :], attention_lm.DISTANCE
        s = (now @ p["Q"]) @ (x @ p["K"]).transpose(0, 2, 1) * attention_lm.WIDTH**-0.5 + p["R"][np.maximum(distance, 0)]
        s = np.where((distance >= 0) & (window != pad)[:, None, :], np.exp(s), 0)
        h = np.maximum(s / s.sum(axis=2, keepdims=True) @ (x @ p["V"]) + now @ p["U"] + p["z"], 0) @ p["W"] + p["b"]
        log_p = np.take_along_axis(h - np.log(np.exp(h).sum(axis=2, keepdims=True)), np.maximum(aim, 0)[:, :, None], 2)[:, :, 0]
        return -log_p[aim >= 0].mean()

    for name, grad in whole.items():
        step = np.sign(grad) * 1e-4
        change = loss({**p, name: p[name].astype(float) + step}) - loss({**p, name: p[name].astype(float) - step})
        assert change == pytest.approx(2e-4 * np.abs(grad).sum(), rel=2e-2), name
