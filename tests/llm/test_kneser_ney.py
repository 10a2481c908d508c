"""The quality classifier against a plain implementation of interpolated modified Kneser-Ney."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from weftline.llm import kneser_ney as kn

DOCS = "doc_id long, lang string, text string, extra string"


def brute_force(texts, order):
    """context tuple, word -> probability."""
    raw = [None, *[Counter() for _ in range(order)]]
    for t in texts:
        seq = ["<s>", *t.lower().split(), "</s>"]
        for n in range(1, order + 1):
            for i in range(max(n - 1, 1), len(seq)):
                raw[n][tuple(seq[i - n + 1 : i + 1])] += 1
    adjusted = [None, *[dict(raw[n]) for n in range(1, order + 1)]]
    for n in range(1, order):
        before = Counter(g[1:] for g in raw[n + 1])
        adjusted[n] = {g: c if n > 1 and g[0] == "<s>" else before.get(g, c) for g, c in raw[n].items()}
    cut = [None]
    for n in range(1, order + 1):
        cc = Counter(adjusted[n].values())
        cut.append(kn.discounts(cc[1], cc[2], cc[3], cc[4]))
    less = lambda n, a: cut[n][min(a, 3) - 1]
    totals, spare = defaultdict(float), defaultdict(float)
    for n in range(1, order + 1):
        for g, a in adjusted[n].items():
            totals[g[:-1]] += a
            spare[g[:-1]] += less(n, a)

    def p(context, word):
        context = context[-(order - 1) :]
        lower = p(context[1:], word) if context else 1 / (len(adjusted[1]) + 1)
        if not totals.get(context):
            return lower
        a = adjusted[len(context) + 1].get((*context, word), 0)
        return max(a - less(len(context) + 1, a), 0) / totals[context] + spare[context] / totals[context] * lower if a else spare[context] / totals[context] * lower

    return p, {g[0] for g in adjusted[1]}


TEXTS = ["the cat sat on the mat", "the cat ate the rat the cat sat", "a dog sat on the mat and the cat sat on it", "The dog ate", "on the mat on the mat on the rat", "one", "cat cat cat dog"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_perplexity_is_that_of_the_plain_model(spark, order):
    p, words = brute_force(TEXTS, order)
    for context in [("<s>",), ("the",), ("on", "the"), ("dog", "zzz")]:
        assert sum(p(context, w) for w in words) + p(context, "zzz") == pytest.approx(1)
    asked = [*TEXTS, "the cat flew", "zzz", "mat the on sat", "it", "the cat sat on the rat and the dog", None, "", " \n "]
    trusted = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    docs = spark.createDataFrame([(i, "en", t, "x") for i, t in enumerate(asked)], DOCS)
    got = {r["doc_id"]: r for r in kn.perplexities(docs, trusted, order).collect()}
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        seq = ["<s>", *(t or "").lower().split(), "</s>"]
        if len(seq) == 2:
            assert got[i]["perplexity"] is None and got[i]["n_words"] == 0
            continue
        total = sum(math.log(p(tuple(seq[max(0, j - order + 1) : j]), seq[j])) for j in range(1, len(seq)))
        assert got[i]["perplexity"] == pytest.approx(math.exp(-total / (len(seq) - 1)), rel=1e-9)


def test_look_ups_by_shard_give_the_same_as_those_at_hand(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "en", t, "x") for i, t in enumerate([*TEXTS, "the cat flew"])], DOCS)
    whole = {r["doc_id"]: r["perplexity"] for r in kn.perplexities(docs, docs).collect()}
    monkeypatch.setattr(kn, "HOT", 0)
    monkeypatch.setattr(kn, "PER_SHARD", 8)
    monkeypatch.setattr(kn, "SLICE_BYTES", 64)
    dealt = {r["doc_id"]: r["perplexity"] for r in kn.perplexities(docs.repartition(3), docs).collect()}
    assert dealt == pytest.approx(whole)


def test_odd_rows(spark):
    rows = [(i, None if i % 2 else "en", TEXTS[i % len(TEXTS)], "x") for i in range(200)]
    rows += [(None, "en", "the cat", "x"), (7, "en", None, "x"), (7, "en", "", "x"), (7, "en", "the " * 50_000, "x"), (900, "en", "%% $$ ## @@ ## $$ zz qq", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(i, 1, 0) for i in range(200)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = kn.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r["keep"] for r in got if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] != 7)
    assert [r["keep"] for r in got if r["doc_id"] == 900] == [False]
    assert sorted(r["keep"] for r in got if r["doc_id"] == 7 and not r["n_words"]) == [False, False]
    assert kn.classify(docs.limit(0), labels).count() == 0
    assert all(r["keep"] == bool(r["n_words"]) for r in kn.classify(docs, labels.limit(0)).collect())


def test_the_model_learns_from_all_trusted_documents(spark):
    docs = spark.createDataFrame([(i, "en", f"w{i} x{i % 7} y{i % 11}", "x") for i in range(1600)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1600)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["perplexity"] for r in kn.classify(docs, labels).collect()}
    trusted = docs.filter("pmod(xxhash64(5, doc_id), 4) <> 0")
    assert trusted.count() > 1100
    assert got == pytest.approx({r["doc_id"]: r["perplexity"] for r in kn.perplexities(docs, trusted).collect()})


def test_rounds_keep_less_on_disk_than_the_text_and_give_the_plain_model(spark, monkeypatch):
    draw = random.Random(3)
    texts = [" ".join(f"word{int(draw.random() ** 2 * 300)}" for _ in range(draw.randrange(1, 400))) for _ in range(150)]
    size = sum(map(len, texts))
    trusted = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    docs = spark.createDataFrame([(i, "en", t, "x") for i, t in enumerate([*texts[:9], "word1 unseen word2 word3 word4"])], DOCS)
    written, cut = [], kn.cut

    def weighed(df):
        folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if spark.sparkContext.getCheckpointDir() else None
        known = set(folder.rglob("part-*")) if folder else set()
        out = cut(df)
        folder = folder or Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
        written.append(sum(p.stat().st_size for p in set(folder.rglob("part-*")) - known))
        return out

    monkeypatch.setattr(kn, "cut", weighed)
    monkeypatch.setattr(kn, "ROUNDS", 5, raising=False)
    monkeypatch.setattr(kn, "ROUND_BYTES", 1 << 8, raising=False)
    monkeypatch.setattr(kn, "PER_SHARD", 1 << 10)
    monkeypatch.setattr(kn, "BITS", 1 << 10)
    monkeypatch.setattr(kn, "HOT", 40)
    got = {r["doc_id"]: r["perplexity"] for r in kn.perplexities(docs, trusted).collect()}
    assert 0 < max(written) < 1.5 * size
    p, _ = brute_force(texts, 3)
    for r in docs.collect():
        seq = ["<s>", *r["text"].split(), "</s>"]
        total = sum(math.log(p(tuple(seq[max(0, j - 2) : j]), seq[j])) for j in range(1, len(seq)))
        assert got[r["doc_id"]] == pytest.approx(math.exp(-total / (len(seq) - 1)), rel=1e-9)
