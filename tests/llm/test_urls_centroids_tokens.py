"""URL filter, centroid clustering and token alignment on small odd tables, each against a plain version in Python."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.llm import centroids, token_alignment, url_filter

# --- URL filter


def plain_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:stop]


def plain_rule(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "HTTPS://WWW.Example.ORG/es/1?x#y", "http://example.org/en/12#/es/", "http://example.org/en/2", "http://notexample.org/es/", "ftp://a.b.com/fr/?q", "x://com/de/a",
    "http://b.com?/de/", "http://b.com#/fr/", "http://user@b.com:80/de/1", "http://b.com:80/x", "http://É.com/fr/", "a://b://c.com/de/", "http://10.0.0.1/x", "http://[::1]:8/x", "http://shop.co.uk/x", "http://a.shop.co.uk/x", "http://org./x", "http://xorg/",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "h", "x", "y", 1, 2.0) for i, u in enumerate(URLS)] + [(None, "http://example.org/es/", "h", "x", "y", 1, 2.0), (5, URLS[5], "h", "x", "y", 1, 2.0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string, n long, mean double")


def test_rules_as_one_expression_and_as_a_join(spark, pages, monkeypatch):
    parted = url_filter.with_parts(pages.select("page_id", "url"))
    rules = [*url_filter.RULES, ("block", "com", "/"), ("allow", "b.com", "/x"), ("block", "co.uk", "")]
    for given in (url_filter.RULES, rules):
        for most in (64, 0):
            monkeypatch.setattr(url_filter, "MOST_INLINE", most)
            found = url_filter.with_rule(parted, given).collect()
            assert len(found) == len(URLS) + 2
            for r in found:
                assert (r["host"], r["path"]) == plain_host(r["url"])
                assert (tuple(r["listed"]) if r["listed"] else (None, None)) == plain_rule(r["host"], r["path"], given)


def test_domains(spark):
    asked = {"a.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.c.com": ("c.com", "com"), "com": ("com", ""), "10.0.0.1": ("10.0.0.1", ""), "[::1]": ("[::1]", ""), "": ("", "")}
    found = url_filter.with_domain(spark.createDataFrame([(a,) for a in asked], "address string")).collect()
    assert {r["address"]: (r["domain"], r["suffix"]) for r in found} == asked


def shrink(groups, above):
    left = {g: (above[g][0] - k, above[g][1] - (n - k)) for g, (n, k) in groups.items()}
    mean = {g: a / (a + b) for g, (a, b) in left.items()}
    top = sum((k - n * mean[g]) ** 2 - n * mean[g] * (1 - mean[g]) for g, (n, k) in groups.items())
    under = sum(n * (n - 1) * mean[g] * (1 - mean[g]) for g, (n, k) in groups.items())
    shared = top / under if under else None
    s = url_filter.DEFAULT_STRENGTH if shared is None else url_filter.MOST_STRENGTH if shared <= 0 else min(max(1 / shared - 1, 1), 1000)
    weight = {g: 1 / (1 / s + 1 / sum(left[g])) for g in groups}
    return {g: (weight[g] * mean[g] + k, weight[g] * (1 - mean[g]) + n - k) for g, (n, k) in groups.items()}


def test_reputation_shrinks_and_blocks(spark):
    draw = random.Random(5)
    rows, labels, number = [], [], 0
    for domain, share, count in (("good.com", 0.95, 300), ("bad.com", 0.05, 300), ("fair.net", 0.8, 100), ("one.net", 0.0, 1)):
        for _ in range(count):
            rows.append((number, f"http://h{draw.randrange(3)}.{domain}/en/{number}"))
            labels.append((number, int(draw.random() < share), draw.choice([0, 0, 0, None])))
            number += 1
    rows += [(number, "http://new.bad.com/"), (number + 1, "http://new.good.com/"), (number + 2, None), (None, "http://h0.bad.com/fr/"), (0, rows[0][1])]
    labels += [(0, 0, 0), (10**9, 0, 1), (number + 2, None, None), (None, 0, 0)]
    pages, labels_table = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    outcome = {}
    for d, q, t in labels:
        if q is not None or t == 1:
            outcome[d] = min(outcome.get(d, 1), int(q == 1 and t != 1))
    hosts = {}
    for p, u in rows:
        n, k = hosts.get(plain_host(u)[0], (0, 0))
        known = p is not None and p in outcome
        hosts[plain_host(u)[0]] = (n + known, k + (outcome[p] if known else 0))
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda d: d.split(".")[-1]

    def summed(by, groups):
        found = {}
        for g, (n, k) in groups.items():
            a, b = found.get(by(g), (0, 0))
            found[by(g)] = (a + n, b + k)
        return found

    domains = summed(domain, hosts)
    suffixes = summed(suffix, domains)
    n, k = sum(n for n, _ in suffixes.values()), sum(k for _, k in suffixes.values())
    s = shrink(suffixes, {g: (k + 1, n - k + 1) for g in suffixes})
    d = shrink(domains, {g: s[suffix(g)] for g in domains})
    h = shrink(hosts, {g: d[domain(g)] for g in hosts})
    parted = url_filter.with_parts(pages).select("page_id", "address")
    found = {r["address"]: r for r in url_filter.reputation(parted, url_filter.labelled(labels_table)).collect()}
    assert set(found) == set(h)
    for g, (a, b) in h.items():
        assert (found[g]["n"], found[g]["k"]) == hosts[g]
        assert found[g]["alpha"] == pytest.approx(a) and found[g]["beta"] == pytest.approx(b)
        m = a / (a + b)
        assert found[g]["upper"] == pytest.approx(m + url_filter.BOUND_Z * math.sqrt(m * (1 - m) / (a + b + 1)))
    verdicts = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.labelled(labels_table)).collect()}
    assert verdicts[(number, "new.bad.com", "/")] == (None, "block")  # by its domain alone
    assert verdicts[(number + 1, "new.good.com", "/")] == (None, "allow")
    assert verdicts[(None, "h0.bad.com", "/fr/")] == ("com/fr/", "allow")  # a rule goes first
    assert all(v == (None, "allow") for k, v in verdicts.items() if "one.net" in k[1])  # one bad label isn't enough
    assert url_filter.judge(pages, url_filter.labelled(labels_table)).count() == len(rows)


def test_urls_without_labels_or_pages(spark, pages):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = url_filter.judge(pages, url_filter.labelled(none)).collect()
    assert len(found) == len(URLS) + 2 and all(r["verdict"] == "allow" for r in found if r["rule"] is None)
    assert url_filter.judge(pages.limit(0), url_filter.labelled(none)).count() == 0


# --- centroids


def plain_clusters(rows, number, components, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:number]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    best = lambda v: min((distance(v, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(best(v)[1], []).append(v)
        centres = [[sum(x) // len(mine[k]) for x in zip(*mine[k], strict=True)] if k in mine else c for k, c in enumerate(centres)]
    found = [(i, *best(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, k, d in found:
        inertia[k] += d
    long = lambda x: x if x < 1 << 63 else None
    return [(i, k, long(d), long(inertia[k]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, k, d in found]


def clusters(spark, rows, number, components, rounds, kind="float"):
    table = spark.createDataFrame(rows, f"id long, vector array<{kind}>").withColumn("distance", F.lit("x")).withColumn("cluster", F.lit(1)).repartition(3)
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = centroids.with_inertia(*centroids.cluster(table, key, number, components, rounds))
    return [tuple(r) for r in found.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def test_centroids_equal_exact_arithmetic(spark):
    draw = random.Random(3)
    # Few values, so that many distances tie; and some vectors that repeat.
    rows = [(i, [draw.randrange(-3, 4) / 256 for _ in range(5)]) for i in range(200)] + [(i, [0.0] * 5) for i in range(300, 340)] + [(None, [0.5] * 5), (7, [0.25] * 5)]
    rows += [(900, None), (901, []), (902, [1.0] * 4), (903, [1.0, None, 1.0, 1.0, 1.0]), (904, [float("nan")] * 5), (905, [float("inf")] + [0.0] * 4)]
    assert ordered(clusters(spark, rows, 9, 5, 4)) == ordered(plain_clusters(rows, 9, 5, 4))


def test_centroids_of_wide_values(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice([1e30, -1e30, 2.0**23, 1.5, -3.25e5, 3e9]) * draw.random() for _ in range(3)]) for i in range(60)]
    assert ordered(clusters(spark, rows, 4, 3, 3, "double")) == ordered(plain_clusters(rows, 4, 3, 3))
    calm = [(i, [draw.uniform(-5e5, 5e5) for _ in range(3)]) for i in range(60)]
    assert ordered(clusters(spark, calm, 4, 3, 3, "double")) == ordered(plain_clusters(calm, 4, 3, 3))


def test_few_or_no_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2])]
    assert ordered(clusters(spark, rows, 5, 2, 2)) == ordered(plain_clusters(rows, 5, 2, 2))
    assert clusters(spark, [(1, None)], 5, 2, 2) == []


def test_intervals_hold_the_true_distance():
    draw = np.random.default_rng(6)
    for size in (3, 300, 1 << 20, (1 << 27) - 1):
        v, c = draw.integers(-size, size, (50, 64)), draw.integers(-size, size, (7, 64))
        c[3] = c[1]
        maybe = centroids.screened(v, c)
        for k in range(len(v)):
            exact = [sum((int(a) - int(b)) ** 2 for a, b in zip(v[k], x, strict=True)) for x in c]
            assert all(maybe[k, i] for i in range(7) if exact[i] == min(exact))
        assert maybe.sum() < maybe.size or size == 3
        assert (centroids.nearest(v, c)[0] == [int(np.argmin([sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c])) for x in v]).all()


def test_limbs():
    for total in (0, 1, -1, 1 << 40, -(1 << 90) - 12345, 3**80):
        assert sum(x << (centroids.LIMB * k) for k, x in enumerate(centroids.limbs(total))) == total


# --- token alignment

TEXTS = [
    None, "", " ", "a", "hello world", "hello world", "  two  spaces\n\nand\tlines ", "<|endoftext|> <s> </s> <unk> <0x0A> plain", "naïve café – größe 日本語 🙂 مرحبا", "▁ a piece's own space", "\x00 nul", "word " * 3000, "x" * 2000, " a", "a ", "a\n b\n  c \n d", "a\u00a0 b \u3000c \u2009 d \u200b e", "it 's I 'll x'd !! ?a 1 2  3 '", "▁▁ ▁a ▁", "été " * 50 + "token=ABCDEFGH",
]


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(token_alignment.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=token_alignment.PIECES)
    letters = {}
    spare = 256
    for x in range(256):  # as the library's own decoder has them
        plain = 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x
        letters[chr(x) if plain else chr(spare)] = x
        spare += not plain
    assert decoders.ByteLevel().decode(["".join(c for c, x in letters.items() if 32 <= x < 127)]) == "".join(chr(x) for c, x in letters.items() if 32 <= x < 127)
    found, pairs = [], Counter()
    for text in texts:
        x = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        p = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        q = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in y]
        if not text or b"".join(p) != f" {text}".encode() or b"".join(q) != f" {text}".encode():
            x = y = p = q = []
        spans = []
        for parts in (p, q):
            at, mine = 0, []
            for part in parts:
                mine.append((at, at := at + len(part)))
            spans.append(mine)
        links, i, j = [], 0, 0
        groups, begun = [], (0, 0)
        while i < len(x) and j < len(y):
            links.append((i, j, max(spans[0][i][0], spans[1][j][0]), min(spans[0][i][1], spans[1][j][1])))
            s, t = spans[0][i][1], spans[1][j][1]
            i, j = i + (s <= t), j + (t <= s)
            if s == t:
                groups.append((x[begun[0] : i], y[begun[1] : j]))
                begun = (i, j)
        pairs.update((x[i], y[j]) for i, j, _, _ in links)
        found.append((x, y, links, groups))
    return found, pairs


@pytest.fixture(scope="module")
def aligned(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "hello null world", "x", 1), (4, "hello world", "x", 1), ((1 << 62) + 1, "a large id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, pair long").repartition(2)
    return [r[:2] for r in rows], token_alignment.Alignment(docs, block_letters=500)


def test_alignment(aligned):
    rows, alignment = aligned
    plain, pairs = plain_alignment([t for _, t in rows])
    best = {b: max(n for (_, y), n in pairs.items() if y == b) for _, b in pairs}
    want = []
    for (document, _), (x, y, links, groups) in zip(rows, plain, strict=True):
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        counts = [(pairs[x[i], y[j]], y[j]) for i, j, _, _ in links]
        want.append((document, len(x), len(y), len(groups), len(links), sum(c == best[b] for c, b in counts), sum(c for c, _ in counts), hashlib.sha256(said.encode()).hexdigest() if x else ""))
    assert ordered(tuple(r) for r in alignment.documents().collect()) == ordered(want)
    assert {(r["a"], r["b"]): r["count"] for r in alignment.pairs().collect()} == pairs
    best_a = {a: max(n for (x, _), n in pairs.items() if x == a) for a, _ in pairs}
    assert all(r["best_of_a"] == (r["count"] == best_a[r["a"]]) and r["best_of_b"] == (r["count"] == best[r["b"]]) for r in alignment.pairs().collect())


def test_links_and_groups(aligned):
    rows, alignment = aligned
    plain, _ = plain_alignment([t for _, t in rows])
    links = [(d, i, j, x[i], y[j], s, e) for (d, _), (x, y, found, _) in zip(rows, plain, strict=True) for i, j, s, e in found]
    assert ordered(tuple(r) for r in alignment.links().collect()) == ordered(links)
    groups = [(d, k, *g) for (d, _), (_, _, _, found) in zip(rows, plain, strict=True) for k, g in enumerate(found)]
    got = alignment.groups().collect()
    assert sorted(((r["doc_id"], r["number"], r["a"], r["b"]) for r in got), key=str) == sorted(groups, key=str)
    assert all(r["start"] < r["end"] for r in got)


def test_no_documents(spark):
    none = token_alignment.Alignment(spark.createDataFrame([], "doc_id long, text string"))
    assert none.documents().count() == none.pairs().count() == none.links().count() == 0


def test_digests_of_blocks_come_from_a_table_of_decimals():
    rng, sizes = np.random.default_rng(4), np.array([1, 2, 3] * 4000)
    table = token_alignment.Aligned.decimals(10_001)
    assert [bytes(r[r > 0]).decode() for r in table] == [str(k) for k in range(10_001)]
    sides, want = ([], []), []
    for n in (7, 0, 1, 300):
        own = [list(rng.integers(0, 12_000, n)) for _ in "ab"]
        for x, y in (own, own[::-1]):  # the shorter side ends with tokens of one byte
            x += [0] * max(0, int(sizes[np.array(y, int)].sum() - sizes[np.array(x, int)].sum()))
        ends = [np.cumsum(sizes[np.array(x, int)]).tolist() for x in own]
        both = sorted(set(ends[0]) & set(ends[1]))
        cuts = [[e.index(k) + 1 for k in both] for e in ends]
        groups = ["|".join(",".join(str(i) for i in own[s][(c[g - 1] if g else 0) : c[g]]) for s, c in enumerate(cuts)) for g in range(len(both))]
        want.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for side, x in zip(sides, own):
            side.append(x)
    lengths = [np.array([len(x) for x in side], np.int64).tobytes() for side in sides]
    packed = [token_alignment.squeezed(np.array([i for x in side for i in x], np.uint16)) for side in sides]
    block = pd.Series({"documents": np.arange(4).tobytes(), "nulls": bytes(4), "a_lengths": lengths[0], "b_lengths": lengths[1], "a": packed[0], "b": packed[1]})
    assert token_alignment.Aligned(block, sizes, sizes).digests() == want
