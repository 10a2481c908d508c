"""Representatives and diverse candidates against plain Python."""

import math
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from weftline.operators import diversity
from weftline.plans import panel_queries, selection_queries


def plain_correlation(a, b):
    if a is None or b is None or len(a) != len(b):
        return None
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None and math.isfinite(x) and math.isfinite(y)]
    if len(pairs) < 4:
        return None
    mx, my = (sum(p[k] for p in pairs) / len(pairs) for k in (0, 1))
    vx, vy = sum((x - mx) ** 2 for x, _ in pairs), sum((y - my) ** 2 for _, y in pairs)
    if vx <= 1e-12 or vy <= 1e-12:
        return None
    return max(-1.0, min(1.0, sum((x - mx) * (y - my) for x, y in pairs) / math.sqrt(vx * vy)))


@pytest.fixture(scope="module")
def sources():
    draw = random.Random(11)
    bases = [[draw.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    rows = []
    for i in range(160):
        base = draw.choice(bases)
        path = [draw.choice([1, 1, 1, -1]) * (x + draw.gauss(0, 0.35)) for x in base] if i % 7 else [x + draw.gauss(0, 0.2) for x in base]
        if i % 11 == 0:
            path[i % 12] = None
        rows.append((i, "big" if i % 5 else None if i % 10 else "small", round(draw.random(), 2), path, f"f{i % 3}"))
    rows += [(900, "big", 0.5, [1.0] * 12, "f0"), (901, "big", 0.5, [1.0, 2.0, 3.0], "f0"), (902, "big", 0.9, None, "f1"), (903, "small", 0.5, [float("nan")] * 12, "f1")]
    return rows


def test_representatives(spark, sources):
    want = {}
    for scope in {r[1] for r in sources}:
        own = sorted((r for r in sources if r[1] == scope and r[3] is not None and len(r[3]) >= 4), key=lambda r: (-r[2], r[0]))
        heads = []
        for place, row in enumerate(own):
            found = [(c, -k) for k, (_, h) in enumerate(heads) if (c := plain_correlation(row[3], h[3])) is not None]
            c, k = max(found, default=(-2, 0))
            if c >= 0.7:
                want[row[0]] = (place, heads[-k][0], c)
            else:
                heads.append((place, row))
                want[row[0]] = (place, place, 1.0)
    table = spark.createDataFrame(sources, "id long, scope string, quality double, path array<double>, family string")
    for batch in (20, 1000):
        found = diversity.representative_clusters(table, "scope", [F.desc("quality"), F.asc("id")], "path", 0.7, batch).collect()
        got = {r["id"]: (r["place"], r["best_place"]) for r in found}
        assert got == {i: v[:2] for i, v in want.items()}
        assert all(r["correlation"] == pytest.approx(want[r["id"]][2]) for r in found)
    assert 10 < len({(p, b) for _, (p, b, _) in want.items() if p == b}) < len(want) - 30


def test_summaries(spark):
    rows = [("s", "a", 0, 0, 1.0), ("s", "a", 1, 0, 0.9), ("s", "b", 2, 0, 0.8), ("s", "b", 3, 3, 1.0), ("t", "a", 0, 0, 1.0)]
    clusters = spark.createDataFrame(rows, "scope string, family string, place long, best_place long, correlation double")
    found = {r["scope"]: r for r in diversity.cluster_summary(clusters, "scope").collect()}
    assert (found["s"]["clusters"], found["s"]["largest"], found["s"]["redundancy"], found["s"]["hhi"]) == (2, 3, 0.5, pytest.approx(0.625))
    families = {(r["scope"], r["family"]): (r["rows"], r["clusters"], r["represented"]) for r in diversity.family_summary(clusters, "scope", "family").collect()}
    assert families == {("s", "a"): (2, 1, 1), ("s", "b"): (2, 2, 1), ("t", "a"): (1, 1, 1)}


def plain_choice(rows, cap, per_mechanism, most):
    key = lambda r: (-r[3], r[0])
    found, firsts = {}, {}
    for r in sorted(rows, key=key):
        name = ("=", r[0]) if r[1] is None else (":", r[1])
        if name in firsts:
            found[r[0]] = ("structure", firsts[name][0], None, None)
        else:
            firsts[name] = r
    taken = {}
    for r in sorted(firsts.values(), key=key):
        own = taken.setdefault(r[2] or "", [])
        if len(own) >= per_mechanism:
            found[r[0]] = ("mechanism", None, None, None)
            continue
        like = [(c, -k) for k, o in enumerate(own) if (c := plain_correlation(r[4], o[4])) is not None and c > cap]
        if like:
            found[r[0]] = ("path", own[-max(like)[1]][0], max(like)[0], None)
        else:
            own.append(r)
    names = sorted((m for m in taken if taken[m]), key=lambda m: key(taken[m][0]))
    turns = [taken[m][t] for t in range(per_mechanism) for m in names if t < len(taken[m])]
    for n, r in enumerate(turns, 1):
        found[r[0]] = ("chosen", None, None, n) if n <= most else ("surplus", None, None, None)
    return found


@pytest.mark.parametrize("per_mechanism, most", [(3, 8), (2, 3), (1, 50)])
def test_diverse_choice(spark, sources, per_mechanism, most):
    rows = [(i, None if i % 6 == 0 else f"{scope}{i % 40}", scope, quality, path) for i, scope, quality, path, _ in sources]
    table = spark.createDataFrame(rows, "id long, structure string, mechanism string, quality double, path array<double>")
    found = diversity.diverse_candidates(table, "id", "structure", "mechanism", [-F.col("quality")], "path", 0.5, per_mechanism, most).collect()
    want = plain_choice(rows, 0.5, per_mechanism, most)
    assert {r["id"]: (r["state"], r["kept"], r["place"]) for r in found} == {i: (s, k, p) for i, (s, k, _, p) in want.items()}
    assert all(r["correlation"] == (None if want[r["id"]][2] is None else pytest.approx(want[r["id"]][2])) for r in found)


def test_nothing_to_choose(spark):
    none = spark.createDataFrame([], "id long, structure string, mechanism string, scope string, quality double, path array<double>")
    assert diversity.representative_clusters(none, "scope", [F.desc("quality")], "path").count() == 0
    assert diversity.diverse_candidates(none, "id", "structure", "mechanism", [-F.col("quality")], "path").count() == 0


def test_quality_does_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    """Most returns are clipped, so means tie: rounding that follows the shuffle would order them by chance."""
    sf, found = "/root/testdata/sf0.001", {}
    series = panel_queries.series(spark, sf)
    for r in series.orderBy("ts_code", "trade_date").collect():
        found.setdefault(r["ts_code"], []).append(r["ret"])
    want = {code: reduce(lambda a, b: a + b, own, 0.0) / len(own) for code, own in found.items()}
    monkeypatch.setattr(selection_queries, "series", lambda *_: series.repartition(3).sortWithinPartitions(F.xxhash64("ts_code", "trade_date")))
    assert {r["ts_code"]: r["quality"] for r in selection_queries.candidates(spark, sf).select("ts_code", "quality").collect()} == want
