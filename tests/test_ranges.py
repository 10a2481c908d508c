"""Running results over small ranges, against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import ranges


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(7)
    # One group holds most rows, one is null, and many values tie.
    data = [(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 4}", i, None if draw.random() < 0.6 else draw.randrange(20), draw.choice([0.0, 0.0, 1.5, -2.0, draw.random()])) for i in range(1500)]
    data += [("nothing", 9000 + i, None, None) for i in range(5)]
    draw.shuffle(data)
    return data, spark.createDataFrame(data, "g string, t long, v long, x double").repartition(5)


def test_running_sum_places_and_carried_values(rows):
    data, table = rows
    groups = defaultdict(list)
    for g, t, v, x in sorted(data, key=lambda r: r[1]):
        groups[g].append((t, v, x))
    order = [F.col("t").asc()]
    for size in (40, 10**6):
        places = {(r["g"], r["t"]): r["place"] for r in ranges.numbered(table, ["g"], order, range_rows=size).collect()}
        assert places == {(g, t): k for g, own in groups.items() for k, (t, _, _) in enumerate(own)}
        last = {(r["g"], r["t"]): r["last"] for r in ranges.carried(table, ["g"], order, "v", "last", size).collect()}
        sums = {(r["g"], r["t"]): r["s"] for r in ranges.running_sum(table.fillna(0, ["v"]), ["g"], order, "v", "s", size).collect()}
        for g, own in groups.items():
            now, total = None, 0
            for t, v, _ in own:
                now, total = (v if v is not None else now), total + (v or 0)
                assert (last[g, t], sums[g, t]) == (now, total)
    whole = sorted((r["t"], r["place"]) for r in ranges.numbered(table, [], order, range_rows=100).collect())
    assert [p for _, p in whole] == list(range(len(data)))


def test_quantiles_are_exact(rows):
    data, table = rows
    groups = defaultdict(list)
    for g, _, _, x in data:
        if x is not None:
            groups[g].append(x)
    shares = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q95": 0.95, "top": 1.0}
    for size in (30, 10**6):
        found = {r["g"]: [r[n] for n in shares] for r in ranges.quantiles(table, ["g"], "x", shares, size).collect()}
        assert set(found) == set(groups)
        for g, own in groups.items():
            assert found[g] == pytest.approx(list(np.quantile(own, list(shares.values()))))
    every = ranges.quantiles(table, [], "x", {"mid": 0.5}, 30).first()
    assert every["mid"] == pytest.approx(np.quantile([x for _, _, _, x in data if x is not None], 0.5))
    assert ranges.quantiles(table.limit(0), [], "x", {"mid": 0.5}).collect()[0]["mid"] is None
    assert ranges.quantiles(table.limit(0), ["g"], "x", {"mid": 0.5}).count() == 0
