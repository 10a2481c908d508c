"""Foreign trees, round trips and refusals; profiles and counts of trials."""

import json
from statistics import NormalDist

import numpy as np
import pytest

from weftline.operators import search
from weftline.plans import foreign
from weftline.plans.expression import ExpressionError, expression_hash, parse, profile

FIELDS = ("open", "high", "low", "close", "vol", "amount")
TEXTS = ["close", "close/open-1", "-(close-open)", "abs(close-open)", "rank(ts_mean(close,5))", "zscore(ts_std(returns(close,1),20))*2.5", "winsor_mad(ts_delta(vol,3),2.5)", "delay(close,2)+ts_sum(vol,4)-ts_min(low,7)*ts_max(high,7)"]


def node(operator, *arguments, **parameters):
    return {"operator": operator, "arguments": list(arguments), "parameters": parameters}


CLOSE = node("field", name="close")
REFUSED = [
    "", "[]", "{", json.dumps(node("power", CLOSE, CLOSE)), json.dumps(node("add", CLOSE)), json.dumps(node("field", name="close or 1")), json.dumps(node("field", name="unknown")), json.dumps(node("rolling_mean", CLOSE)),
    json.dumps(node("rolling_mean", CLOSE, window=True)), json.dumps(node("rolling_mean", CLOSE, window=0)), '{"operator": "constant", "parameters": {"value": NaN}}', json.dumps(node("subtract", CLOSE, CLOSE)), json.dumps({"operator": "negate", "arguments": CLOSE}), None,
]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trips(text):
    tree = parse(text, FIELDS)
    again = parse(foreign.text_of(json.loads(json.dumps(foreign.tree_of(tree)))), FIELDS)
    assert again == tree and expression_hash(again) == expression_hash(tree)


def test_other_functions_have_no_foreign_form():
    with pytest.raises(ExpressionError):
        foreign.tree_of(parse("ts_corr_v2(close,vol,5)", FIELDS))


def test_imported_table(spark):
    good = [json.dumps(foreign.tree_of(parse(t, FIELDS))) for t in TEXTS] + [json.dumps(node("winsorize_mad", CLOSE))]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(good + REFUSED)], "id int, content string")
    found = {r["id"]: r["imported"] for r in foreign.imported(rows, "content", FIELDS).collect()}
    assert [found[i]["text"] for i in range(len(TEXTS))] == [parse(t, FIELDS).text() for t in TEXTS]
    assert found[len(TEXTS)]["text"] == parse("winsor_mad(close,3)", FIELDS).text()
    assert all(found[i]["text"] is None and found[i]["error"] for i in range(len(good), len(good) + len(REFUSED)))


def test_profiles_and_trials(spark):
    found = profile(parse("rank(ts_mean(close,5))/ts_std(vol,20)", FIELDS))
    assert (found["functions"], found["fields"], found["windows"], found["history"], found["depth"]) == (["rank", "ts_mean", "ts_std"], ["close", "vol"], [5, 20], 19, 4)
    draw = np.random.default_rng(3).normal(size=(50, 4))
    draw[:, 1] += draw[:, 0]
    c = np.corrcoef(draw.T)
    pairs = spark.createDataFrame([(f"{i}", f"{j}", float(c[i, j])) for i in range(4) for j in range(i)], "a string, b string, correlation double")
    values = np.linalg.eigvalsh(c)
    assert search.effective_trials(pairs, 4).first()["effective"] == pytest.approx(values.sum() ** 2 / (values**2).sum())
    assert search.expected_best_sharpe(1, 1.0) == 0
    n, z = 1000, NormalDist().inv_cdf
    assert search.expected_best_sharpe(n, 4.0) == pytest.approx(2 * ((1 - 0.5772156649015329) * z(1 - 1 / n) + 0.5772156649015329 * z(1 - 1 / (n * np.e))))
