"""Quantile heads on a planted law, and contributions against enumeration."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import boosted

FEATURES = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def planted(spark):
    """y = 2 x0 + (1 + x1) times normal noise."""
    r = np.random.default_rng(7)
    x = r.random((4000, 6))
    y = 2 * x[:, 0] + (0.3 + x[:, 1]) * r.normal(size=4000)
    frame = pd.DataFrame(x, columns=FEATURES).assign(y=y)
    frame.loc[::97, "x2"] = None
    frame.loc[::211, "y"] = None
    return frame, boosted.fit_quantiles(spark.createDataFrame(frame), FEATURES, "y", rounds=14, rate=0.3)


def test_quantiles_cover_what_they_say(spark, planted):
    _, model = planted
    r = np.random.default_rng(8)
    x = r.random((3000, 6))
    y = 2 * x[:, 0] + (0.3 + x[:, 1]) * r.normal(size=3000)
    got = np.sort(model.raw(x), axis=1)
    for k, q in enumerate(model.quantiles):
        assert abs((y <= got[:, k]).mean() - q) < 0.035
    wide = got[:, 2] - got[:, 0]
    assert wide[x[:, 1] > 0.8].mean() > 1.5 * wide[x[:, 1] < 0.2].mean()
    assert np.corrcoef(got[:, 1], x[:, 0])[0, 1] > 0.85


def plain_expected(tree, row, known, node=0):
    """A tree's value where only some features are known: others follow the shares of rows."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    if f in known:
        return plain_expected(tree, row, known, tree.left[node] if row[f] < tree.cut[node] else tree.right[node])
    return sum(plain_expected(tree, row, known, c) * tree.cover[c] / tree.cover[node] for c in (tree.left[node], tree.right[node]))


def test_contributions_equal_enumeration(planted):
    frame, model = planted
    x = frame[FEATURES].to_numpy(float)[:25]
    for k in range(3):
        expected, got = model.contributions(x, k)
        assert np.allclose(expected + got.sum(axis=1), model.raw(x)[:, k], atol=1e-9)
        for row, own in zip(x[:4], got[:4], strict=True):
            value = lambda known: model.base[k] + model.rate * sum(plain_expected(t, row, known) for t in model.trees[k])  # noqa: E731, B023
            for f in range(6):
                others = [i for i in range(6) if i != f]
                want = sum(factorial(n) * factorial(5 - n) / 720 * (value({*s, f}) - value(set(s))) for n in range(6) for s in combinations(others, n))
                assert own[f] == pytest.approx(want, abs=1e-9)


def test_columns_of_rows(spark, planted):
    frame, model = planted
    rows = spark.createDataFrame(frame.head(300).assign(id=range(300)))
    out = boosted.quantile_columns(rows, model, ["low", "mid", "high"]).toPandas()
    assert (out["low"] <= out["mid"]).all() and (out["mid"] <= out["high"]).all()
    explained = boosted.contribution_columns(rows, model, 1)
    top = boosted.top_contributions(explained, ["id"], model, 2).toPandas()
    assert len(top) == 600 and set(top["rank"]) == {1, 2}
    shares = {r["feature"]: r["share"] for r in boosted.feature_shares(explained, model).collect()}
    assert sum(shares.values()) == pytest.approx(1) and max(shares, key=shares.get) == "x0"


def test_without_rows_the_model_is_zero(spark, planted):
    frame, _ = planted
    none = spark.createDataFrame(frame.head(5)).where("false")
    model = boosted.fit_quantiles(none, FEATURES, "y", rounds=1)
    assert model.raw(np.zeros((2, 6))).tolist() == [[0.0] * 3] * 2
