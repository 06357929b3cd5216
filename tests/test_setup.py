"""The calibrated ensemble: folds by time, honest probabilities, curves against a plain one."""

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import setup


def plain_isotonic(p, y):
    """Pool adjacent violators over the means of equal scores."""
    f = pd.DataFrame({"p": p, "y": y}).groupby("p")["y"].agg(["mean", "count"]).reset_index()
    pools = []
    for x, m, n in f.itertuples(index=False):
        pools.append([m, n, [x]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return {x: m for m, _, xs in pools for x in xs}


def test_stepwise_curve_pools_ties(spark):
    r = np.random.default_rng(3)
    p = np.round(r.random(400), 1)
    y = (r.random(400) < p**2).astype(float)
    got = setup.curve(spark.createDataFrame(pd.DataFrame({"p": p, "hit": y})), True)
    want = plain_isotonic(p, y)
    xs = np.array(sorted(want))
    assert np.allclose(got(xs), [want[x] for x in xs])


@pytest.fixture(scope="module")
def rows():
    """Two symbols at the same times; class 0 where x0 is high, 1 where low, noise beside it."""
    r = np.random.default_rng(5)
    n = 1500
    x = r.normal(size=(n, 3))
    z = x[:, 0] + r.normal(size=n)
    y = np.where(z > 0.7, 0, np.where(z < -0.7, 1, 2))
    t = np.repeat(np.arange(n // 2), 2)
    f = pd.DataFrame(x, columns=["x0", "x1", "x2"]).assign(y=y, t=t, t_end=t + 10)
    f.loc[::50, "x1"] = None
    return f


def test_members_are_calibrated_on_later_blocks(spark, rows):
    model = setup.fit_setup(spark.createDataFrame(rows.iloc[:1200]), ["x0", "x1", "x2"], "y", "t", "t_end", splits=2, gap=10)
    assert model.method == "logistic" and [f["train"] for f in model.folds] == sorted(f["train"] for f in model.folds)
    got = setup.setup_columns(spark.createDataFrame(rows.iloc[1200:]), model).toPandas()
    p = np.stack(got["p"])
    assert np.allclose(p.sum(axis=1), 1)
    hit = got["y"].to_numpy(int)
    loss = -np.log(p[np.arange(len(p)), hit]).mean()
    share = np.bincount(rows["y"].iloc[:1200], minlength=3) / 1200
    assert loss < -np.log(share[hit]).mean() - 0.1
    with pytest.raises(ValueError, match="version"):
        model.check(["x0", "x1", "x2"], "2")
    with pytest.raises(ValueError, match="order"):
        model.check(["x1", "x0", "x2"], "1")
    model.check(["x0", "x1", "x2"], "1")


def test_stepwise_where_there_are_rows_enough_and_an_error_where_there_are_too_few(spark, rows):
    frame = spark.createDataFrame(rows)
    model = setup.fit_setup(frame, ["x0", "x2"], "y", "t", "t_end", splits=1, gap=10, stepwise_from=50)
    assert model.method == "stepwise" and all(c.x for c in model.members[0][1])
    with pytest.raises(setup.NotEnoughRows):
        setup.fit_setup(frame.where("y < 2"), ["x0"], "y", "t", "t_end", splits=1, gap=10)
