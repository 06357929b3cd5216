"""Greedy choices over ranges of rows against a plain pass."""

import random

from tidewater.operators import outcomes


def test_choices_pass_from_range_to_range(spark):
    r = random.Random(2)
    rows = [(k, i, float(a), float(a + r.choice([0, 1, 5, 300]))) for k in ("a", "b", None) for i, a in enumerate(r.sample(range(5000), 700))]
    rows += [("c", 0, 0.0, 9000.0), ("c", 1, 9000.0, 9001.0), *(("c", 2 + i, float(i + 1), float(i + 2)) for i in range(2000)), ("d", 0, None, 1.0), ("d", 1, 1.0, None), ("d", 2, 5.0, 6.0)]
    expect = []
    for k in {k for k, *_ in rows}:
        free, some = None, False
        for i, a, b in sorted((x[1:] for x in rows if x[0] == k), key=lambda x: (x[1] is None, x[1] or 0, x[2] is None, x[2] or 0)):
            if not some or a is not None and free is not None and a >= free:
                free, some = b, True
                expect.append((str(k), i))
    got = outcomes.non_overlapping(spark.createDataFrame(rows, "kind string, id long, a double, b double"), "kind", "a", "b", range_rows=300)
    assert sorted((str(x["kind"]), x["id"]) for x in got.collect()) == sorted(expect)
    # no task gathers a key: rows stay in ranges and stream
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert outcomes.non_overlapping(spark.createDataFrame([], "kind string, id long, a double, b double"), "kind", "a", "b").count() == 0


def test_running_sums_by_ranges_match_one_window(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidewater.operators import ordered, outcomes

    r = random.Random(5)
    rows = spark.createDataFrame([(r.choice(["hot", "hot", "hot", "a", None]), i, r.randint(-9, 9) / 4) for i in range(3000)], "k string, t int, r double")
    whole = Window.partitionBy("k").orderBy("t")
    peak = F.max("cum").over(whole.rowsBetween(Window.unboundedPreceding, 0))
    plain = rows.withColumns({"n": F.row_number().over(whole), "of": F.count("*").over(Window.partitionBy("k")), "cum": F.sum("r").over(whole)}).withColumn("peak", peak).withColumn("tile", F.ntile(7).over(whole))
    cut = ordered.running(rows, ["k"], ["t"], {"cum": F.col("r")}, range_rows=170)
    cut = ordered.running_peak(cut, ["k"], "cum", "peak", range_rows=50).withColumn("tile", ordered.tile(F.col("n"), F.col("of"), 7))
    names = ["k", "t", "n", "of", "cum", "peak", "tile"]
    read = lambda df: sorted((tuple(x) for x in df.select(*names).collect()), key=str)
    assert read(cut) == read(plain)
    assert outcomes.summarize(rows, ["k"], order=["t"]).count() == 3
    assert ordered.running(rows.where("false"), ["k"], ["t"]).count() == 0


def test_averages_by_chunks_match_one_pass(spark):
    import datetime

    import numpy as np
    import pandas as pd

    from tidewater.operators import indicators

    r = np.random.default_rng(3)
    stamp = [datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=int(h)) for h in np.cumsum(r.integers(1, 9, 2500))]
    x = [None if i < 3 else float(v) for i, v in enumerate(r.normal(5, 2, 2500))]
    rows = spark.createDataFrame([("a", t, v) for t, v in zip(stamp, x)] + [("b", stamp[0], 1.0)], "symbol string, ts timestamp, x double")
    got = indicators.smoothed(rows, {"slow": ("x", 0.01, 20), "fast": ("x", 0.9, 1), "last": ("x", 1.0, 1)}).where("symbol = 'a'").orderBy("ts").toPandas()
    for name, alpha, least in (("slow", 0.01, 20), ("fast", 0.9, 1), ("last", 1.0, 1)):
        expect = pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        assert np.allclose(got[name].astype(float), expect, rtol=1e-9, equal_nan=True), name


def test_rolling_correlation_by_blocks(spark):
    import numpy as np

    from tidewater.operators import cross

    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, k, float(v)) for i in range(120) for k, v in zip("ab", r.normal(size=2))], "ts int, symbol string, r double")
    one, cut = (cross.rolling_correlation(rows, "a", "b", 10, block=n).orderBy("ts").toPandas() for n in (1000, 17))
    assert one.equals(cut) and one["corr"].notna().sum() == 111
