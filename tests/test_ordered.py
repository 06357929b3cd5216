"""Hand-made series, and the rule that no row depends on later bars."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import asof, bars, calibration, graph, indicators, ordered, outcomes, retrieval, structure, zones
from tidewater.streaming import live

START = dt.datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp, o double, h double, l double, c double, v double"


def series(spark, closes, wick=0.1, symbol="s"):
    opens = [closes[0], *closes[:-1]]
    rows = [(symbol, START + dt.timedelta(hours=i), o, max(o, c) + wick, min(o, c) - wick, c, 1.0) for i, (o, c) in enumerate(zip(opens, closes, strict=True))]
    return spark.createDataFrame([(a, b, *map(float, x)) for a, b, *x in rows], BARS)


def walk(spark, n=300, seed=3):
    r = np.random.default_rng(seed)
    return series(spark, (100 + np.cumsum(r.normal(0, 0.3, n))).tolist(), 0.15)


ZIG = [10, 11, 12, 13, 12.4, 11.8, 11, 12, 13.4, 15, 14.4, 13.8, 13, 14, 15.5, 17, 16.4, 15.8, 15, 16, 16.5]


def test_zigzag_structure(spark):
    out = structure.run_structure(series(spark, ZIG)).orderBy("i").collect()
    swings = [(r["kind"], r["level"], r["label"]) for r in out if r["kind"]]
    assert [(k, p) for k, p, _ in swings] == [("H", 13), ("L", 11), ("H", 15), ("L", 13), ("H", 17), ("L", 15)]
    assert [x for _, _, x in swings] == [None, None, "HH", "HL", "HH", "HL"]
    events = [(r["i"], r["event"], r["level"]) for r in out if r["event"]]
    assert (8, "bos_up", 13.0) in events
    assert [r["trend"] for r in out if r["trend"]][-1] == "up"
    mirror = structure.run_structure(series(spark, [30 - x for x in ZIG])).where("kind is not null").orderBy("i").collect()
    assert [r["label"] for r in mirror][2:] == ["LL", "LH", "LL", "LH"]


@pytest.mark.parametrize(
    "view",
    [
        lambda b: structure.run_structure(b),
        lambda b: structure.box_states(indicators.atr(b)),
        lambda b: structure.boxes(b),
        lambda b: structure.candlesticks(indicators.atr(b)),
        lambda b: indicators.macd(b),
        lambda b: indicators.rsi(b),
        lambda b: indicators.bollinger(b),
        lambda b: indicators.forming(b, bars.bin_start(F.col("ts"), "4h")),
    ],
)
def test_no_row_depends_on_later_bars(spark, view):
    b = walk(spark)
    cut = START + dt.timedelta(hours=180)
    early = view(b.where(F.col("ts") <= F.lit(cut)))
    late = view(b).where(F.col("ts") <= F.lit(cut)).select(early.columns)
    key = lambda df: sorted(map(repr, (tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r) for r in df.collect())))
    assert key(early) == key(late)


def test_averages_match_plain_recursions(spark):
    b = walk(spark, 80)
    c = [r["c"] for r in b.orderBy("ts").collect()]
    got = [r["ema"] for r in indicators.ema(b, 10).orderBy("ts").collect()]
    y = c[0]
    for i, x in enumerate(c):
        y = y + (x - y) * 2 / 11
        assert got[i] == (pytest.approx(y) if i >= 9 else None)
    flat = indicators.rsi(series(spark, [5.0] * 20)).orderBy("ts").collect()
    assert flat[13]["rsi"] is None and flat[14]["rsi"] == 50.0
    up = indicators.rsi(series(spark, list(range(1, 22)))).orderBy("ts").collect()
    assert up[14]["rsi"] == 100.0


def test_labels_ties_and_short_horizons(spark):
    rows = [("s", START + dt.timedelta(hours=i), 10.0, h, l, c, 1.0) for i, (h, l, c) in enumerate([(10, 10, 10), (12, 9, 10), (11, 10, 11), (13, 10, 12), (12, 8, 9)])]
    b = spark.createDataFrame([(a, t, *map(float, x)) for a, t, *x in rows], BARS)
    out = outcomes.trade_labels(b, F.lit(1.0), F.lit(2.0), F.lit(0.0), 2).orderBy("ts").collect()
    assert out[0]["buy"] == 0 and out[0]["r_buy"] == -1.0  # stop and target in one bar: the stop
    assert out[1]["buy"] == 1 and out[1]["r_buy"] == 2.0 and out[1]["best"] == "buy"
    assert out[3]["buy"] is None and out[4]["best"] is None
    ends = outcomes.exits(b, F.lit(1.0), F.lit(2.0), 2).orderBy("ts").collect()
    assert ends[3]["outcome"] == "loss" and ends[4]["outcome"] is None


def test_asof_ties_gaps_and_directions(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), (None, 5)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", 4, 12), ("c", 5, 13)], "k string, u int, v int")
    got = lambda **x: sorted((r["k"] or "", r["t"], r["v"]) for r in asof.asof_join(left, right, ["k"], "t", "u", ["v"], **x).collect())
    assert got() == [("", 5, None), ("a", 1, 11), ("a", 5, 12), ("b", 5, None)]
    assert got(inclusive=False)[1] == ("a", 1, None)
    assert got(direction="forward")[1] == ("a", 1, 10)


def test_local_grid_across_clock_changes(spark):
    hours = [dt.datetime(2024, 11, 2, 22) + dt.timedelta(hours=i) for i in range(24)]
    b = spark.createDataFrame([("s", t, 1.0, 1.0, 1.0, 1.0, 1.0) for t in hours], BARS)
    starts = [r["ts"].isoformat() for r in bars.resample_local(b).orderBy("ts").collect()]
    assert "2024-11-03T05:00:00" not in starts and "2024-11-03T06:00:00" not in starts  # 01:00 happens twice
    close = spark.sql("select timestamp'2024-07-05 00:00:00' t, timestamp'2024-12-05 00:00:00' u").select(*(bars.close_time(F.col(x), "1d", "fx").alias(x) for x in "tu")).first()
    assert (close["t"].hour, close["u"].hour) == (21, 22)


def test_empty_bars_give_empty_results(spark):
    none = spark.createDataFrame([], BARS)
    for f in (indicators.rsi, indicators.macd, structure.run_structure, structure.boxes, lambda b: bars.resample(b, "4h"), lambda b: structure.box_states(indicators.atr(b))):
        assert f(none).count() == 0


def with_atr(spark, rows, atr=1.0):
    return spark.createDataFrame([("s", START + dt.timedelta(hours=i), *map(float, r), 1.0, atr) for i, r in enumerate(rows)], BARS + ", atr double")


def test_zones_join_the_nearest_live_one(spark):
    lv = spark.createDataFrame([("s", 100.0, 1.0, 1), ("s", 100.8, 1.0, 2), ("s", 101.9, 1.0, 3), ("s", 100.1, 1.0, 500), ("s", None, 1.0, 2), (None, 1.0, 1.0, 2)], "symbol string, price double, tol double, known_i int")
    out = sorted((r["price"], r["members"]) for r in zones.zones(with_atr(spark, [(1, 1, 1, 1)] * 510), lv).collect())
    assert out == [(100.0, 2), (100.1, 1), (101.9, 1)]


def zigzag_through(level, times):
    """Bars that close through a level, up and down in turn."""
    rows = [(level - 1,) * 4] * 3
    for k in range(times):
        a, b = (level - 1, level + 1) if k % 2 == 0 else (level + 1, level - 1)
        rows += [(a, max(a, b), min(a, b), b), (b, b + 0.1, b - 0.1, b)]
    return rows


def test_a_retired_zone_takes_no_touch_and_no_level(spark):
    lv = lambda *k: spark.createDataFrame([("s", 100.0, 0.2, i) for i in k], "symbol string, price double, tol double, known_i int")
    worn = with_atr(spark, zigzag_through(100, 6))
    found, touches = zones.zone_history(worn, lv(0, 14))
    one, two = found.orderBy("zone").collect()
    kinds = [r["kind"] for r in touches.where("zone = 0").orderBy("i").collect()]
    assert kinds == ["break"] + ["retest_fail"] * 3 and one["through"] == 4 and one["members"] == 1
    assert one["retired_i"] is not None and two["known_i"] == 14 and two["retired_i"] is None
    # closed through three times only, it lives and takes the level
    found, _ = zones.zone_history(with_atr(spark, zigzag_through(100, 3) + [(101, 101.1, 100.9, 101)] * 9), lv(0, 14))
    assert [(r["members"], r["retired_i"]) for r in found.collect()] == [(2, None)]


def wild(spark, n=900, seed=5):
    r = np.random.default_rng(seed)
    c = 100 + np.cumsum(r.normal(0, 0.6, n)) * 0.5 + 3 * np.sin(np.arange(n) / 17)
    o = np.concatenate([[c[0]], c[:-1]])
    rows = [("s" if i % 2 else "t", START + dt.timedelta(hours=i), *map(float, (o[i], max(o[i], c[i]) + r.random(), min(o[i], c[i]) - r.random(), c[i])), 1.0) for i in range(n)]
    return spark.createDataFrame(rows, BARS)


def rows_of(df):
    return sorted(map(repr, (tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r) for r in df.collect())))


def test_ranges_of_any_size_give_one_pass(spark):
    from tidewater.operators import signals

    b = indicators.atr(wild(spark)).persist()
    swings = indicators.body_swings(b)
    part = lambda flag, price, kind, k: swings.where(flag).select("symbol", (F.col("i") * 2 + k).alias("level_id"), F.col(price).alias("price"), F.lit(kind).alias("kind"), F.col("confirmed").alias("known_i"))
    lv = part("body_high", "top", "H", 0).unionByName(part("body_low", "bottom", "L", 1)).persist()
    near = lv.withColumn("tol", F.lit(0.4))
    whole, touches = zones.zone_history(b, near)
    assert whole.where("retired_i is not null").count() > 3 and touches.count() > 100
    for size, warm in ((110, 0), (200, 90)):
        found, met = zones.zone_history(b, near, range_rows=size, warm_rows=warm)
        assert rows_of(found) == rows_of(whole) and rows_of(met) == rows_of(touches)
    assert rows_of(structure.box_states(b, range_rows=130, warm_rows=60)) == rows_of(structure.box_states(b))
    once = structure.retests(b, lv, 0.3, 20)
    assert once.count() > 50 and rows_of(structure.retests(b, lv, 0.3, 20, range_rows=90)) == rows_of(once)
    plan = signals.structure_signals(b).select("symbol", "i", "dir", F.col("level").alias("entry"))
    once = signals.protected_swings(plan, b)
    assert once.count() > 20 and rows_of(signals.protected_swings(plan, b, range_rows=90)) == rows_of(once)


@pytest.mark.parametrize("cuts", [(), (3, 400, 401), tuple(range(0, 900, 130))])
def test_zone_stream_gives_the_rows_of_one_pass_however_it_is_cut(spark, tmp_path, cuts):
    b = indicators.atr(wild(spark)).persist()
    swings = indicators.body_swings(b)
    lv = swings.where("body_high or body_low").select("symbol", F.when(F.col("body_high"), F.col("top")).otherwise(F.col("bottom")).alias("price"), F.lit(0.4).alias("tol"), F.col("confirmed").alias("known_i"))
    rows = zones.machine_rows(b, lv).persist()
    edges = [-1, *cuts, 10_000]
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows.where((F.col("i") > low) & (F.col("i") <= high))
        again = rows.where((F.col("i") > low - 5) & (F.col("i") <= low))  # some come again
        part.unionByName(again).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        name = f"zones_{len(cuts)}"
        q = live.zone_touches(live.stream_table(spark, f"{tmp_path}/rows", rows.schema)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    whole = zones.zone_reactions(b, lv).where("kind <> 'in_progress'").select("symbol", "price", "i", "resolved_i", "kind", "side", "depth", "approach")
    got = spark.table(name)
    assert rows_of(got.where("what = 'touch'").select(*whole.columns)) == rows_of(whole) and whole.count() > 50
    gone = zones.zones(b, lv).where("retired_i is not null").select("symbol", "price", "known_i", "retired_i", "members")
    assert rows_of(got.where("retired_i is not null").select(*gone.columns)) == rows_of(gone)


def test_calibration_closed_forms(spark):
    one = spark.range(1)
    tail = one.select(calibration.binomial_tail(F.lit(7), F.lit(10), F.lit(0.5)).alias("p")).first()["p"]
    assert tail == pytest.approx(176 / 1024)
    above = one.select(calibration.posterior_above(F.lit(0), F.lit(0), F.lit(0.3)).alias("p")).first()["p"]
    assert above == pytest.approx(0.7)
    assert one.select(calibration.kelly(F.lit(0.4), F.lit(2.5)).alias("k")).first()["k"] == pytest.approx(0.16)
    need = one.select(calibration.trades_needed(F.lit(0.3), F.lit(0.4)).alias("n")).first()["n"]
    assert need is None


def test_graph_cycles_and_waits(spark):
    nodes = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("x", "a")], "src string, dst string")
    assert {r["key"]: r["level"] for r in graph.levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2}
    assert not graph.is_acyclic(nodes, edges)
    assert graph.levels(nodes.where("false"), edges).count() == 0


def test_text_helpers(spark):
    one = spark.createDataFrame([("a\na\n\n\nb\na",)], "t string")
    assert one.select(retrieval.collapse_runs(F.col("t")).alias("x")).first()["x"] == "a [×2]\n\n\nb\na"
    assert one.select(retrieval.word_shingles(F.lit("one two")).alias("x")).first()["x"] == []


def test_walk_forward_never_tests_on_training_rows(spark):
    rows = spark.range(100).select(F.lit("s").alias("symbol"), F.col("id").alias("t"))
    out = outcomes.walk_forward(rows, ["t"], ["symbol"], 4, 0.5, 3).toPandas()
    for _, f in out.groupby("fold"):
        assert f[f.part == "train"].t.max() + 3 < f[f.part == "test"].t.min()
    assert pd.concat([f[f.part == "test"] for _, f in out.groupby("fold")]).t.tolist() == list(range(50, 100))


def test_zone_touches_in_turn(spark):
    path = [(101, 100.5), (100.4, 99.9), (101.5, 100.6), (102, 101), (101, 99.2), (99.5, 98.5), (99.9, 99), (98.9, 98.6)]
    b = with_atr(spark, [(c, h, min(c, l), c) for h, l, c in ((h, l, (h + l) / 2) for h, l in path)])
    lv = spark.createDataFrame([("s", 100.0, 0.2, 0), ("s", 500.0, 0.2, 0), ("t", 1.0, 0.1, 0)], "symbol string, price double, tol double, known_i int")
    got = [(r["i"], r["kind"], r["side"]) for r in zones.zone_reactions(b, lv).orderBy("i").collect()]
    assert got[0] == (1, "rejection", 1) and [k for _, k, _ in got[1:]] == ["in_progress"] or [k for _, k, _ in got[1:]][0] == "break"
    assert zones.zone_reactions(b.where("false"), lv).count() == 0


def test_shapes_of_swings(spark):
    from tidewater.operators import reactions

    def shapes(points):
        rows = [("s", 5 * i, "H" if (i % 2 == 0) == (points[0] > points[1]) else "L", float(p), 1.0) for i, p in enumerate(points)]
        return reactions.swing_shapes(spark.createDataFrame(rows, "symbol string, swing_i int, kind string, price double, atr double")).orderBy("swing_i").collect()[-1]

    assert shapes([9, 13, 10, 13.2])["double"] == -1
    assert shapes([13, 9, 12, 8.9])["double"] == 1
    assert shapes([13, 10, 13.1, 10.2, 13.2])["triple"] == -1
    assert shapes([12, 10, 14, 10, 12.3])["head_shoulders"] == -1
    assert shapes([8, 12, 9, 12.1])["triangle"] == 1
    assert shapes([12, 8, 11, 9])["triangle"] == 0
    assert shapes([5, 10, 8, 11])["wedge"] == -1
    assert shapes([5, 20, 6, 30])["double"] is None


def test_percentiles_in_ranges_are_those_of_one_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(900)) / 4).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(9, None), (10, 1.5), (11, float("inf")), (11, float("inf"))], "g long, v double"))
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    want = sorted(map(str, rows.groupBy("g").agg(*(F.percentile("v", F.lit(q)).alias(k) for k, q in shares.items())).collect()))
    for size in (100, 1_000_000):
        assert sorted(map(str, ordered.percentiles(rows, ["g"], "v", shares, range_rows=size).collect())) == want
    plan = ordered.percentiles(rows, ["g"], "v", shares, range_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "part_" in plan
