"""What price does at levels, and what forecasts come to: zone reactions, swing shapes, impulse legs, basis curves, scored
predictions, breakdowns and tests of rates against a baseline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calibration import proportion_gap
from .indicators import by_symbol
from .outcomes import wilson
from .structure import IMPULSE_MOVE, IMPULSE_SPEED

#: Fixed values, in average ranges.
EQUAL, DEPTH, HEAD, SHOULDER, FLAT, SLOPED = 0.5, 1.5, 0.5, 1.0, 0.3, 0.5

def legs(swings: DataFrame) -> DataFrame:
    """Moves between neighbouring swings (symbol, swing_i, kind, price, atr): bars, move, direction and whether the move is an
    impulse: far enough and fast enough in average ranges at its start."""
    own = Window.partitionBy("symbol").orderBy("swing_i", "kind")
    rows = swings.withColumns({"to_i": F.lead("swing_i").over(own), "to_price": F.lead("price").over(own)}).where("to_i is not null")
    move, n = F.col("to_price") - F.col("price"), F.col("to_i") - F.col("swing_i")
    strong = (F.abs(move) >= IMPULSE_MOVE * F.col("atr")) & (F.abs(move) / F.nullif(n, F.lit(0)) >= IMPULSE_SPEED * F.col("atr"))
    return rows.select("symbol", "swing_i", "to_i", n.alias("bars"), move.alias("move"), F.signum(move).alias("direction"), F.coalesce(strong, F.lit(False)).alias("impulse"))


def swing_shapes(swings: DataFrame) -> DataFrame:
    """Reversal and converging shapes of the last three to five alternating swings (symbol, swing_i, kind, price, atr), as
    each swing completes them: double, triple, head_shoulders, triangle and wedge, 1 bullish, -1 bearish, 0 either way."""
    own = Window.partitionBy("symbol").orderBy("swing_i", "kind")
    p = [F.col("price"), *(F.lag("price", k).over(own) for k in range(1, 5))]
    x = [F.col("swing_i"), *(F.lag("swing_i", k).over(own) for k in range(1, 5))]
    rows = swings.withColumns({f"p{k}": v for k, v in enumerate(p)} | {f"x{k}": v for k, v in enumerate(x)})
    a = F.col("atr")
    # turned so that the last swing is a high: what holds for tops then holds for bottoms
    s = F.when(F.col("kind") == "H", 1.0).otherwise(-1.0)
    q = [s * F.col(f"p{k}") for k in range(5)]
    ok = lambda c: F.coalesce(c, F.lit(False))
    pair = (F.abs(q[0] - q[2]) <= EQUAL * a) & (F.least(q[0], q[2]) - q[1] >= DEPTH * a) & F.coalesce(q[3] < q[1], F.lit(True))
    three = [q[0], q[2], q[4]]
    top3, low3 = F.greatest(*three), F.least(*three)
    complete = F.col("p4").isNotNull()
    triple = complete & (top3 - low3 <= 1.5 * EQUAL * a) & (low3 - F.least(q[1], q[3]) >= DEPTH * a)
    head = complete & (q[2] - F.greatest(q[0], q[4]) >= HEAD * a) & (F.abs(q[0] - q[4]) <= SHOULDER * a)
    high = F.col("kind") == "H"
    dh = F.when(high, F.col("p0") - F.col("p2")).otherwise(F.col("p1") - F.col("p3"))
    dl = F.when(high, F.col("p1") - F.col("p3")).otherwise(F.col("p0") - F.col("p2"))
    nh = F.when(high, F.col("x0") - F.col("x2")).otherwise(F.col("x1") - F.col("x3"))
    nl = F.when(high, F.col("x1") - F.col("x3")).otherwise(F.col("x0") - F.col("x2"))
    rise_h, fall_h, rise_l, fall_l = dh >= SLOPED * a, dh <= -SLOPED * a, dl >= SLOPED * a, dl <= -SLOPED * a
    rising = (F.abs(dh) <= FLAT * a) & rise_l
    falling = (F.abs(dl) <= FLAT * a) & fall_h
    triangle = F.when(ok(rising), 1).when(ok(falling), -1).when(ok(fall_h & rise_l), 0)
    wedge = F.when(ok(rise_h & rise_l & (dl / nl > dh / nh)), -1).when(ok(fall_h & fall_l & (dh / nh < dl / nl)), 1)
    turn = F.when(high, -1).otherwise(1)
    four = F.col("p3").isNotNull()
    return rows.select(
        "symbol", "swing_i", "kind", F.when(ok(pair), turn).alias("double"), F.when(ok(triple), turn).alias("triple"), F.when(ok(head), turn).alias("head_shoulders"),
        F.when(four, triangle).alias("triangle"), F.when(four, wedge).alias("wedge"),
    )


def basis_anchors(futures: DataFrame, spot: DataFrame, fewest: int = 6) -> DataFrame:
    """(symbol, at, basis): each day's median difference of hourly closes, at noon; days with fewer common hours give none."""
    both = futures.select("symbol", "ts", F.col("c").alias("f")).join(spot.select("symbol", "ts", F.col("c").alias("s")), ["symbol", "ts"])
    days = both.groupBy("symbol", F.date_trunc("day", F.col("ts")).alias("day")).agg(F.percentile(F.col("f") - F.col("s"), F.lit(0.5)).alias("basis"), F.count("*").alias("n"))
    return days.where(F.col("n") >= fewest).select("symbol", (F.col("day") + F.expr("interval 12 hours")).alias("at"), "basis")


def without_basis(bars: DataFrame, anchors: DataFrame) -> DataFrame:
    """Bars less the basis at their time: straight lines between anchors, the drift of all anchors beyond the ends (none
    under three days of them). Symbols without two anchors keep their prices."""
    from .asof import asof_join

    t = F.unix_timestamp("at") / 86400
    fit = anchors.groupBy("symbol").agg(F.regr_slope("basis", t).alias("slope_"), F.count("*").alias("n_"), F.min(t).alias("t0_"), F.max(t).alias("t1_")).where("n_ >= 2")
    fit = fit.withColumn("slope_", F.when(F.col("t1_") - F.col("t0_") >= 3, F.col("slope_")).otherwise(0.0)).select("symbol", "slope_")
    keyed = anchors.join(fit.select("symbol"), "symbol", "left_semi").withColumns({"t": t, "b": F.col("basis")})
    rows = asof_join(bars, keyed, ["symbol"], "ts", "at", ["t", "b"]).withColumnsRenamed({"t": "ta_", "b": "ba_"})
    rows = asof_join(rows, keyed, ["symbol"], "ts", "at", ["t", "b"], direction="forward").withColumnsRenamed({"t": "tb_", "b": "bb_"})
    rows = rows.join(fit, "symbol", "left").withColumn("x_", F.unix_timestamp("ts") / 86400)
    between = F.col("ba_") + (F.col("bb_") - F.col("ba_")) * F.coalesce((F.col("x_") - F.col("ta_")) / F.nullif(F.col("tb_") - F.col("ta_"), F.lit(0.0)), F.lit(0.0))
    basis = F.coalesce(between, F.col("ba_") + F.col("slope_") * (F.col("x_") - F.col("ta_")), F.col("bb_") + F.col("slope_") * (F.col("x_") - F.col("tb_")), F.lit(0.0))
    return rows.withColumn("basis", basis).select("symbol", "ts", *((F.col(k) - F.col("basis")).alias(k) for k in "ohlc"), "v", "basis")


def score_predictions(predictions: DataFrame, bars: DataFrame, bucket_seconds: float = 5 * 86400.0) -> DataFrame:
    """Outcome, signed return in percent and Brier score of predictions (id, symbol, direction long, short or neutral, p,
    reference, stop, target, start_ts, end_ts) on the bars between start and end: stop or target, whichever a bar reaches
    first (a tie is a stop), else correct, flat (within 0.02%; for neutral within 0.15%) or wrong. Without bars, no row.
    Bars meet predictions by equality on time buckets; choose one near the usual span."""
    from .asof import range_join

    path = range_join(bars.select("symbol", "ts", "h", "l", "c"), predictions, ["symbol"], "ts", "start_ts", "end_ts", bucket_seconds, inclusive_end=True).where("ts > start_ts")
    long, short = F.col("direction") == "long", F.col("direction") == "short"
    stopped = (long & (F.col("l") <= F.col("stop"))) | (short & (F.col("h") >= F.col("stop")))
    hit = (long & (F.col("h") >= F.col("target"))) | (short & (F.col("l") <= F.col("target")))
    out = path.groupBy(*predictions.columns).agg(F.min(F.when(stopped, F.col("ts"))).alias("s_"), F.min(F.when(hit, F.col("ts"))).alias("t_"), F.max_by("c", "ts").alias("last"))
    raw = (F.col("last") / F.col("reference") - 1) * 100
    signed = F.when(long, raw).when(short, -raw).otherwise(-F.abs(raw))
    reached = F.when(F.col("s_").isNotNull() & (F.col("t_").isNull() | (F.col("s_") <= F.col("t_"))), "stop").when(F.col("t_").isNotNull(), "target")
    else_ = F.when(~long & ~short, F.when(F.abs(raw) < 0.15, "flat").otherwise("wrong")).when(F.abs(raw) < 0.02, "flat").when(signed > 0, "correct").otherwise("wrong")
    out = out.withColumn("outcome", F.coalesce(reached, else_)).withColumn("return_pct", signed)
    right = F.when(~long & ~short, F.col("outcome") == "flat").when(F.col("target").isNotNull(), F.col("outcome") == "target").otherwise(F.col("outcome") == "correct")
    return out.withColumn("brier", F.pow(F.col("p") - right.cast("int"), 2)).drop("s_", "t_")


def breakdown(trades: DataFrame, dimensions: dict[str, Column], result: str = "r") -> DataFrame:
    """(dimension, bucket, n, wins, win_rate, ci_low, ci_high, mean) for several dimensions at once; one whose column is
    an array counts a trade under each of its values. Rows are repeated once a dimension and value before one shuffle."""
    kinds = dict(trades.select(*[c.alias(k) for k, c in dimensions.items()]).dtypes)
    named = lambda k: lambda v: F.struct(F.lit(k).alias("dimension"), v.alias("bucket"))
    lists = {k: c.cast("array<string>") if kinds[k].startswith("array") else F.array(c.cast("string")) for k, c in dimensions.items()}
    as_list = [F.transform(c, named(k)) for k, c in lists.items()]
    rows = trades.select(F.col(result).alias("r_"), F.explode(F.concat(*as_list)).alias("d")).select("d.*", "r_")
    out = rows.groupBy("dimension", "bucket").agg(F.count("*").alias("n"), F.sum((F.col("r_") > 0).cast("int")).alias("wins"), F.avg("r_").alias("mean"))
    low, high = wilson(F.col("wins"), F.col("n"))
    return out.withColumns({"win_rate": F.col("wins") / F.col("n"), "ci_low": low, "ci_high": high})


def edges(real: DataFrame, null: DataFrame, fewest: int = 30, z: float = 2.58) -> DataFrame:
    """Buckets (dimension, bucket, n, wins) whose rate differs from the baseline's by more than chance."""
    base = null.select("dimension", "bucket", F.col("n").alias("n0"), F.col("wins").alias("wins0"))
    rows = real.join(base, ["dimension", "bucket"]).withColumn("z", proportion_gap(F.col("wins"), F.col("n"), F.col("wins0"), F.col("n0")))
    return rows.withColumn("edge", F.coalesce((F.least("n", "n0") >= fewest) & (F.abs("z") > z), F.lit(False))).select("dimension", "bucket", "n", "wins", "n0", "wins0", "z", "edge")
