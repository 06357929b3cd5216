"""Across series: correlations, betas, lead and lag, regimes, and currency-style strength against the cross-section."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import grid
from .ordered import running

#: Instants of a block of a rolling window over all of them.
BLOCK = 1_000_000


def aligned_returns(bars: DataFrame) -> DataFrame:
    """(ts, symbol, r): log returns at the instants where every symbol has one."""
    own = Window.partitionBy("symbol").orderBy("ts")
    r = bars.select("symbol", "ts", F.log(F.col("c") / F.lag("c").over(own)).alias("r")).where("r is not null")
    every = bars.agg(F.count_distinct("symbol").alias("all_"))
    whole = r.groupBy("ts").agg(F.count("*").alias("n_")).join(F.broadcast(every)).where("n_ = all_").select("ts")
    return r.join(whole, "ts")


def _pair_sums(rows: DataFrame) -> DataFrame:
    """(a, b, n, sx, sy, sxx, syy, sxy) over the instants (ts, symbol, x, y) at which a has an x and b a y, both less the
    symbol's mean. A task sums up its instants as products of matrices, so it sends one row a pair, however many
    instants there are; what one instant holds is as many numbers as there are symbols."""
    means = rows.groupBy("symbol").agg(F.avg("x").alias("mx_"), F.avg("y").alias("my_"))
    rows = rows.join(means, "symbol").select("ts", F.struct("symbol", (F.col("x") - F.col("mx_")).alias("x"), (F.col("y") - F.col("my_")).alias("y")).alias("v"))
    instants = rows.groupBy("ts").agg(F.collect_list("v").alias("v"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            flat = pd.DataFrame([(i, r["symbol"], r["x"], r["y"]) for i, v in enumerate(f["v"]) for r in v], columns=["i", "symbol", "x", "y"]).drop_duplicates(["i", "symbol"])
            x, y = (flat.pivot(index="i", columns="symbol", values=k).astype(float) for k in "xy")
            mx, my = x.notna().to_numpy(float), y.notna().to_numpy(float)
            x0, y0 = x.fillna(0.0).to_numpy(), y.fillna(0.0).to_numpy()
            sums = dict(n=mx.T @ my, sx=x0.T @ my, sy=mx.T @ y0, sxx=(x0**2).T @ my, syy=mx.T @ y0**2, sxy=x0.T @ y0)
            names = list(x.columns)
            part = pd.DataFrame({"a": np.repeat(names, len(names)), "b": np.tile(names, len(names))} | {k: m.ravel() for k, m in sums.items()}).set_index(["a", "b"])
            total = part if total is None else total.add(part, fill_value=0.0)
        if total is not None:
            yield total.reset_index()

    parts = instants.select("v").mapInPandas(run, f"a {dict(means.dtypes)['symbol']}, b {dict(means.dtypes)['symbol']}, " + ", ".join(f"{k} double" for k in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    return parts.groupBy("a", "b").agg(*(F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy"))).where("n > 0")


def _moments() -> list:
    return [F.expr(e) for e in ("sxy - sx * sy / n", "sxx - sx * sx / n", "syy - sy * sy / n")]


def correlation_matrix(returns: DataFrame) -> DataFrame:
    """(a, b, corr, beta, n) of each pair of symbols over the instants they share; beta is a's on b. Null where one of them
    doesn't move."""
    sums = _pair_sums(returns.select("ts", "symbol", F.col("r").alias("x"), F.col("r").alias("y"))).where("a < b")
    xy, xx, yy = _moments()
    return sums.select("a", "b", (xy / F.nullif(F.sqrt(xx * yy), F.lit(0.0))).alias("corr"), (xy / F.nullif(yy, F.lit(0.0))).alias("beta"), F.col("n").cast("long").alias("n"))


def rolling_correlation(returns: DataFrame, a: str, b: str, n: int, block: int = BLOCK) -> DataFrame:
    """Correlation of two symbols over the last n common instants, null before there are n. Instants are numbered and cut
    into blocks; the last n - 1 of a block are seen by the next one too."""
    wide = returns.where(F.col("symbol").isin(a, b)).groupBy("ts").pivot("symbol", [a, b]).agg(F.first("r")).toDF("ts", "x", "y").where("x is not null and y is not null")
    size = max(block, n)
    rows = running(wide, [], ["ts"]).withColumn("own_", F.floor((F.col("n") - 1) / size))
    shared = F.pmod(F.col("n") - 1, F.lit(size)) > size - n
    rows = rows.withColumn("block_", F.explode(F.when(shared, F.array("own_", F.col("own_") + 1)).otherwise(F.array("own_"))))
    own = Window.partitionBy("block_").orderBy("n").rowsBetween(-(n - 1), 0)
    rows = rows.withColumn("corr", F.when(F.count("*").over(own) == n, F.corr("x", "y").over(own)))
    return rows.where("block_ = own_").select("ts", "x", "y", "corr")


def lead_lag(returns: DataFrame, lag: int = 1) -> DataFrame:
    """Correlation of each symbol's return with every other's `lag` instants before."""
    own = Window.partitionBy("symbol").orderBy("ts")
    sums = _pair_sums(returns.select("ts", "symbol", F.col("r").alias("x"), F.lag("r", lag).over(own).alias("y"))).where("a <> b")
    xy, xx, yy = _moments()
    return sums.select(F.col("b").alias("leader"), F.col("a").alias("follower"), (xy / F.nullif(F.sqrt(xx * yy), F.lit(0.0))).alias("corr"), F.col("n").cast("long").alias("n"))


def strength(bars: DataFrame, window: int, volatility: int, least: int, fewest: int, fill: int = 12) -> DataFrame:
    """Each symbol's move over `window` bars in units of its volatility, less the cross-section's mean, on the union of
    all instants with closes carried forward at most `fill` steps; null where fewer than `fewest` symbols have one."""
    rows = grid(bars).join(bars.select("symbol", "ts", "c"), ["symbol", "ts"], "left")
    own = Window.partitionBy("symbol").orderBy("ts")
    rows = rows.withColumn("p", F.log(F.last("c", ignorenulls=True).over(own.rowsBetween(-fill, 0))))
    rows = rows.withColumn("r", F.col("p") - F.lag("p").over(own))
    vol = own.rowsBetween(-(volatility - 1), 0)
    sd = F.when(F.count("r").over(vol) >= least, F.stddev_samp("r").over(vol))
    rows = rows.withColumn("z", (F.col("p") - F.lag("p", window).over(own)) / F.nullif(sd * window**0.5, F.lit(0.0)))
    at = Window.partitionBy("ts")
    return rows.select("symbol", "ts", F.when(F.count("z").over(at) >= fewest, F.col("z") - F.avg("z").over(at)).alias("strength"))
