"""Columns of a feature matrix that carry state, labels for situations, series chosen and laid over each other, hybrid recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .bars import resample
from .indicators import by_symbol
from .reactions import legs
from .retrieval import fuse
from .signals import BREAK_TOL, FAKEOUT_BARS


def episode_counts(states: DataFrame, breaks: DataFrame, bars_with_atr: DataFrame) -> DataFrame:
    """(symbol, ts, i, sweeps_above, sweeps_below, fakeouts_above, fakeouts_below): how many there were so far in the box's
    life that a bar belongs to; 0 outside one. A sweep is a wick beyond the box of the bar before that closed inside."""
    own = by_symbol()
    rows = states.join(bars_with_atr.select("symbol", "ts", "h", "l", "c", "atr"), ["symbol", "ts"])
    rows = rows.withColumns({"p": F.lag(F.struct("top", "bottom", "status")).over(own), "tol": BREAK_TOL * F.coalesce(F.lag("atr").over(own), F.lit(0.0))})
    inside = F.col("p.status") == "inside"
    flags = {
        "sweeps_above": inside & (F.col("h") > F.col("p.top") + F.col("tol")) & (F.col("c") <= F.col("p.top") + F.col("tol")),
        "sweeps_below": inside & (F.col("l") < F.col("p.bottom") - F.col("tol")) & (F.col("c") >= F.col("p.bottom") - F.col("tol")),
    }
    back = breaks.where(F.col("back_i") - F.col("i") <= FAKEOUT_BARS).groupBy("symbol", F.col("back_i").alias("i")).agg(*(F.sum((F.col("side") == s).cast("int")).alias(n) for s, n in ((1, "fakeouts_above"), (-1, "fakeouts_below"))))
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)).cast("int") for k, v in flags.items()}).join(back, ["symbol", "i"], "left")
    life = Window.partitionBy("symbol", "episode").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    names = [*flags, "fakeouts_above", "fakeouts_below"]
    return rows.select("symbol", "ts", "i", *(F.when(F.col("episode") >= 0, F.coalesce(F.sum(k).over(life), F.lit(0))).otherwise(F.lit(0)).alias(k) for k in names))


def break_carry(bars: DataFrame, breaks: DataFrame) -> DataFrame:
    """Each bar with the last break up to it: brk_dir (0 for none), brk_age in bars and brk_edge."""
    rows = bars.select("symbol", "ts", (F.row_number().over(by_symbol()) - 1).alias("i"))
    rows = rows.join(breaks.select("symbol", "i", F.struct("side", "i", "edge").alias("b")), ["symbol", "i"], "left")
    last = F.last("b", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("b", last)
    return rows.select("symbol", "ts", F.coalesce("b.side", F.lit(0)).alias("brk_dir"), (F.col("i") - F.col("b.i")).alias("brk_age"), F.col("b.edge").alias("brk_edge"))


def break_labels(bars_with_atr: DataFrame, breaks: DataFrame, target: float, horizon: int = 48, rows_after: int = 3) -> DataFrame:
    """(symbol, i, break_i, fakeout, retest_then_continue) for each break and the bars up to rows_after on while it holds:
    did the break close back within FAKEOUT_BARS (on its own bar; null while not known), and does price come back to the
    edge and then run `target` beyond it within the horizon, before a close back inside (null where the horizon isn't
    complete)."""
    own = by_symbol()
    rows = bars_with_atr.withColumns({"i": F.row_number().over(own) - 1, "n": F.count("*").over(Window.partitionBy("symbol")), "ahead": F.collect_list(F.struct("h", "l", "c")).over(own.rowsBetween(1, horizon))})
    held = breaks.withColumn("last", F.least(F.col("i") + rows_after, F.coalesce(F.col("back_i") - 1, F.col("i") + rows_after)))
    held = held.select("symbol", F.col("i").alias("break_i"), "side", "edge", "back_i", F.explode(F.sequence(F.col("i"), F.col("last"))).alias("i"))
    out = held.join(rows.select("symbol", "i", "n", "atr", "ahead"), ["symbol", "i"])
    d = F.col("side")
    edge, tol = d * F.col("edge"), BREAK_TOL * F.coalesce("atr", F.lit(0.0))
    far, back = lambda x: F.when(d > 0, x["h"]).otherwise(-x["l"]), lambda x: F.when(d > 0, x["l"]).otherwise(-x["h"])
    place = lambda ok: F.transform("ahead", lambda x, k: F.when(ok(x), k))
    first = lambda ok: F.array_min(place(ok))
    out = out.withColumns({"closed": first(lambda x: d * x["c"] - edge <= 0), "touched": first(lambda x: back(x) - edge <= tol)})
    runs = F.exists(place(lambda x: far(x) - edge >= target), lambda k: F.coalesce((k > F.col("touched")) & (F.col("closed").isNull() | (k < F.col("closed"))), F.lit(False)))
    fake = F.when(F.coalesce(F.col("back_i") - F.col("break_i") <= FAKEOUT_BARS, F.lit(False)), 1).when(F.col("break_i") + FAKEOUT_BARS < F.col("n"), 0)
    return out.select("symbol", "i", "break_i", F.when(F.col("i") == F.col("break_i"), fake).alias("fakeout"), F.when(F.col("i") + horizon < F.col("n"), runs.cast("int")).alias("retest_then_continue"))


def last_impulse(bars: DataFrame, swings: DataFrame, near: float = 0.5) -> DataFrame:
    """Of each symbol the last impulse leg between swings (symbol, swing_i, kind, price, atr): direction, the bar it starts
    from in earnest (the last one within `near` average ranges of its origin), from, to, bars and size in average ranges."""
    moves = legs(swings).where("impulse").join(swings.select("symbol", "swing_i", "price", "atr").dropDuplicates(["symbol", "swing_i"]), ["symbol", "swing_i"])
    leg = moves.groupBy("symbol").agg(F.max_by(F.struct("swing_i", "to_i", "move", "price", "atr"), "swing_i").alias("g")).select("symbol", "g.*")
    body = F.when(F.col("move") > 0, F.least("o", "c")).otherwise(F.greatest("o", "c"))
    rows = bars.withColumn("i", F.row_number().over(by_symbol()) - 1).select("symbol", "i", "o", "c").join(F.broadcast(leg), "symbol").where("i > swing_i and i < to_i").withColumn("body", body)
    rows = rows.where(F.abs(F.col("body") - F.col("price")) <= near * F.col("atr"))
    start = rows.groupBy("symbol").agg(F.max_by(F.struct("i", "body"), "i").alias("s"))
    out = leg.join(start, "symbol", "left")
    begin, origin = F.coalesce("s.i", "swing_i"), F.coalesce("s.body", "price")
    end = F.col("price") + F.col("move")
    return out.select("symbol", F.when(F.col("move") > 0, "up").otherwise("down").alias("direction"), begin.alias("start_i"), F.col("to_i").alias("end_i"), origin.alias("from_price"), end.alias("to_price"), F.greatest(F.col("to_i") - begin, F.lit(1)).alias("bars"), (F.abs(end - origin) / F.col("atr")).alias("size_atr"))


def related_lagged(target: DataFrame, related: DataFrame, by: list[str], name: str) -> DataFrame:
    """target (.., ts) with the related series' (.., ts, value) last value at the bar before: filled forward onto the
    target's bars, then one bar back, so that nothing of the same bar is seen."""
    rows = asof_join(target, related.withColumnRenamed("value", name), by, "ts", "ts", [name])
    return rows.withColumn(name, F.lag(name).over(Window.partitionBy(*by).orderBy("ts")))


def overlay(bars: DataFrame, minutes: DataFrame, interval: str) -> DataFrame:
    """Bars whose own days the minute series covers take its prices; others keep theirs; v stays. covered tells which."""
    days = minutes.select("symbol", F.to_date("ts").alias("day")).distinct()
    deep = resample(minutes, interval).select("symbol", "ts", *(F.col(k).alias(f"{k}_") for k in "ohlc"))
    rows = bars.withColumn("day", F.to_date("ts")).join(days.withColumn("covered", F.lit(True)), ["symbol", "day"], "left").join(deep, ["symbol", "ts"], "left")
    takes = F.coalesce(F.col("covered") & F.col("c_").isNotNull(), F.lit(False))
    return rows.select("symbol", "ts", *(F.when(takes, F.col(f"{k}_")).otherwise(F.col(k)).alias(k) for k in "ohlc"), "v", takes.alias("covered"))


def first_source(series: DataFrame, least: int = 2) -> DataFrame:
    """Of each symbol the bars of the source (rank) that comes first among those with enough bars."""
    usable = series.groupBy("symbol", "rank").agg(F.count("*").alias("n")).where(F.col("n") >= least).groupBy("symbol").agg(F.min("rank").alias("rank"))
    return series.join(usable, ["symbol", "rank"], "left_semi")


def recall(lexical: DataFrame, semantic: DataFrame, memories: DataFrame, weight: Column, limit: int, least: float = 0.25) -> DataFrame:
    """Hybrid recall: two ranked lists (query_id, doc_id, rank; semantic with score, from `least` on) fused by reciprocal
    rank, each hit's score times the weight of its memory (doc_id, ..), the best `limit` of each query with their rank."""
    near = semantic.where(F.col("score") >= least)
    hits = fuse(near, lexical).join(memories, "doc_id").withColumn("score", F.col("score") * weight)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= limit).select("query_id", "doc_id", "score", "rank")
