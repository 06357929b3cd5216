"""Picks, ranks and scores: levels around a price, zone statistics and scores, policy search, composites, priors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running
from .outcomes import wilson

#: Weights of the composite, and of a zone's score.
COMPOSITE = {"tp1": 0.40, "tp2": 0.10, "cont_after_pullback": 0.15, "ht1_cont_after_pullback": 0.15, "retest_then_continue": 0.10, "fakeout": 0.10}
AGAINST = ("fakeout",)
HOLDS, BREAKS, RELIABLE = ("rejection", "sweep", "retest_hold"), ("break", "retest_fail"), 30
STATUS_ORDER = ("retest_in_progress", "broken_awaiting_retest", "awaiting_break")


def _ranked(rows: DataFrame, name: str, by: list[str], *order: Column) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def nearest_each_side(levels: DataFrame, by: list[str], level: str, last: str, most: int = 5) -> DataFrame:
    """The `most` levels nearest to the last price below it (support) and from it on (resistance), with their rank."""
    rows = levels.withColumn("side", F.when(F.col(level) < F.col(last), "support").otherwise("resistance"))
    return _ranked(rows, "rank", [*by, "side"], F.abs(F.col(level) - F.col(last)), F.col(level)).where(F.col("rank") <= most)


def near_and_strong(zones: DataFrame, by: list[str], level: str, last: str, score: str, most: int = 6) -> DataFrame:
    """On each side of the last price the most // 2 nearest levels and the strongest of the rest, `most` in all."""
    rows = zones.withColumn("side", F.when(F.col(level) > F.col(last), "above").otherwise("below"))
    rows = _ranked(rows, "near_", [*by, "side"], F.abs(F.col(level) - F.col(last)), F.col(level)).withColumn("first_", F.col("near_") <= most // 2)
    rows = _ranked(rows, "strong_", [*by, "side", "first_"], F.desc(score), F.col("near_"))
    return rows.where(F.col("first_") | (F.col("strong_") <= most - most // 2)).drop("near_", "first_", "strong_")


def active_levels(levels: DataFrame, by: list[str], level: str, last: str, most: int = 12) -> DataFrame:
    """The `most` levels nearest to the last price, ranked by their status, then distance."""
    distance = F.abs(F.col(level) - F.col(last))
    rows = _ranked(levels, "near_", by, distance, F.col(level), F.col("status")).where(F.col("near_") <= most)
    place = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    return _ranked(rows, "rank", by, place, distance, F.col(level)).drop("near_")


def touches_bucket(n: Column) -> Column:
    return F.when(n < 3, n.cast("string")).otherwise("3+")


def bucket_stats(touches: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, bucket, n, p_hold, p_break, ci_low, ci_high, median_hold, median_break, unreliable, clear_of_half) of
    decided touches (kind, follow), in all (dimension overall) and for each dimension's buckets. All dimensions take one
    shuffle of partial groups."""
    decided = touches.where(F.col("kind").isin(*HOLDS, *BREAKS))
    named = [F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("bucket")) for k, c in ({"overall": F.lit("all")} | dimensions).items()]
    held = F.col("kind").isin(*HOLDS)
    rows = decided.select(F.explode(F.array(*named)).alias("d"), held.alias("held"), "follow").select("d.*", "held", "follow")
    middle = lambda ok: F.percentile(F.when(ok, F.col("follow")), F.lit(0.5))
    out = rows.groupBy("dimension", "bucket").agg(F.count("*").alias("n"), F.sum(F.col("held").cast("int")).alias("holds"), middle(F.col("held")).alias("median_hold"), middle(~F.col("held")).alias("median_break"))
    low, high = wilson(F.col("holds"), F.col("n"))
    share = F.col("holds") / F.col("n")
    return out.withColumns({"p_hold": share, "p_break": 1 - share, "ci_low": low, "ci_high": high, "unreliable": F.col("n") < RELIABLE, "clear_of_half": (F.col("n") >= RELIABLE) & ((low > 0.5) | (high < 0.5))}).drop("holds")


def zone_score(holds: Column, flips: Column, confluence: Column, age_days: Column, through: Column) -> Column:
    """Respected touches, role flips, timeframes and recency, less closes through, to two places."""
    recency = F.round(2.0 * F.exp(-F.greatest(age_days, F.lit(0.0)) / 3), 2)
    return F.round(F.least(holds, F.lit(5)) + 1.5 * F.least(flips, F.lit(3)) + confluence + recency - 0.75 * through, 2)


def extreme_status(beyond_close: Column, beyond_wick: Column) -> Column:
    """break if a bar closed beyond a level, sweep if only a wick went there, else untouched; booleans over the bars."""
    return F.when(F.coalesce(beyond_close, F.lit(False)), "break").when(F.coalesce(beyond_wick, F.lit(False)), "sweep").otherwise("untouched")


def session_character(spread: Column, net: Column, direction: Column, high: Column, low: Column, held_retests: Column) -> Column:
    """What kind of session it was, from its range, net move and what it did to the extremes before it."""
    up, down = direction == "up", direction == "down"
    broke = F.when((high == "break") & up, "up").when((low == "break") & down, "down")
    return (
        F.when((high == "sweep") & (low != "break") & down, "sweep high then reverse")
        .when((low == "sweep") & (high != "break") & up, "sweep low then reverse")
        .when((high == "sweep") & (low == "sweep"), "swept both sides (range)")
        .when(broke.isNotNull() & (held_retests > 0), F.concat(F.lit("breakout "), broke, F.lit(" + retest hold")))
        .when((spread > 0) & (F.abs(net) >= 0.6 * spread) & (up | down), F.concat(F.lit("trend "), direction))
        .when(broke.isNotNull(), F.concat(F.lit("breakout "), broke))
        .when((high == "break") & (low == "break"), "expansion both ways")
        .otherwise("range")
    )


def composite(nouls: Column, directions: Column, side: str) -> Column:
    """Weighted mean of what a map of yes-probabilities says for one side, buy or sell; weights are those of the parts at
    hand. Targets count for their own side, patterns for the side that the map of directions names."""
    buy = side == "buy"
    parts = []
    for tag in ("tp1", "tp2"):
        own, other = (f"long_{tag}", f"short_{tag}") if buy else (f"short_{tag}", f"long_{tag}")
        parts.append(F.when(nouls[own].isNotNull() & nouls[other].isNotNull(), F.struct(F.lit(COMPOSITE[tag]).alias("w"), nouls[own].alias("q"))))
    for tag in list(COMPOSITE)[2:]:
        up = (directions[tag] > 0) != F.lit(tag in AGAINST)
        q = F.when(up if buy else ~up, nouls[tag]).otherwise(1 - nouls[tag])
        parts.append(F.when(nouls[tag].isNotNull() & (directions[tag] != 0), F.struct(F.lit(COMPOSITE[tag]).alias("w"), q.alias("q"))))
    there = F.array_compact(F.array(*parts))
    total = lambda f: F.aggregate(there, F.lit(0.0), lambda s, x: s + f(x))
    return F.when(F.size(there) > 0, total(lambda x: x["w"] * x["q"]) / total(lambda x: x["w"]))


def skill_prior(accepted: Column, revised: Column, hits: Column, misses: Column) -> Column:
    """0.9 to 1.1 by the share of good outcomes, 1 under three of them."""
    total = accepted + revised + hits + misses
    return F.when(total >= 3, 0.9 + 0.2 * (accepted + hits) / total).otherwise(1.0)


def scan_rank(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Decisions by what they are expected to earn, then by how likely they beat break-even; ties keep the order of ids."""
    return _ranked(decisions, "rank", by or [], F.desc("best_expected_r"), F.desc("p_above"), F.col("id"))


def tune_thresholds(rows: DataFrame, margins: list[float], confidences: list[float], fewest: int, by: list[str]) -> DataFrame:
    """Of all pairs of thresholds the one whose trades earn most on average, for each group of rows (edge, confidence,
    most_likely, r): margin, certainty, n, mean_r; ties go to more trades, then lower thresholds. Pairs with fewer
    trades don't count, nor does a best that loses.

    A row counts for all pairs up to its own: rows are first summed by the largest pair they reach, at most one sum for
    each pair, and these few are added up over the grid."""
    place = lambda c, grid: F.aggregate(F.array(*map(F.lit, grid)), F.lit(-1), lambda n, g: n + (c >= g).cast("int"))
    reached = rows.where("most_likely").select(*by, place(F.col("edge"), margins).alias("m"), place(F.col("confidence"), confidences).alias("k"), "r").where("m >= 0 and k >= 0")
    sums = reached.groupBy(*by, "m", "k").agg(F.count("*").alias("n"), F.sum("r").alias("total"))
    cells = sums.withColumn("m", F.explode(F.sequence(F.lit(0), "m"))).withColumn("k", F.explode(F.sequence(F.lit(0), "k"))).groupBy(*by, "m", "k").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    cells = cells.where(F.col("n") >= fewest).withColumn("mean_r", F.col("total") / F.col("n"))
    at = lambda grid, c: F.element_at(F.array(*map(F.lit, grid)), F.col(c) + 1)
    best = cells.groupBy(*by).agg(F.max_by(F.struct(at(margins, "m").alias("margin"), at(confidences, "k").alias("certainty"), "n", "mean_r"), F.struct("mean_r", "n", -F.col("m"), -F.col("k"))).alias("best"))
    return best.select(*by, "best.*").where("mean_r > 0")


def consolidation_queue(memories: DataFrame, by: list[str], most: int = 24) -> DataFrame:
    """The most important, then newest memories that wait to be consolidated: no observations, none superseded."""
    waiting = memories.where("consolidated_at is null and kind <> 'observation' and superseded_by is null")
    return _ranked(waiting, "rank", by, F.desc("importance"), F.desc("created_at"), F.col("id")).where(F.col("rank") <= most)


def time_folds(rows: DataFrame, start: str, end: str, splits: int, gap: int) -> DataFrame:
    """(.., fold, part): folds over the distinct starts, equal blocks at the end as `calibrate`, each with all rows before
    it but the last `gap` starts as `train`, of these only rows that have ended by the block's first start. Starts are
    numbered by their place among the distinct ones, so one start is never split."""
    distinct = running(rows.select(start).distinct(), [], [start]).select(start, (F.col("n") - 1).alias("at_"))
    n = distinct.agg(F.count("*").alias("n_"))
    size = F.floor(F.col("n_") / (splits + 1))
    folds = n.select("n_", size.alias("size_"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("fold")).withColumn("first_", F.col("n_") - (splits - F.col("fold")) * F.col("size_"))
    firsts = folds.join(distinct, F.col("first_") == F.col("at_")).select("fold", "first_", "size_", F.col(start).alias("opens_"))
    placed = rows.join(distinct, start).join(F.broadcast(firsts))
    train = (F.col("at_") < F.col("first_") - gap) & (F.col(end) <= F.col("opens_"))
    test = (F.col("at_") >= F.col("first_")) & (F.col("at_") < F.col("first_") + F.col("size_"))
    return placed.withColumn("part", F.when(test, "calibrate").when(train, "train")).where("part is not null").drop("at_", "first_", "size_", "opens_")


def thompson(wins: Column, losses: Column, seed: int, prior: float = 1.0) -> Column:
    """A draw of the rate that so many wins and losses leave likely; the same for the same counts and seed."""

    def draw(w: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(a), int(b)]).beta(a + prior, b + prior) for a, b in zip(w, n, strict=True)])

    return F.pandas_udf(draw, "double")(wins.cast("long"), losses.cast("long"))


def place_in_box(price: Column, top: Column, bottom: Column) -> Column:
    """above, below, near_top or near_bottom (a quarter of the height), or mid_box; a flat box has only a middle."""
    share = F.when(top > bottom, (price - bottom) / (top - bottom) * 100).otherwise(50.0)
    return F.when(share > 100, "above").when(share < 0, "below").when(share >= 75, "near_top").when(share <= 25, "near_bottom").otherwise("mid_box")


def entry_direction(mode: Column, direction: Column, place: Column, own: Column) -> Column:
    """1 for a purchase, -1 for a sale, 0 for no entry: the plan's direction for breaks and pullbacks, away from the edge
    in a range, else this timeframe's own direction."""
    edge = F.when(place == "near_top", -1).when(place == "near_bottom", 1).otherwise(0)
    return F.when(mode.isin("break_retest", "trend_pullback"), F.when(direction == "long", 1).otherwise(-1)).when(mode == "range", edge).otherwise(own)


def risk_factors(stop: Column, atr: Column, news_minutes: Column, place: Column, entry: Column, higher: Column, fakeouts: Column, sessions: Column, asia_open: Column, market_open: Column, age_bars: Column, news_within: float = 60.0) -> Column:
    """Struct of the seven conditions that make an entry risky; unknown ones are false."""
    known = lambda c: F.coalesce(c, F.lit(False))
    active = lambda name: known(F.array_contains(sessions, name))
    return F.struct(
        known((atr > 0) & (stop < 0.5 * atr)).alias("stop_inside_noise"),
        known(F.abs(news_minutes) <= news_within).alias("news_near"),
        known(place == "mid_box").alias("mid_box"),
        known((entry != 0) & (higher != 0) & (entry != higher)).alias("against_higher_timeframe"),
        known(fakeouts >= 2).alias("fakeouts_on_box"),
        (~active("London") & ~active("New York") & ~known(asia_open)).alias("thin_session"),
        (known(~market_open) | known(age_bars > 2)).alias("closed_or_stale"),
    )


def risk_level(factors: Column, names: list[str]) -> Column:
    """high from three conditions on, medium from one, else low."""
    n = sum((factors[k].cast("int") for k in names), F.lit(0))
    return F.when(n >= 3, "high").when(n >= 1, "medium").otherwise("low")


def nearest_zones(bars: DataFrame, zones: DataFrame) -> DataFrame:
    """Each bar (symbol, i, c) with the nearest zone alive then on either side: below (at or under the close) and above.
    Zones (symbol, price, born_i, dead_i) are alive from born_i until before dead_i.

    Bars meet zones by equality on buckets of time that a zone's life touches: what a bar sees is bounded by the zones
    alive in its bucket, and the two extremes are a partial aggregate."""
    bucket = 256
    spread = zones.where("dead_i > born_i").withColumn("b_", F.explode(F.sequence(F.floor(F.col("born_i") / bucket), F.floor((F.col("dead_i") - 1) / bucket))))
    rows = bars.select("symbol", "i", "c", F.floor(F.col("i") / bucket).alias("b_"))
    met = rows.join(spread, ["symbol", "b_"]).where("i >= born_i and i < dead_i")
    near = met.groupBy("symbol", "i").agg(F.max(F.when(F.col("price") <= F.col("c"), F.col("price"))).alias("below"), F.min(F.when(F.col("price") > F.col("c"), F.col("price"))).alias("above"))
    return bars.join(near, ["symbol", "i"], "left")
