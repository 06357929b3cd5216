"""Calibration and decisions: reliability, scores, skill over blocks, ranks, tiers, stakes and evidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running, tile

BINS, EPS = 10, 1e-12
#: One-sided 95% quantiles of Student's t by degrees of freedom, 1 to 19.
T_95 = (6.313752, 2.919986, 2.353363, 2.131847, 2.015048, 1.943180, 1.894579, 1.859548, 1.833113, 1.812461, 1.795885, 1.782288, 1.770933, 1.761310, 1.753050, 1.745884, 1.739607, 1.734064, 1.729133)
#: Fixed values of the decision policy.
ACT_MARGIN, ACT_CONFIDENCE, CONFIRM_MARGIN = 0.05, 0.15, 0.02
KELLY_SHARE, KELLY_CAP = 0.25, 0.02


def probability_bin(p: Column, bins: int = BINS) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(p * bins).cast("int")))


def reliability(rows: DataFrame, by: list[str], p: str, y: str, bins: int = BINS) -> DataFrame:
    """Count, mean probability and observed rate of each probability bin; bins without rows are there with count 0."""
    got = rows.groupBy(*by, probability_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))
    every = rows.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(got, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def calibration_error(rows: DataFrame, by: list[str], p: str, y: str, bins: int = BINS) -> DataFrame:
    """Mean gap between probability and rate over the bins, by their shares of rows."""
    table = reliability(rows, by, p, y, bins).where("n > 0").groupBy(*by)
    return table.agg((F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n")).alias("ece"))


def binary_scores(rows: DataFrame, by: list[str], p: str, y: str, base: str) -> DataFrame:
    """Brier score, log loss and accuracy of a probability, and its skill over a base-rate forecast."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - EPS)), F.lit(EPS))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"),
        F.avg(F.pow(F.col(base) - F.col(y), 2)).alias("brier_base"),
        F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"),
        F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("int")).alias("accuracy"),
    )
    return out.withColumn("skill", F.when(F.col("brier_base") > 0, 1 - F.col("brier") / F.col("brier_base")))


def block_skill(rows: DataFrame, by: list[str], gain: str, order: list[str], blocks: int = 20) -> DataFrame:
    """Is a mean gain over contiguous blocks reliably above 0: mean of block means, and its one-sided 95% lower bound."""
    means = running(rows, by, order).withColumn("block", tile(F.col("n"), F.col("of"), blocks)).groupBy(*by, "block").agg(F.avg(gain).alias("m"))
    out = means.groupBy(*by).agg(F.avg("m").alias("mean_gain"), F.stddev_samp("m").alias("sd_"), F.count("*").alias("blocks"))
    t = F.element_at(F.array(*map(F.lit, T_95)), F.least(F.greatest(F.col("blocks") - 1, F.lit(1)), F.lit(19)).cast("int"))
    out = out.withColumn("lower", F.col("mean_gain") - t * F.col("sd_") / F.sqrt("blocks")).drop("sd_")
    return out.withColumn("skilled", (F.col("mean_gain") > 0) & (F.col("lower") > 0))


def rank_auc(rows: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    """Probability that a positive row outranks a negative one, ties by half. Scores are first counted by value, so only
    distinct values are ordered."""
    counts = rows.groupBy(*by, score).agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pairs = counts.withColumn("won_", F.col("pos") * (below + F.col("neg") / 2))
    return pairs.groupBy(*by).agg((F.sum("won_") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def base_rates(rows: DataFrame, segment: str, y: str, least: int = 50) -> DataFrame:
    """Rate of each segment with at least `least` rows, the pooled rate for others."""
    pooled = rows.agg(F.avg(y).alias("pooled_"))
    out = rows.groupBy(segment).agg(F.count("*").alias("n"), F.avg(y).alias("own_")).join(F.broadcast(pooled))
    return out.select(segment, "n", F.when(F.col("n") >= least, F.col("own_")).otherwise(F.col("pooled_")).alias("rate"))


def break_even(stop: Column, target: Column, cost: Column) -> Column:
    return (stop + cost) / (stop + target)


def expected_r(p: Column, stop: Column, target: Column, cost: Column) -> Column:
    return p * target / stop - (1 - p) - cost / stop


def tiers(rows: DataFrame, stop: float, target: float, cost: Column) -> DataFrame:
    """Side, edge over break-even, confidence and tier (act, confirm, hold) of (p_hold, p_buy, p_sell)."""
    rows = rows.withColumn("side", F.when(F.col("p_buy") >= F.col("p_sell"), "buy").otherwise("sell")).withColumn("p", F.greatest("p_buy", "p_sell"))
    top = F.greatest("p_hold", "p_buy", "p_sell")
    rows = rows.withColumns({"edge": F.col("p") - break_even(F.lit(stop), F.lit(target), cost), "confidence": F.least(F.greatest((top - 1 / 3) / (2 / 3), F.lit(0.0)), F.lit(1.0))})
    act = (F.col("p") > F.col("p_hold")) & (F.col("edge") >= ACT_MARGIN) & (F.col("confidence") >= ACT_CONFIDENCE)
    return rows.withColumn("tier", F.when(act, "act").when(F.col("edge") >= CONFIRM_MARGIN, "confirm").otherwise("hold"))


def kelly(p: Column, b: Column) -> Column:
    """Growth-optimal stake at odds b, not below 0."""
    return F.when(b > 0, F.greatest(F.lit(0.0), p - (1 - p) / b)).otherwise(0.0)


def stake(p: Column, b: Column) -> Column:
    return F.least(F.lit(KELLY_CAP), kelly(p, b) * KELLY_SHARE)


def log_growth(p: Column, b: Column, f: Column) -> Column:
    return F.when(f <= 0, 0.0).when(f < 1, p * F.log1p(f * b) + (1 - p) * F.log1p(-f))


def binomial_tail(wins: Column, n: Column, p: Column) -> Column:
    """P(X >= wins) of n trials with success rate p (0 < p < 1), exactly: a fold over the terms' logarithms."""
    step = lambda s, k: F.struct((s["t"] + F.log((n - k + 1) / k) + F.log(p / (1 - p))).alias("t"), (s["sum"] + F.when(k >= wins, F.exp(s["t"] + F.log((n - k + 1) / k) + F.log(p / (1 - p)))).otherwise(0.0)).alias("sum"))
    first = n * F.log(1 - p)
    start = F.struct(first.cast("double").alias("t"), F.when(wins <= 0, F.exp(first)).otherwise(F.lit(0.0)).cast("double").alias("sum"))
    return F.when(n > 0, F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, step)["sum"]))


def posterior_above(wins: Column, losses: Column, p0: Column, prior: int = 1) -> Column:
    """Mass of the Beta posterior (integer prior) of a win rate above p0: a binomial tail, by their identity."""
    a, b = wins + prior, losses + prior
    # P(Beta(a, b) > p0) = P(Binomial(a + b - 1, p0) < a)
    return 1 - binomial_tail(a, a + b - 1, p0)


def trades_needed(p1: Column, p0: Column, z_alpha: float = 1.6448536, z_power: float = 0.8416212) -> Column:
    """Trades that tell a true rate p1 from p0 at 5% and with power 80%; null unless p1 is above p0."""
    root = (z_alpha * F.sqrt(p0 * (1 - p0)) + z_power * F.sqrt(p1 * (1 - p1))) / (p1 - p0)
    return F.when((p1 > p0) & (p1 < 1), F.ceil(root * root))


def choice_confidence(p: Column) -> Column:
    """How far the largest of an array of probabilities stands above an even spread, 0 to 1."""
    n = F.size(p)
    return F.when(n < 2, F.when(n == 1, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.array_max(p) - 1 / n) / (1 - 1 / n))))


def score_confidence(p: Column) -> Column:
    """1 less the mean distance from the most likely level over that of an even spread, not below 0."""
    n = F.size(p)
    top = F.array_position(p, F.array_max(p)) - 1
    spread = F.aggregate(F.transform(p, lambda x, i: x * F.abs(i - top)), F.lit(0.0), lambda s, x: s + x)
    even = F.aggregate(F.transform(p, lambda x, i: F.abs(i - (n - 1) / 2)), F.lit(0.0), lambda s, x: s + x) / n
    return F.when(n < 2, F.when(n == 1, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - spread / even))


def ledger(decisions: DataFrame, p: str = "p", won: str = "won") -> DataFrame:
    """Wins and losses by side and probability bin; a decision reported again counts once."""
    once = decisions.dropDuplicates(["decision_id"])
    return once.groupBy("side", probability_bin(F.col(p)).alias("bin")).agg(F.sum(F.col(won).cast("int")).alias("wins"), F.sum((~F.col(won)).cast("int")).alias("losses"))


def proportion_gap(a_wins: Column, a_n: Column, b_wins: Column, b_n: Column) -> Column:
    """Pooled z of the difference of two rates; null without rows or spread."""
    pooled = (a_wins + b_wins) / (a_n + b_n)
    return (a_wins / a_n - b_wins / b_n) / F.nullif(F.sqrt(pooled * (1 - pooled) * (1 / a_n + 1 / b_n)), F.lit(0.0))


def trade_stats(taken: DataFrame, by: list[str]) -> DataFrame:
    """Of trades (side, won, r, breakeven) in each group: counts, rate with interval, mean break-even rate, mean and sum
    of r, purchases and sales."""
    from .outcomes import wilson

    out = taken.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col("won").cast("int")).alias("wins"), F.avg("breakeven").alias("breakeven_rate"), F.avg("r").alias("mean_r"), F.sum("r").alias("total_r"),
        *(F.sum((F.col("side") == s).cast("int")).alias(f"{s}s") for s in ("buy", "sell")),
    )
    low, high = wilson(F.col("wins"), F.col("n"))
    return out.withColumns({"win_rate": F.col("wins") / F.col("n"), "ci_low": low, "ci_high": high})


def slices(rows: DataFrame, segment: str, year: Column, p: str, y: str, least: int = 50) -> DataFrame:
    """(slice, value, n, rate, mean_p, brier) over all rows, each segment and each year, in one grouping pass; slices
    under `least` rows go."""
    keyed = rows.select(F.col(segment).cast("string").alias("segment"), year.cast("string").alias("year"), F.col(p).alias("p"), F.col(y).alias("y"))
    out = keyed.groupingSets([[F.col("segment")], [F.col("year")], []], F.col("segment"), F.col("year")).agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("y").alias("rate"), F.avg("p").alias("mean_p"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier")
    )
    name = F.when(F.col("g") == 1, "segment").when(F.col("g") == 2, "year").otherwise("all")
    return out.where(F.col("n") >= least).select(name.alias("slice"), F.coalesce(F.when(F.col("g") == 1, F.col("segment")), F.when(F.col("g") == 2, F.col("year")), F.lit("all")).alias("value"), "n", "rate", "mean_p", "brier")


def cap_tier(n: Column, wins: Column, breakeven: Column, mean_r: Column, fewest: int = 30) -> Column:
    """The highest tier that a holdout's trades allow: act where enough of them earn and the interval's lower end beats
    break-even, else confirm."""
    from .outcomes import wilson

    low, _ = wilson(wins, n)
    return F.when((n >= fewest) & (F.coalesce(mean_r, F.lit(0.0)) > 0) & (low > breakeven), "act").otherwise("confirm")
