"""Option positioning: max pain, gamma exposure and its flip, walls, ratios and implied volatilities.

Chains are (ticker, side call or put, strike, oi, volume, iv)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
RATE, MULTIPLIER, IV_MIN, IV_MAX = 0.04, 100, 0.01, 5.0


def max_pain(chain: DataFrame) -> DataFrame:
    """Strike at which least would be paid out, the lowest of equals; tickers without open interest give none.

    What is paid at a strike is linear between strikes, so running sums over the ordered strikes give it: no strike is
    paired with another."""
    s = chain.groupBy("ticker", "strike").agg(
        F.sum(F.when(F.col("side") == "call", F.coalesce("oi", F.lit(0.0))).otherwise(0.0)).alias("calls"), F.sum(F.when(F.col("side") == "put", F.coalesce("oi", F.lit(0.0))).otherwise(0.0)).alias("puts")
    )
    up = Window.partitionBy("ticker").orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("ticker").orderBy(F.desc("strike")).rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("strike")
    pain = k * F.sum("calls").over(up) - F.sum(F.col("calls") * k).over(up) + F.sum(F.col("puts") * k).over(down) - k * F.sum("puts").over(down)
    rows = s.withColumns({"pain": F.round(pain, 6), "all_": F.sum(F.col("calls") + F.col("puts")).over(Window.partitionBy("ticker"))}).where("all_ > 0")
    return rows.groupBy("ticker").agg(F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"), F.min("pain").alias("pain"))


def black_scholes_gamma(spot: Column, strike: Column, iv: Column, years: Column, rate: float = RATE) -> Column:
    """Gamma of an option; 0 where an input makes none."""
    t = F.greatest(years, F.lit(1e-4))
    d1 = (F.log(spot / strike) + (rate + 0.5 * iv * iv) * t) / (iv * F.sqrt(t))
    gamma = F.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) / (spot * iv * F.sqrt(t))
    return F.when((iv > 0) & (strike > 0) & (spot > 0), gamma).otherwise(0.0)


def gamma_exposure(chain: DataFrame, spot: str = "spot", years: str = "years") -> DataFrame:
    """Net dollar gamma by strike for a move of 1%: calls add, puts subtract."""
    iv = F.when(F.col("iv").between(IV_MIN, IV_MAX), F.col("iv"))
    g = F.coalesce(black_scholes_gamma(F.col(spot), F.col("strike"), iv, F.col(years)), F.lit(0.0))
    value = F.when(F.col("side") == "call", 1).otherwise(-1) * g * F.coalesce("oi", F.lit(0.0)) * MULTIPLIER * F.col(spot) * F.col(spot) * 0.01
    return chain.withColumn("v_", value).groupBy("ticker", "strike").agg(F.sum("v_").alias("gex"), F.max(spot).alias("spot"))


def gamma_flip(gex: DataFrame) -> DataFrame:
    """Where the running sum of exposure over the strikes changes sign, interpolated; of several the nearest to spot."""
    own = Window.partitionBy("ticker").orderBy("strike")
    rows = gex.withColumn("cum", F.sum("gex").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"cum0": F.lag("cum").over(own), "k0": F.lag("strike").over(own)}).where("cum0 * cum < 0")
    rows = rows.withColumn("at", F.col("k0") + (F.col("strike") - F.col("k0")) * -F.col("cum0") / (F.col("cum") - F.col("cum0")))
    return rows.groupBy("ticker").agg(F.min_by("at", F.struct(F.abs(F.col("at") - F.col("spot")), "at")).alias("flip"))


def walls(chain: DataFrame, top: int = 5) -> DataFrame:
    """The strikes with most open interest of each side."""
    s = chain.where("oi > 0").groupBy("ticker", "side", "strike").agg(F.sum("oi").alias("oi"))
    own = Window.partitionBy("ticker", "side").orderBy(F.desc("oi"), "strike")
    return s.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)


def chain_summary(chain: DataFrame, spot: str = "spot", years: str = "years") -> DataFrame:
    """Open interest and volume of both sides with their ratios, the volatility at the money, the move it implies and
    the skew of puts 3 to 7% below against calls 3 to 7% above."""
    iv = F.when(F.col("iv").between(IV_MIN, IV_MAX), F.col("iv"))
    call, put = F.col("side") == "call", F.col("side") == "put"
    near = chain.groupBy("ticker").agg(F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col(spot)), "strike")).alias("atm_"))
    rows = chain.join(near, "ticker").withColumn("iv_", iv)
    k, s = F.col("strike"), F.col(spot)
    out = rows.groupBy("ticker").agg(
        F.sum(F.when(call, F.col("oi"))).alias("call_oi"),
        F.sum(F.when(put, F.col("oi"))).alias("put_oi"),
        F.sum(F.when(call, F.col("volume"))).alias("call_volume"),
        F.sum(F.when(put, F.col("volume"))).alias("put_volume"),
        F.avg(F.when(k == F.col("atm_"), F.col("iv_"))).alias("atm_iv"),
        F.avg(F.when(put & k.between(s * 0.93, s * 0.97), F.col("iv_"))).alias("put_iv_"),
        F.avg(F.when(call & k.between(s * 1.03, s * 1.07), F.col("iv_"))).alias("call_iv_"),
        F.max(spot).alias("spot_"),
        F.max(years).alias("years_"),
    )
    return out.select(
        "ticker", "call_oi", "put_oi", (F.col("put_oi") / F.nullif("call_oi", F.lit(0.0))).alias("oi_ratio"), (F.col("put_volume") / F.nullif("call_volume", F.lit(0.0))).alias("volume_ratio"),
        "atm_iv", (F.col("spot_") * F.col("atm_iv") * F.sqrt("years_")).alias("expected_move"), (F.col("put_iv_") - F.col("call_iv_")).alias("skew"),
    )
