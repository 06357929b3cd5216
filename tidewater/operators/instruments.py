"""Names of instruments and horizons as people write them, price translation between related ones, and request routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Currencies that make pairs, words of the routing rules, timeframe words.
CURRENCIES = "USD EUR JPY GBP CHF AUD NZD CAD".split()
POSITION_WORDS = ["long", "short", "buy", "sell", "entry", "position", "stop loss", " sl ", " tp ", "take profit", "target", "scalp", "trade", "pip"]
RESEARCH_WORDS = ["research", "report", "compare", "strategy for", "market entry", "should we", "analyse the market for", "analyze the market for"]
SWING_WORDS = ["swing", "this week", "next week", "this month", "weeks", "fundamental", "macro", "hold for days", "position trade"]
INTRADAY_WORDS = ["today", "now", "scalp", "day trade", "daytrade", "intraday", "session", "london", "new york", "asia", "pip"]
FRAME_WORDS = {"5m": ["m5", "5m", "5min"], "15m": ["m15", "15m", "15min"], "1h": ["h1", "1h", "hourly"], "4h": ["h4", "4h"], "1d": ["d1", "1d", "daily"], "1wk": ["w1", "1w", "weekly"]}


def compact(raw: Column) -> Column:
    """Upper-cased without blanks, slashes, underscores, hyphens and dots."""
    return F.regexp_replace(F.upper(F.trim(raw)), r"[\s/_\-.]", "")


def resolve(names: DataFrame, raw: str, aliases: DataFrame) -> DataFrame:
    """Adds instrument and kind to names: that of an alias (alias, instrument), by the compact form or without its =X;
    a pair of two currencies; else a ticker that looks like one. Null where nothing fits or the name is over 40 long."""
    text = F.col(raw)
    key = F.regexp_replace(compact(text), "=X$", "")
    rows = names.withColumn("key_", F.when(F.char_length(F.trim(text)) <= 40, F.nullif(key, F.lit(""))))
    known = aliases.select(compact(F.col("alias")).alias("alias_"), F.col("instrument").alias("known_")).dropDuplicates(["alias_"])
    rows = rows.join(known, rows["key_"] == known["alias_"], "left")
    key = F.col("key_")
    pair = (F.char_length(key) == 6) & F.substring(key, 1, 3).isin(CURRENCIES) & F.substring(key, 4, 3).isin(CURRENCIES)
    ticker = F.regexp_replace(F.replace(F.replace(F.upper(F.trim(text)), F.lit(" "), F.lit("")), F.lit("/"), F.lit("-")), r"^([A-Z]{1,5})\.([A-Z])$", "$1-$2")
    fits = key.isNotNull() & ticker.rlike(r"^[\^A-Z0-9][A-Z0-9.\-=^]{0,14}$")
    return rows.withColumns({"instrument": F.when(F.col("known_").isNotNull(), F.col("known_")).when(pair, key).when(fits, ticker), "kind": F.when(F.col("known_").isNotNull(), "known").when(pair, "pair").when(fits, "ticker")}).drop("key_", "alias_", "known_")


def pip_size(instrument: Column, kind: Column) -> Column:
    """Price of a pip by instrument and kind (fx, index, commodity or other)."""
    return (
        F.when(instrument == "XAUUSD", 0.1).when(instrument == "XAGUSD", 0.01).when(kind == "fx", F.when(F.endswith(instrument, F.lit("JPY")), 0.01).otherwise(0.0001))
        .when((kind == "index") & ~instrument.isin("DXY", "VIX"), 1.0).otherwise(0.01)
    )


def spread_price(instrument: Column, kind: Column) -> Column:
    """Usual spread in price."""
    return F.when(instrument == "XAUUSD", 0.25).when(instrument == "XAGUSD", 0.03).when(kind == "fx", F.when(F.endswith(instrument, F.lit("JPY")), 0.01).otherwise(0.0001)).otherwise(0.0)


def horizon(text: Column, interval: Column) -> Column:
    """(interval, bars) of a horizon: a number counts bars of the interval; 30m, 4h, 2d and 1w are durations, days of one
    bar and weeks of five. Null for what is none."""
    s = F.lower(F.trim(text))
    n = F.regexp_extract(s, r"^(\d+)", 1).try_cast("int")
    unit = F.regexp_extract(s, r"^\d+\s*(m|min|h|hr|d|day|w|wk|week)s?$", 1)
    of = lambda i, k: F.struct(i.alias("interval"), k.cast("int").alias("bars"))
    minutes = F.when(interval == "5m", 5).when(interval == "30m", 30).otherwise(15)
    short = F.when(interval.isin("5m", "15m", "30m"), interval).otherwise("15m")
    hours = F.when((interval == "4h") & (n % 4 == 0), of(interval, n / 4)).otherwise(of(F.lit("1h"), n))
    return (
        F.when(s.rlike(r"^\d+$"), of(F.coalesce(interval, F.lit("1d")), F.greatest(n, F.lit(1))))
        .when(unit.isin("m", "min"), of(short, F.greatest(F.bround(n / minutes), F.lit(1))))
        .when(unit.isin("h", "hr"), hours)
        .when(unit.isin("d", "day"), of(F.lit("1d"), n))
        .when(unit != "", of(F.lit("1d"), 5 * n))
    )


def translate_level(level: Column, proxy: Column, under: Column, model: Column, duration: Column) -> Column:
    """A proxy's price level as one of what it stands for: by ratio, reciprocal, or duration for yields."""
    return F.when(model == "reciprocal", under * proxy / level).when(model == "duration", under - (level / proxy - 1) / F.coalesce(duration, F.lit(16.0)) * 100).otherwise(level * under / proxy)


def mentioned_frames(text: Column) -> Column:
    """Timeframes that a text names, in order of length."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, own))), frame) for frame, own in FRAME_WORDS.items()]))


def route(text: Column, attachments: Column, symbol: Column) -> Column:
    """(mode, style) of a request by its words: trading or research; daytrade or swing."""
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    frames = mentioned_frames(text)
    position, research = has(POSITION_WORDS), has(RESEARCH_WORDS)
    trading = ((attachments > 0) & ~research) | (symbol.isNotNull() & position) | (position & ~research & (F.size(frames) > 0))
    among = lambda own: F.arrays_overlap(frames, F.array(*map(F.lit, own)))
    swing = ~has(INTRADAY_WORDS) & ~among(["5m", "15m", "1h"]) & (has(SWING_WORDS) | among(["1d", "1wk"]))
    return F.struct(F.when(trading, "trading").otherwise("research").alias("mode"), F.when(swing, "swing").otherwise("daytrade").alias("style"))
