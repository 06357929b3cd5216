"""Bars from ticks or finer bars: regular, local-grid, trade-date and calendar bins; repair, gaps and stitching.

Every function takes and returns DataFrames of (symbol, ts, o, h, l, c, v); ts is a bar's open. Aggregations are
partial before their one shuffle on (symbol, bin); what follows by window is partitioned by symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals by name, with the hours of a bar; note that 1m is a month and 1min a minute.
INTERVAL_HOURS = {"1min": 1 / 60, "5m": 5 / 60, "15m": 0.25, "30m": 0.5, "1h": 1, "4h": 4, "1d": 24, "1wk": 168, "1mo": 720}
NEW_YORK = "America/New_York"


def ticks(rows: DataFrame, symbol: str, ts: str, price: str, seq: str) -> DataFrame:
    """(symbol, ts, price, seq); seq orders ticks of one instant."""
    return rows.select(F.col(symbol).alias("symbol"), F.col(ts).cast("timestamp").alias("ts"), F.col(price).alias("price"), F.col(seq).alias("seq"))


def bin_start(ts: Column, interval: str) -> Column:
    """Left edge of the bin that holds ts: epoch-aligned up to a day, Mondays for weeks, first days for months."""
    if interval == "1wk":
        return F.date_trunc("week", ts)
    if interval == "1mo":
        return F.date_trunc("month", ts)
    seconds = round(INTERVAL_HOURS[interval] * 3600)
    epoch = F.unix_timestamp(ts)
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))


def from_ticks(t: DataFrame, interval: str) -> DataFrame:
    """Bars of ticks; v counts them; bins without ticks give no bar."""
    order = F.struct("ts", "seq")
    return (
        t.groupBy("symbol", bin_start(F.col("ts"), interval).alias("bin"))
        .agg(F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.count("*").cast("double").alias("v"))
        .withColumnRenamed("bin", "ts")
    )


def _rebin(bars: DataFrame, start: Column) -> DataFrame:
    return (
        bars.groupBy("symbol", start.alias("bin"))
        .agg(F.min_by("o", "ts").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "ts").alias("c"), F.sum("v").alias("v"))
        .withColumnRenamed("bin", "ts")
    )


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Coarser bars of finer ones."""
    return _rebin(bars, bin_start(F.col("ts"), interval))


def resample_local(bars: DataFrame, hours: int = 4, offset: int = 1, zone: str = NEW_YORK) -> DataFrame:
    """Bins on a grid of local hours shifted by `offset`, labelled by the instant of their local start. Bins whose local
    start happens twice, when clocks go back, are left out."""
    local = F.unix_timestamp(F.from_utc_timestamp("ts", zone))
    step, shift = hours * 3600, offset * 3600
    start = F.timestamp_seconds(local - F.pmod(local - shift, F.lit(step)))
    first = F.to_utc_timestamp(start, zone)
    twice = F.from_utc_timestamp(first + F.expr("interval 1 hour"), zone) == start
    return _rebin(bars.where(~twice), first)


def trade_days(bars: DataFrame, zone: str = NEW_YORK, roll_hours: int = 7) -> DataFrame:
    """Daily bars by trade date, the local date `roll_hours` ahead of the clock; weekends give none."""
    day = F.date_trunc("day", F.from_utc_timestamp("ts", zone) + F.expr(f"interval {roll_hours} hours"))
    return _rebin(bars.where(F.weekday(day) < 5), day)


def normalize(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Repaired bars: of repeats of an instant the last in seq; null o, h, l take c and null v takes 0; h and l hold o
    and c; bars without a finite c go."""
    last = Window.partitionBy("symbol", "ts").orderBy(F.desc(seq))
    known = F.col("c").isNotNull() & ~F.isnan("c") & (F.abs("c") < float("inf"))
    of = lambda x: F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.col("c"))
    rows = rows.where(known).withColumn("n_", F.row_number().over(last)).where("n_ = 1")
    rows = rows.select("symbol", "ts", of(F.col("o")).alias("o"), of(F.col("h")).alias("h"), of(F.col("l")).alias("l"), "c", F.coalesce("v", F.lit(0.0)).alias("v"))
    return rows.select("symbol", "ts", "o", F.greatest("h", "o", "c").alias("h"), F.least("l", "o", "c").alias("l"), "c", "v")


def market_open(ts: Column, zone: str = NEW_YORK) -> Column:
    """Whether the currency market is open: Sunday 17:00 to Friday 17:00, local time."""
    local = F.from_utc_timestamp(ts, zone)
    day, hour = F.weekday(local), F.hour(local)
    return ~((day == 5) | (day == 4) & (hour >= 17) | (day == 6) & (hour < 17))


def close_time(ts: Column, interval: str, mode: str = "utc") -> Column:
    """When a bar that opens at ts closes: its duration later; days at 17:00 (fx) or 16:00 (us) New York time of their
    date, else the next UTC midnight; weeks after five days; months at the next month's start."""
    if interval == "1mo":
        return F.add_months(F.trunc(ts, "month"), 1).cast("timestamp")
    days = {"1d": 0, "1wk": 4}.get(interval)
    if days is None:
        return ts + F.expr(f"interval {round(INTERVAL_HOURS[interval] * 3600)} seconds")
    day = F.date_add(F.to_date(ts), days)
    if mode == "utc":
        return F.date_add(day, 1).cast("timestamp")
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr(f"interval {17 if mode == 'fx' else 16} hours"), NEW_YORK)


def closed(bars: DataFrame, interval: str, as_of: Column, mode: str = "utc") -> DataFrame:
    """Bars that have closed by as_of."""
    return bars.where(close_time(F.col("ts"), interval, mode) <= as_of)


def gaps(bars: DataFrame, longer_than: str) -> DataFrame:
    """(symbol, gap_start, gap_end) of neighbouring bars further apart than an interval."""
    own = Window.partitionBy("symbol").orderBy("ts")
    return bars.select("symbol", F.lag("ts").over(own).alias("gap_start"), F.col("ts").alias("gap_end")).where(F.col("gap_end") > F.col("gap_start") + F.expr(f"interval {longer_than}"))


def coverage(bars: DataFrame, longer_than: str = "3 days") -> DataFrame:
    """Rows, first and last instant and number of gaps of each symbol."""
    return (
        bars.groupBy("symbol")
        .agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .join(gaps(bars, longer_than).groupBy("symbol").agg(F.count("*").alias("gaps")), "symbol", "left")
        .fillna(0, ["gaps"])
    )


def islands(days: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive dates: (key, first_day, last_day, days)."""
    own = Window.partitionBy(key).orderBy(day)
    run = F.date_sub(F.col(day), F.row_number().over(own))
    return days.select(key, day).distinct().withColumn("run_", run).groupBy(key, "run_").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")).drop("run_")


def newest_run(days: DataFrame, key: str, day: str) -> DataFrame:
    """The latest island of each key."""
    return islands(days, key, day).groupBy(key).agg(*(F.max_by(c, "last_day").alias(c) for c in ("first_day", "last_day", "days")))


def stitch(deep: DataFrame, recent: DataFrame, overlap: int = 200, least: int = 5) -> DataFrame:
    """deep, then recent's newer bars moved by the median difference of closes over the last common bars; symbols with
    fewer than `least` of those, or none, keep deep alone."""
    own = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    both = deep.select("symbol", "ts", F.col("c").alias("a")).join(recent.select("symbol", "ts", F.col("c").alias("b")), ["symbol", "ts"])
    level = both.withColumn("n_", F.row_number().over(own)).where(F.col("n_") <= overlap).groupBy("symbol").agg(F.percentile(F.col("b") - F.col("a"), F.lit(0.5)).alias("shift"), F.count("*").alias("n"))
    end = deep.groupBy("symbol").agg(F.max("ts").alias("end"))
    newer = recent.join(level.where(F.col("n") >= least), "symbol").join(end, "symbol").where("ts > end")
    return deep.unionByName(newer.select("symbol", "ts", *((F.col(x) - F.col("shift")).alias(x) for x in "ohlc"), "v"))


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which rows of `first` win over rows of `second` with the same keys."""
    both = first.withColumn("p_", F.lit(0)).unionByName(second.withColumn("p_", F.lit(1)))
    own = Window.partitionBy(*keys).orderBy("p_")
    return both.withColumn("n_", F.row_number().over(own)).where("n_ = 1").drop("p_", "n_")


def cascade(minutes: DataFrame, interval: str) -> DataFrame:
    """Bars of an interval by way of hourly ones, for intervals over an hour."""
    return resample(resample(minutes, "1h"), interval) if INTERVAL_HOURS[interval] > 1 else resample(minutes, interval)


def realign_daily(bars: DataFrame) -> DataFrame:
    """Daily bars of a feed that labels a close with the next day: weekdays only, each takes the next one's close and the
    close before as its open; extremes widen to hold both. The last bar goes."""
    own = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.where(F.weekday("ts") < 5).withColumn("c", F.lead("c").over(own)).where("c is not null")
    rows = rows.withColumn("o", F.coalesce(F.lag("c").over(own), "o"))
    return rows.withColumns({"h": F.greatest("h", "o", "c"), "l": F.least("l", "o", "c")})
