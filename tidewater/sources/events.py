"""Scheduled events: feeds, rules for what no feed holds, and session calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import NEW_YORK

FEED_SCHEMA = "title string, country string, date string, impact string, forecast string, previous string"
#: Sessions by local hours.
SESSIONS = (("tokyo", "Asia/Tokyo", 9, 18), ("london", "Europe/London", 8, 17), ("newyork", "America/New_York", 8, 17))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(ts, currency, title, impact, forecast, previous), one row for each time, currency and title; undated rows go."""
    return parse_feed(spark.read.schema(FEED_SCHEMA).json(path, multiLine=True))


def parse_feed(rows: DataFrame) -> DataFrame:
    """The same of a feed's records."""
    rows = rows.select(F.col("date").try_cast("timestamp").alias("ts"), F.upper("country").alias("currency"), F.trim("title").alias("title"), F.lower("impact").alias("impact"), "forecast", "previous")
    return rows.where("ts is not null").dropDuplicates(["ts", "currency", "title"])


def upcoming(events: DataFrame, now: Column, hours_back: int, hours_ahead: int, currencies: list[str] | None = None, impacts: list[str] | None = None) -> DataFrame:
    """Events around now, with minutes until them and whether they are past."""
    rows = events.where((F.col("ts") >= now - F.expr(f"interval {hours_back} hours")) & (F.col("ts") <= now + F.expr(f"interval {hours_ahead} hours")))
    if currencies:
        rows = rows.where(F.col("currency").isin(currencies))
    if impacts:
        rows = rows.where(F.col("impact").isin(impacts))
    minutes = (F.unix_timestamp("ts") - F.unix_timestamp(now)) / 60
    return rows.withColumns({"minutes_until": minutes, "status": F.when(minutes < 0, "past").otherwise("ahead")})


def span(rows: DataFrame, ts: str = "ts") -> tuple[str, str]:
    """First and last date of rows, for a calendar that covers them; one day where there are no rows."""
    first, last = rows.agg(F.min(F.to_date(ts)).cast("string"), F.max(F.to_date(ts)).cast("string")).first()
    return (first, last) if first else ("1970-01-01", "1970-01-01")


def rule_events(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Events that follow a rule: payrolls on first Fridays and claims on Thursdays, 8:30 in New York; approximate."""
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as day")
    kind = F.when((F.weekday("day") == 4) & (F.day("day") <= 7), "payrolls").when(F.weekday("day") == 3, "claims")
    at = F.to_utc_timestamp(F.col("day").cast("timestamp") + F.expr("interval 510 minutes"), NEW_YORK)
    return days.withColumn("type", kind).where("type is not null").select(at.alias("ts"), F.lit("USD").alias("currency"), "type", F.lit(True).alias("approximate"))


def parse_schedule(pages: DataFrame, pattern: str, date_format: str, minute: int, zone: str) -> DataFrame:
    """(url, name, ts) of release pages (url, html): every match of a pattern with a date and a name, at a minute of the
    day on a zone's clock; what is no date goes."""
    found = F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    rows = pages.select("url", F.explode(found).alias("m")).select("url", F.regexp_extract("m", pattern, 1).alias("day"), F.regexp_extract("m", pattern, 2).alias("name"))
    at = F.to_utc_timestamp(F.try_to_timestamp("day", F.lit(date_format)) + F.expr(f"interval {minute} minutes"), zone)
    return rows.select("url", "name", at.alias("ts")).where("ts is not null")


def with_fallback(official: DataFrame, rules: DataFrame) -> DataFrame:
    """Official events, and ruled ones on days without an official one of their type and currency."""
    days = official.select(F.to_date("ts").alias("day_"), "currency", "type").distinct()
    missing = rules.withColumn("day_", F.to_date("ts")).join(days, ["day_", "currency", "type"], "left_anti").drop("day_")
    return official.withColumn("approximate", F.lit(False)).unionByName(missing, allowMissingColumns=True)


def active_sessions(ts: Column) -> Column:
    """Names of the sessions that are open at an instant, by their own clocks and weekdays."""
    one = []
    for name, zone, start, end in SESSIONS:
        local = F.from_utc_timestamp(ts, zone)
        one.append(F.when((F.weekday(local) < 5) & (F.hour(local) >= start) & (F.hour(local) < end), name))
    return F.array_compact(F.array(*one))


def session_blocks(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(session, start_ts, end_ts) of every session of weekdays from first to last, as instants."""
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as day").where("weekday(day) < 5")
    out = None
    for name, zone, start, end in SESSIONS:
        at = lambda h, zone=zone: F.to_utc_timestamp(F.col("day").cast("timestamp") + F.expr(f"interval {h} hours"), zone)
        part = days.select(F.lit(name).alias("session"), at(start).alias("start_ts"), at(end).alias("end_ts"))
        out = part if out is None else out.unionByName(part)
    return out


def session_stats(bars: DataFrame, blocks: DataFrame) -> DataFrame:
    """Range, net move, direction (flat within a fifth of the range) and hours of the extremes of each symbol's session
    blocks. Bars meet blocks by an equality on dates: a block touches at most two."""
    days = blocks.withColumn("d_", F.explode(F.array_distinct(F.array(F.to_date("start_ts"), F.to_date("end_ts")))))
    rows = bars.withColumn("d_", F.to_date("ts")).join(F.broadcast(days) if blocks.limit(20_001).count() <= 20_000 else days, "d_").where("ts >= start_ts and ts < end_ts")
    out = rows.groupBy("symbol", "session", "start_ts").agg(
        F.max("h").alias("high"), F.min("l").alias("low"), F.min_by("o", "ts").alias("open"), F.max_by("c", "ts").alias("close"), F.max("c").alias("close_high"), F.min("c").alias("close_low"), F.max_by("ts", F.struct("h", -F.unix_timestamp("ts"))).alias("high_at"), F.min_by("ts", F.struct("l", "ts")).alias("low_at")
    )
    net, spread = F.col("close") - F.col("open"), F.col("high") - F.col("low")
    return out.withColumns({"range": spread, "net": net, "direction": F.when(F.abs(net) <= 0.2 * spread, "flat").when(net > 0, "up").otherwise("down")})
