"""Trading time: dates that roll at five in New York, gaps without weekends, next closes, and what a bar's hour says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bars import INTERVAL_HOURS, NEW_YORK, market_open

#: Local session hours, and labels of the hours in which one session hands over to the next.
SESSION_HOURS = (("Sydney", "Australia/Sydney", 7, 16), ("Tokyo", "Asia/Tokyo", 9, 18), ("London", "Europe/London", 8, 17), ("New York", NEW_YORK, 8, 17))
WEEK, WEEKEND = 7 * 86400, 2 * 86400


def bars_for_days(days: float, interval: str) -> int:
    """How many bars of an interval some calendar days hold, with five trading days a week; 50 at least."""
    return max(50, int(days * 24 / INTERVAL_HOURS[interval] * 5 / 7))


def trade_date(ts: Column) -> Column:
    """The trading day of an instant: New York's date, from 17:00 on the next one."""
    return F.to_date(F.from_utc_timestamp(ts, NEW_YORK) + F.expr("interval 7 hours"))


def recent_trading_days(now: Column, n: int) -> Column:
    """The last n weekdays up to the trading day of now, in order."""
    last = trade_date(now)
    days = F.filter(F.sequence(F.date_sub(last, 2 * n + 6), last), lambda d: F.weekday(d) < 5)
    return F.slice(days, -n, n)


def _closed_seconds(local: Column) -> Column:
    """Seconds of weekends, Friday to Sunday 17:00, from a fixed Friday to a local time."""
    since = F.unix_timestamp(local) - F.unix_timestamp(F.lit("1970-01-02 17:00:00").cast("timestamp"))
    return F.floor(since / WEEK) * WEEKEND + F.least(F.pmod(since, F.lit(WEEK)), F.lit(WEEKEND))


def trading_gap(a: Column, b: Column) -> Column:
    """Seconds from a to b without weekends; 0 if b isn't later. On New York's clock, which changes on weekends only."""
    start, end = F.from_utc_timestamp(a, NEW_YORK), F.from_utc_timestamp(b, NEW_YORK)
    open_ = F.unix_timestamp(end) - F.unix_timestamp(start) - (_closed_seconds(end) - _closed_seconds(start))
    return F.when(b > a, open_).otherwise(F.lit(0))


def next_close(last_close: Column, interval: str, now: Column, weekends_closed: bool = True) -> Column:
    """The first close after now on the interval's grid from last_close on, of a bar that ends in open hours."""
    if interval in ("1wk", "1mo"):
        return last_close + F.expr(f"interval {7 if interval == '1wk' else 30} days")
    step = round(INTERVAL_HOURS[interval] * 3600)
    first = F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(last_close)) / step) + 1, F.lit(1))
    ahead = F.transform(F.sequence(first, first + (WEEKEND + 86400) // step + 2), lambda k: F.timestamp_seconds(F.unix_timestamp(last_close) + k * step))
    fits = ahead
    if interval == "1d":
        fits = F.filter(fits, lambda t: F.weekday(F.from_utc_timestamp(t, NEW_YORK)) < 5)
    if weekends_closed:
        fits = F.filter(fits, lambda t: market_open(t - F.expr("interval 1 minute")))
    return F.try_element_at(fits, F.lit(1))


def session_block(ts: Column) -> Column:
    """Asia, London or New York: which part of its trading day an instant lies in; off-session on weekends."""
    day = trade_date(ts)
    before = lambda zone: F.from_utc_timestamp(ts, zone) < day.cast("timestamp") + F.expr("interval 8 hours")
    return F.when(F.weekday(day) >= 5, "off-session").when(before("Europe/London"), "Asia").when(before(NEW_YORK), "London").otherwise("New York")


def session_label(ts: Column) -> Column:
    """The open sessions joined by +, with the handover in brackets that the minute lies in."""
    ts = F.date_trunc("minute", ts)
    local = {zone: F.from_utc_timestamp(ts, zone) for _, zone, _, _ in SESSION_HOURS}
    names = [F.when((F.weekday(local[z]) < 5) & (F.hour(local[z]) >= a) & (F.hour(local[z]) < b), n) for n, z, a, b in SESSION_HOURS]
    active = F.array_compact(F.array(*names))
    london, york = local["Europe/London"], local[NEW_YORK]
    handover = (
        F.when((F.weekday(london) < 5) & (F.hour(london) == 8), "Tokyo→London")
        .when((F.weekday(york) < 5) & ((F.hour(york) == 8) | (F.hour(york) == 9) & (F.minute(york) < 30)), "London→New York")
        .when((F.weekday(york) < 5) & (F.hour(york) == 17), "New York close")
    )
    text = F.when(F.size(active) > 0, F.array_join(active, "+")).otherwise("off-session")
    return F.when(handover.isNotNull(), F.concat(text, F.lit(" ("), handover, F.lit(")"))).otherwise(text)


def time_block(bars: DataFrame, close: Column) -> DataFrame:
    """Adds what the close's time says: hour on a circle, weekday (Monday 0), open sessions a second before it, and the
    minutes since the latest of them opened."""
    just = close - F.expr("interval 1 second")
    hour = F.hour(close) + F.minute(close) / 60
    on, since = {}, []
    for name, zone, start, end in SESSION_HOURS:
        local = F.from_utc_timestamp(just, zone)
        on[name] = (F.weekday(local) < 5) & (F.hour(local) >= start) & (F.hour(local) < end)
        since.append(F.when(on[name], (F.hour(local) - start) * 60 + F.minute(local) + 1))
    turn = F.lit(2) * F.pi() * hour / 24
    return bars.withColumns(
        {
            "hour_sin": F.sin(turn), "hour_cos": F.cos(turn), "dow": F.weekday(close), "asia": on["Sydney"] | on["Tokyo"], "london": on["London"],
            "new_york": on["New York"], "overlap": on["London"] & on["New York"], "since_open": F.least(*since),
        }
    )
