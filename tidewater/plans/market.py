"""Queries over bars: building, joins, indicators, structure, outcomes, cross-series and options."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, bars, cross, indicators, options, ordered, outcomes, structure
from ..session import table
from .common import DAILY, HOURLY, NUMBERED, daily, event_ticks, hourly, r6, shown

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


OHLC = "symbol ts o h l c v".split()
SEL = "symbol, ts, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, round(v, 6) AS v"


# ---- bars ----------------------------------------------------------------------------------------------------------
@query(f"WITH {HOURLY} SELECT {SEL} FROM bars")
def resample_ohlc(spark, d):
    return shown(hourly(spark, d), *OHLC)


@query(f"WITH {HOURLY} SELECT symbol, time_bucket(INTERVAL 4 hours, ts, TIMESTAMP '1970-01-01') AS ts, {r6('arg_min(o, ts) AS o', 'max(h) AS h', 'min(l) AS l', 'arg_max(c, ts) AS c', 'sum(v) AS v')} FROM bars GROUP BY 1, 2")
def resample_4h(spark, d):
    return shown(bars.resample(hourly(spark, d), "4h"), *OHLC)


@query(f"WITH {DAILY} SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS ts, {r6('arg_min(o, ts) AS o', 'max(h) AS h', 'min(l) AS l', 'arg_max(c, ts) AS c', 'sum(v) AS v')} FROM bars GROUP BY 1, 2")
def resample_weekly(spark, d):
    return shown(bars.resample(daily(spark, d), "1wk"), *OHLC)


@query(f"WITH {DAILY} SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS ts, {r6('arg_min(o, ts) AS o', 'max(h) AS h', 'min(l) AS l', 'arg_max(c, ts) AS c', 'sum(v) AS v')} FROM bars GROUP BY 1, 2")
def resample_monthly(spark, d):
    return shown(bars.resample(daily(spark, d), "1mo"), *OHLC)


# January: New York is five hours behind all month, so the local grid is a fixed shift
@query(f"WITH {HOURLY} SELECT symbol, time_bucket(INTERVAL 4 hours, ts - INTERVAL 5 hours, TIMESTAMP '1970-01-01 01:00:00') + INTERVAL 5 hours AS ts, {r6('arg_min(o, ts) AS o', 'max(h) AS h', 'min(l) AS l', 'arg_max(c, ts) AS c', 'sum(v) AS v')} FROM bars GROUP BY 1, 2")
def resample_4h_local(spark, d):
    return shown(bars.resample_local(hourly(spark, d)), *OHLC)


@query(f"WITH {HOURLY} SELECT symbol, date_trunc('day', ts + INTERVAL 2 hours)::TIMESTAMP AS ts, {r6('arg_min(o, ts) AS o', 'max(h) AS h', 'min(l) AS l', 'arg_max(c, ts) AS c', 'sum(v) AS v')} FROM bars WHERE isodow(ts + INTERVAL 2 hours) < 6 GROUP BY 1, 2")
def daily_roll17(spark, d):
    return shown(bars.trade_days(hourly(spark, d)), *OHLC)


@query(
    """WITH r AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS o, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 0.99 END AS h,
      CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 1.01 END AS l, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS c, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 1.0::DOUBLE END AS v, event_id AS seq FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS n FROM r WHERE c IS NOT NULL),
    f AS (SELECT symbol, ts, coalesce(o, c) AS o, coalesce(h, c) AS h, coalesce(l, c) AS l, c, coalesce(v, 0) AS v FROM k WHERE n = 1)
    SELECT symbol, ts, round(o, 6) AS o, round(greatest(h, o, c), 6) AS h, round(least(l, o, c), 6) AS l, round(c, 6) AS c, round(v, 6) AS v FROM f"""
)
def normalize_bars(spark, d):
    e = table(spark, d, "events")
    unless = lambda k, x: F.when(F.col("event_id") % k == 0, None).otherwise(x)
    v = F.col("value")
    rows = e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), unless(7, v).alias("o"), unless(5, v * 0.99).alias("h"), unless(3, v * 1.01).alias("l"), unless(11, v).alias("c"), unless(2, F.lit(1.0)).alias("v"), F.col("event_id").alias("seq"))
    return shown(bars.normalize(rows), *OHLC)


@query(f"WITH {HOURLY}, t AS (SELECT *, ts - INTERVAL 5 hours AS w FROM bars) SELECT {SEL} FROM t WHERE NOT (isodow(w) = 6 OR (isodow(w) = 5 AND hour(w) >= 17) OR (isodow(w) = 7 AND hour(w) < 17))")
def closed_market_filter(spark, d):
    return shown(hourly(spark, d).where(bars.market_open(F.col("ts"))), *OHLC)


@query(f"WITH {DAILY} SELECT {SEL} FROM bars WHERE ts + INTERVAL 1 day <= TIMESTAMP '1999-06-30 12:00:00'")
def closed_filter(spark, d):
    return shown(bars.closed(daily(spark, d), "1d", F.lit("1999-06-30 12:00:00").cast("timestamp")), *OHLC)


@query(f"WITH {DAILY} SELECT symbol, ts, ts::DATE + 1 + INTERVAL 0 hours AS utc_close, date_trunc('month', ts) + INTERVAL 1 month AS month_close FROM bars")
def bar_close_times(spark, d):
    b = daily(spark, d)
    return shown(b.select("symbol", "ts", bars.close_time(F.col("ts"), "1d").alias("utc_close"), bars.close_time(F.col("ts"), "1mo").alias("month_close")))


@query(f"WITH {HOURLY}, g AS (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS gap_start, ts AS gap_end FROM bars) SELECT * FROM g WHERE gap_end > gap_start + INTERVAL 2 hours")
def gaps(spark, d):
    return shown(bars.gaps(hourly(spark, d), "2 hours"))


@query(f"""WITH {HOURLY}, g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars)
SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE ts > p + INTERVAL 3 hours) AS gaps FROM g GROUP BY 1""")
def coverage(spark, d):
    return shown(bars.coverage(hourly(spark, d), "3 hours"))


ISLANDS = "t AS (SELECT DISTINCT o_orderpriority AS symbol, o_orderdate::DATE AS day FROM orders), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY symbol ORDER BY day) AS INTEGER) AS run FROM t), s AS (SELECT symbol, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM g GROUP BY symbol, run)"


def _days(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day"))


@query(f"WITH {ISLANDS} SELECT * FROM s")
def islands(spark, d):
    return bars.islands(_days(spark, d), "symbol", "day")


@query(f"WITH {ISLANDS} SELECT symbol, arg_max(first_day, last_day) AS first_day, max(last_day) AS last_day, arg_max(days, last_day) AS days FROM s GROUP BY symbol")
def newest_run(spark, d):
    return bars.newest_run(_days(spark, d), "symbol", "day")


@query(f"""WITH {DAILY}, deep AS (SELECT * FROM bars WHERE ts < TIMESTAMP '1999-01-01'), recent AS (SELECT symbol, ts, o + 5 AS o, h + 5 AS h, l + 5 AS l, c + 5 + (day(ts) % 3) AS c, v FROM bars WHERE ts >= TIMESTAMP '1998-06-01'),
j AS (SELECT symbol, r.c - d.c AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM deep d JOIN recent r USING (symbol, ts)), s AS (SELECT symbol, quantile_cont(x, 0.5) AS shift FROM j WHERE n <= 200 GROUP BY 1 HAVING count(*) >= 5)
SELECT {SEL} FROM deep UNION ALL SELECT symbol, ts, {r6('o - shift AS o', 'h - shift AS h', 'l - shift AS l', 'c - shift AS c', 'v AS v')} FROM recent JOIN s USING (symbol) WHERE ts > (SELECT max(ts) FROM deep d2 WHERE d2.symbol = recent.symbol)""")
def stitch(spark, d):
    b = daily(spark, d)
    recent = b.where("ts >= '1998-06-01'").select("symbol", "ts", *((F.col(x) + 5).alias(x) for x in "ohl"), (F.col("c") + 5 + F.day("ts") % 3).alias("c"), "v")
    return shown(bars.stitch(b.where("ts < '1999-01-01'"), recent), *OHLC)


@query(f"WITH {DAILY} SELECT {SEL} FROM (SELECT * FROM bars WHERE c >= o UNION ALL SELECT symbol, ts, o + 1, h + 1, l + 1, c + 1, v FROM bars WHERE c < o)")
def union_priority(spark, d):
    b = daily(spark, d)
    return shown(bars.prefer(b.where("c >= o"), b.select("symbol", "ts", *((F.col(x) + 1).alias(x) for x in "ohlc"), "v"), ["symbol", "ts"]), *OHLC)


# ---- ordered joins -------------------------------------------------------------------------------------------------
@query(f"""WITH {HOURLY}, coarse AS (SELECT symbol, time_bucket(INTERVAL 4 hours, ts, TIMESTAMP '1970-01-01') + INTERVAL 4 hours AS closes, arg_max(c, ts) AS hc FROM bars GROUP BY 1, 2)
SELECT b.symbol, b.ts, round(b.c, 6) AS c, round(k.hc, 6) AS hc FROM bars b ASOF LEFT JOIN coarse k ON b.symbol = k.symbol AND b.ts >= k.closes""")
def asof_trend(spark, d):
    b = hourly(spark, d)
    coarse = bars.resample(b, "4h").select("symbol", (F.col("ts") + F.expr("interval 4 hours")).alias("closes"), F.col("c").alias("hc"))
    return shown(asof.asof_join(b.select("symbol", "ts", "c"), coarse, ["symbol"], "ts", "closes", ["hc"]))


@query(f"""WITH {HOURLY}, news AS (SELECT event_type AS symbol, ts AS at, event_id FROM events),
p AS (SELECT b.symbol, b.ts, k.at AS last_at FROM bars b ASOF LEFT JOIN news k ON b.symbol = k.symbol AND b.ts >= k.at), q AS (SELECT b.symbol, b.ts, k.at AS next_at FROM bars b ASOF LEFT JOIN news k ON b.symbol = k.symbol AND b.ts <= k.at)
SELECT symbol, ts, round(CASE WHEN last_at IS NOT NULL THEN least(epoch(ts - last_at) / 60, 1440) END, 3) AS since, round(CASE WHEN next_at IS NOT NULL THEN least(epoch(next_at - ts) / 60, 1440) END, 3) AS until FROM p JOIN q USING (symbol, ts)""")
def news_next_last(spark, d):
    b = hourly(spark, d).select("symbol", "ts")
    news = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"))
    rows = asof.asof_join(b, news, ["symbol"], "ts", "at", ["at"]).withColumnRenamed("at", "last_at")
    rows = asof.asof_join(rows, news, ["symbol"], "ts", "at", ["at"], direction="forward").withColumnRenamed("at", "next_at")
    minutes = lambda a, b: F.least((F.unix_micros(a) - F.unix_micros(b)) / 60e6, F.lit(1440.0))
    since = F.when(F.col("last_at").isNotNull(), F.round(minutes(F.col("ts"), F.col("last_at")), 3))
    until = F.when(F.col("next_at").isNotNull(), F.round(minutes(F.col("next_at"), F.col("ts")), 3))
    return shown(rows.select("symbol", "ts", since.alias("since"), until.alias("until")))


@query(f"""WITH {HOURLY}, grid AS (SELECT t.ts, s.symbol FROM (SELECT DISTINCT ts FROM bars) t, (SELECT DISTINCT symbol FROM bars) s), g AS (SELECT grid.symbol, grid.ts, b.c FROM grid LEFT JOIN bars b ON b.symbol = grid.symbol AND b.ts = grid.ts)
SELECT symbol, ts, round(last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS c FROM g""")
def ffill_limit(spark, d):
    b = hourly(spark, d)
    rows = asof.grid(b).join(b.select("symbol", "ts", "c"), ["symbol", "ts"], "left")
    return shown(asof.fill_forward(rows, ["symbol"], "ts", "c", 3), "symbol", "ts", "c")


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS k, abs(s_acctbal) AS a, abs(s_acctbal) + 400 AS b FROM supplier)
SELECT c.c_custkey, s.id FROM customer c JOIN s ON c.c_nationkey = s.k AND c.c_acctbal >= s.a AND c.c_acctbal < s.b""")
def interval_overlap(spark, d):
    spans = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k"), F.abs("s_acctbal").alias("a"), (F.abs("s_acctbal") + 400).alias("b"))
    return asof.range_join(table(spark, d, "customer").withColumnRenamed("c_nationkey", "k"), spans, ["k"], "c_acctbal", "a", "b", 400.0).select("c_custkey", "id")


# ---- indicators ----------------------------------------------------------------------------------------------------
def _over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(f"WITH {DAILY} SELECT symbol, ts, round(CASE WHEN count(*) {_over(20)} = 20 THEN avg(c) {_over(20)} END, 6) AS sma FROM bars")
def sma(spark, d):
    return shown(daily(spark, d).withColumn("sma", indicators.sma("c", 20)), "symbol", "ts", "sma")


@query(f"""WITH {DAILY}, b AS (SELECT symbol, ts, c, CASE WHEN count(*) {_over(20)} = 20 THEN avg(c) {_over(20)} END AS mid, stddev_pop(c) {_over(20)} AS s FROM bars)
SELECT symbol, ts, {r6('mid AS mid', 'mid + 2 * s AS upper', 'mid - 2 * s AS lower', '(c - (mid - 2 * s)) / (4 * s) AS pct_b', '4 * s / mid AS bandwidth')} FROM b""")
def bollinger(spark, d):
    return shown(indicators.bollinger(daily(spark, d)), "symbol", "ts", "mid", "upper", "lower", "pct_b", "bandwidth")


@query(f"""WITH {DAILY}, r AS (SELECT symbol, ts, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY ts)) AS r, count(*) OVER (PARTITION BY symbol) AS n, (epoch(max(ts) OVER (PARTITION BY symbol)) - epoch(min(ts) OVER (PARTITION BY symbol))) / 86400.0 / 365.25 AS y FROM bars)
SELECT symbol, ts, round(CASE WHEN count(r) {_over(20)} = 20 THEN stddev_samp(r) {_over(20)} * sqrt((n - 1) / y) END, 6) AS rv FROM r""")
def realized_vol(spark, d):
    return shown(indicators.realized_vol(daily(spark, d)), "symbol", "ts", "rv")


def _smooth(source: str, alpha: str, least: int, name: str) -> str:
    return f"""{name}(symbol, i, y) AS (SELECT symbol, i, {source} FROM x WHERE i = 1 UNION ALL SELECT x.symbol, x.i, {name}.y + (x.{source} - {name}.y) * {alpha} FROM {name} JOIN x ON x.symbol = {name}.symbol AND x.i = {name}.i + 1)"""


@query(f"WITH RECURSIVE {HOURLY}, x AS (SELECT symbol, ts, c, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars), {_smooth('c', '(2.0::DOUBLE / 21)', 20, 'e')} SELECT x.symbol, x.ts, round(CASE WHEN x.i >= 20 THEN y END, 6) AS ema FROM x JOIN e ON x.symbol = e.symbol AND x.i = e.i")
def ema(spark, d):
    return shown(indicators.ema(hourly(spark, d), 20), "symbol", "ts", "ema")


TR = "x AS (SELECT symbol, ts, h, l, c, o, greatest(h - l, coalesce(abs(h - lag(c) OVER w), 0), coalesce(abs(l - lag(c) OVER w), 0)) AS tr, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"


@query(f"WITH RECURSIVE {HOURLY}, {TR}, {_smooth('tr', '(1.0::DOUBLE / 14)', 14, 'e')} SELECT x.symbol, x.ts, round(tr, 6) AS tr, round(CASE WHEN x.i >= 14 THEN y END, 6) AS atr FROM x JOIN e ON x.symbol = e.symbol AND x.i = e.i")
def atr(spark, d):
    return shown(indicators.atr(hourly(spark, d)), "symbol", "ts", "tr", "atr")


@query(
    f"""WITH RECURSIVE {HOURLY}, m AS (SELECT symbol, ts, c - lag(c) OVER (PARTITION BY symbol ORDER BY ts) AS d, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM bars),
    x AS (SELECT symbol, ts, i, greatest(d, 0) AS g, greatest(-d, 0) AS q FROM m),
    {_smooth('g', '(1.0::DOUBLE / 14)', 14, 'e')}, {_smooth('q', '(1.0::DOUBLE / 14)', 14, 'f')}
    SELECT x.symbol, x.ts, round(CASE WHEN x.i >= 14 THEN CASE WHEN f.y = 0 AND e.y = 0 THEN 50 WHEN f.y = 0 THEN 100 ELSE 100 - 100 / (1 + e.y / f.y) END END, 6) AS rsi
    FROM x LEFT JOIN e ON x.symbol = e.symbol AND x.i = e.i LEFT JOIN f ON x.symbol = f.symbol AND x.i = f.i"""
)
def rsi(spark, d):
    return shown(indicators.rsi(hourly(spark, d)), "symbol", "ts", "rsi")


@query(
    f"""WITH RECURSIVE {HOURLY}, x AS (SELECT symbol, ts, c, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars), {_smooth('c', '(2.0::DOUBLE / 13)', 12, 'a')}, {_smooth('c', '(2.0::DOUBLE / 27)', 26, 'b')},
    z AS (SELECT a.symbol, a.i, a.y - b.y AS m FROM a JOIN b ON a.symbol = b.symbol AND a.i = b.i WHERE a.i >= 26),
    s(symbol, i, y) AS (SELECT symbol, i, m FROM z WHERE i = 26 UNION ALL SELECT z.symbol, z.i, s.y + (z.m - s.y) * 0.2::DOUBLE FROM s JOIN z ON z.symbol = s.symbol AND z.i = s.i + 1)
    SELECT x.symbol, x.ts, {r6('m AS macd', 'CASE WHEN x.i >= 34 THEN s.y END AS signal', 'CASE WHEN x.i >= 34 THEN m - s.y END AS histogram')} FROM x LEFT JOIN z ON x.symbol = z.symbol AND x.i = z.i LEFT JOIN s ON x.symbol = s.symbol AND x.i = s.i"""
)
def macd(spark, d):
    return shown(indicators.macd(hourly(spark, d)), "symbol", "ts", "macd", "signal", "histogram")


@query(
    f"""WITH {DAILY}, b AS (SELECT symbol, ts, c, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, avg(c) {_over(50)} AS f, avg(c) {_over(200)} AS s FROM bars),
    k AS (SELECT *, f - lag(f, 10) OVER (PARTITION BY symbol ORDER BY ts) AS slope FROM b)
    SELECT symbol, ts, CASE WHEN i < 211 THEN 'unknown' WHEN c > f AND f > s AND slope > 0 THEN 'up' WHEN c < f AND f < s AND slope < 0 THEN 'down' ELSE 'range' END AS regime FROM k"""
)
def trend_regime(spark, d):
    return shown(indicators.trend_regime(daily(spark, d)), "symbol", "ts", "regime")


@query(f"""WITH {HOURLY} SELECT symbol, ts, count(*) OVER w = 7 AND h = max(h) OVER w AS swing_high, count(*) OVER w = 7 AND l = min(l) OVER w AS swing_low FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def swings(spark, d):
    return shown(indicators.swing_points(hourly(spark, d)), "symbol", "ts", "swing_high", "swing_low")


@query(
    f"""WITH {HOURLY}, b AS (SELECT symbol, ts, greatest(o, c) AS t, least(o, c) AS m, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM bars),
    k AS (SELECT symbol, ts, i, t > max(t) OVER p AND t >= max(t) OVER f AND count(*) OVER p = 2 AND count(*) OVER f = 2 AS hi, m < min(m) OVER p AND m <= min(m) OVER f AND count(*) OVER p = 2 AND count(*) OVER f = 2 AS lo FROM b
    WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
    SELECT symbol, ts, coalesce(hi, false) AS body_high, coalesce(lo, false) AS body_low, CASE WHEN hi OR lo THEN i + 2 END AS confirmed FROM k"""
)
def raw_swings(spark, d):
    rows = indicators.body_swings(hourly(spark, d))
    return shown(rows.select("symbol", "ts", F.coalesce("body_high", F.lit(False)).alias("body_high"), F.coalesce("body_low", F.lit(False)).alias("body_low"), F.col("confirmed").cast("long").alias("confirmed")))


ATR = f"{TR}, {_smooth('tr', '(1.0::DOUBLE / 14)', 14, 'e')}, a AS (SELECT x.*, CASE WHEN x.i >= 14 THEN y END AS atr FROM x JOIN e ON x.symbol = e.symbol AND x.i = e.i)"


@query(
    f"""WITH RECURSIVE {HOURLY}, {ATR}, p AS (SELECT *, lag(atr) OVER (PARTITION BY symbol ORDER BY ts) AS pa FROM a)
    SELECT symbol, ts, coalesce(abs(c - o) >= 1.5 * pa AND c > o AND c >= h - 0.25 * (h - l), false) AS impulse_up, coalesce(abs(c - o) >= 1.5 * pa AND c < o AND c <= l + 0.25 * (h - l), false) AS impulse_down FROM p"""
)
def impulse(spark, d):
    return shown(indicators.impulses(indicators.atr(hourly(spark, d))), "symbol", "ts", "impulse_up", "impulse_down")


@query(
    f"""WITH RECURSIVE {HOURLY}, {ATR}, s AS (SELECT *, CASE WHEN h > l THEN h - l END AS g FROM a)
    SELECT symbol, ts, {r6('(c - o) / g AS body', '(h - greatest(o, c)) / g AS upper_wick', '(least(o, c) - l) / g AS lower_wick', '(c - l) / g AS close_pos', '(h - l) / nullif(atr, 0) AS range_atr', *[f'(c - lag(c, {n}) OVER (PARTITION BY symbol ORDER BY ts)) / nullif(atr, 0) AS move_{n}' for n in (4, 16, 96)])} FROM s"""
)
def candle_shape(spark, d):
    return shown(indicators.candle_shape(indicators.atr(hourly(spark, d))), "symbol", "ts", "body", "upper_wick", "lower_wick", "close_pos", "range_atr", "move_4", "move_16", "move_96")


_RATIO = f"CASE WHEN count(ret_1) {_over(5)} = 5 THEN stddev_samp(ret_1) {_over(5)} END / nullif(CASE WHEN count(ret_1) {_over(20)} = 20 THEN stddev_samp(ret_1) {_over(20)} END, 0) AS rv_ratio"


@query(
    f"""WITH {DAILY}, r AS (SELECT *, {', '.join(f'ln(c / lag(c, {n}) OVER w) AS ret_{n}' for n in (1, 2, 3, 5, 10, 20))}, ln(lead(c, 5) OVER w / c) AS target FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, ts, {r6(*[f'ret_{n} AS ret_{n}' for n in (1, 2, 3, 5, 10, 20)], f'CASE WHEN count(ret_1) {_over(20)} = 20 THEN stddev_samp(ret_1) {_over(20)} END AS rv_20', _RATIO, f'CASE WHEN count(*) {_over(20)} = 20 THEN (c - min(l) {_over(20)}) / nullif(max(h) {_over(20)} - min(l) {_over(20)}, 0) END AS range_pos_20', 'target AS target')}, (isodow(ts) - 1)::INTEGER AS dow, hour(ts)::INTEGER AS hour FROM r"""
)
def features(spark, d):
    return shown(indicators.returns(daily(spark, d)), "symbol", "ts", *(f"ret_{n}" for n in (1, 2, 3, 5, 10, 20)), "rv_20", "rv_ratio", "range_pos_20", "target", "dow", "hour")


@query(
    f"""WITH {HOURLY}, f AS (SELECT *, time_bucket(INTERVAL 4 hours, ts, TIMESTAMP '1970-01-01') AS bin FROM bars)
    SELECT symbol, ts, {r6('first_value(o) OVER w AS fo', 'max(h) OVER w AS fh', 'min(l) OVER w AS fl', '(c - min(l) OVER w) / nullif(max(h) OVER w - min(l) OVER w, 0) AS fpos')} FROM f WINDOW w AS (PARTITION BY symbol, bin ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def forming_candle(spark, d):
    return shown(indicators.forming(hourly(spark, d), bars.bin_start(F.col("ts"), "4h")), "symbol", "ts", "fo", "fh", "fl", "fpos")


@query(f"""WITH {HOURLY} SELECT symbol, ts, {r6("median(v) OVER w AS median", "v / median(v) OVER w AS ratio")} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 1728000 PRECEDING AND 1 PRECEDING)""")
def trailing_median(spark, d):
    return shown(indicators.trailing_median_ratio(hourly(spark, d), "v"), "symbol", "ts", "median", "ratio")


@query(f"WITH {DAILY}, p AS (SELECT *, (h + l + c) / 3 AS p FROM bars) SELECT symbol, ts, {r6('p AS p', '2 * p - l AS r1', '2 * p - h AS s1', 'p + (h - l) AS r2', 'p - (h - l) AS s2', 'h + 2 * (p - l) AS r3', 'l - 2 * (h - p) AS s3')} FROM p")
def pivots(spark, d):
    return shown(indicators.pivots(daily(spark, d)), "symbol", "ts", "p", "r1", "s1", "r2", "s2", "r3", "s3")


@query(f"WITH {DAILY}, w AS (SELECT * FROM bars WHERE ts <= TIMESTAMP '2000-06-30' AND ts > TIMESTAMP '2000-06-30' - INTERVAL 365 days) SELECT symbol, {r6('max(h) AS high', 'min(l) AS low', 'arg_max(c, ts) AS close', '(arg_max(c, ts) - min(l)) / nullif(max(h) - min(l), 0) AS position')} FROM w GROUP BY 1")
def range_52w(spark, d):
    return shown(indicators.range_52w(daily(spark, d), F.lit("2000-06-30").cast("timestamp")), "symbol", "high", "low", "close", "position")


# ---- structure -----------------------------------------------------------------------------------------------------
@query(
    f"""WITH {HOURLY}, {NUMBERED}, p AS (SELECT a.symbol, a.i, b.i AS m, least(b.o, b.c) AS lo, greatest(b.o, b.c) AS hi FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 30 AND a.i - 2),
    k AS (SELECT p.symbol, p.i, p.m, p.lo, p.hi FROM p JOIN n x ON x.symbol = p.symbol AND x.i > p.m AND x.i <= p.i GROUP BY ALL HAVING min(x.c) >= p.lo AND max(x.c) <= p.hi),
    f AS (SELECT symbol, i, min(m) AS m, arg_min(lo, m) AS lo, arg_min(hi, m) AS hi FROM k GROUP BY 1, 2)
    SELECT n.symbol, n.ts, (f.m - 1)::BIGINT AS mother, {r6('f.lo AS box_low', 'f.hi AS box_high')}, (n.i - f.m)::BIGINT AS inside FROM n LEFT JOIN f ON n.symbol = f.symbol AND n.i = f.i"""
)
def box_at(spark, d):
    rows = structure.boxes(hourly(spark, d))
    return shown(rows.select("symbol", "ts", F.col("mother").cast("long").alias("mother"), "box_low", "box_high", F.col("inside").cast("long").alias("inside")))


@query(
    f"""WITH RECURSIVE {HOURLY}, {ATR}, p AS (SELECT symbol, ts, i, o, h, l, c, CASE WHEN lag(atr) OVER w > 0 THEN lag(atr) OVER w END AS a, c - o AS b, lag(c - o) OVER w AS b1, lag(o) OVER w AS o1, lag(c) OVER w AS c1, lag(h) OVER w AS h1, lag(l) OVER w AS l1,
      lag(c - o, 2) OVER w AS b2, lag(o, 2) OVER w AS o2, lag(c, 2) OVER w AS c2, lag(h, 2) OVER w AS h2, lag(l, 2) OVER w AS l2, lag(o, 1) OVER w AS po, min(l) OVER t AS l10, max(h) OVER t AS h10 FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts), t AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    , p1 AS (SELECT *, CASE WHEN abs(b) >= 0.3 * a THEN sign(b) ELSE 0 END AS f FROM p), p2 AS (SELECT *, lag(f) OVER v AS f1, lag(f, 2) OVER v AS f2 FROM p1 WINDOW v AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, ts,
      CASE WHEN b > 0 AND b1 < 0 AND o <= c1 AND c >= o1 AND abs(b) >= 0.3 * a AND abs(b) > abs(b1) THEN 1 WHEN b < 0 AND b1 > 0 AND o >= c1 AND c <= o1 AND abs(b) >= 0.3 * a AND abs(b) > abs(b1) THEN -1 ELSE 0 END AS engulfing,
      CASE WHEN h - l >= 0.75 * a AND least(o, c) - l >= (h - l) * 2 / 3 THEN 1 WHEN h - l >= 0.75 * a AND h - greatest(o, c) >= (h - l) * 2 / 3 THEN -1 ELSE 0 END AS pin,
      coalesce(h <= h1 AND l >= l1 AND h > l, false)::INTEGER AS inside_bar, CASE WHEN h1 <= h2 AND l1 >= l2 AND h1 > l1 AND c > h2 THEN 1 WHEN h1 <= h2 AND l1 >= l2 AND h1 > l1 AND c < l2 THEN -1 ELSE 0 END AS inside_break,
      CASE WHEN f = 1 AND f1 = 1 AND f2 = 1 AND c > c1 AND c1 > c2 AND o >= o1 AND o <= c1 AND o1 >= o2 AND o1 <= c2 THEN 1 WHEN f = -1 AND f1 = -1 AND f2 = -1 AND c < c1 AND c1 < c2 AND o <= o1 AND o >= c1 AND o1 <= o2 AND o1 >= c2 THEN -1 ELSE 0 END AS three,
      CASE WHEN h > h1 AND l < l1 AND b > 0 THEN 1 WHEN h > h1 AND l < l1 AND b < 0 THEN -1 ELSE 0 END AS outside_bar,
      CASE WHEN b2 < 0 AND abs(b2) >= 0.5 * a AND abs(b1) <= 0.25 * a AND b > 0 AND c > (o2 + c2) / 2 THEN 1 WHEN b2 > 0 AND abs(b2) >= 0.5 * a AND abs(b1) <= 0.25 * a AND b < 0 AND c < (o2 + c2) / 2 THEN -1 ELSE 0 END AS star,
      CASE WHEN abs(l - l1) <= 0.1 * a AND b1 < 0 AND b > 0 AND i >= 10 AND least(l, l1) <= l10 THEN 1 WHEN abs(h - h1) <= 0.1 * a AND b1 > 0 AND b < 0 AND i >= 10 AND greatest(h, h1) >= h10 THEN -1 ELSE 0 END AS tweezer
    FROM p2"""
)
def candlesticks(spark, d):
    return shown(structure.candlesticks(indicators.atr(hourly(spark, d))), "symbol", "ts", "engulfing", "pin", "inside_bar", "inside_break", "outside_bar", "star", "three", "tweezer")


#: Confirmed body swings as levels.
LEVELS = """w AS (SELECT symbol, i, greatest(o, c) AS t, least(o, c) AS m FROM z), s AS (SELECT *, count(*) OVER p = 2 AND count(*) OVER f = 2 AS whole, t > max(t) OVER p AND t >= max(t) OVER f AS hi, m < min(m) OVER p AND m <= min(m) OVER f AS lo FROM w
  WINDOW p AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
lv AS (SELECT symbol, i * 2 AS level_id, t AS price, 'H' AS kind, i + 2 AS known_i FROM s WHERE whole AND hi UNION ALL SELECT symbol, i * 2 + 1, m, 'L', i + 2 FROM s WHERE whole AND lo)"""


def _levels(b):
    rows = indicators.body_swings(b)
    part = lambda flag, price, kind, k: rows.where(flag).select("symbol", (F.col("i") * 2 + k).alias("level_id"), F.col(price).alias("price"), F.lit(kind).alias("kind"), F.col("confirmed").alias("known_i"))
    return part("body_high", "top", "H", 0).unionByName(part("body_low", "bottom", "L", 1))


@query(
    f"""WITH {HOURLY}, z AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, lag(c) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars), {LEVELS},
    b AS (SELECT lv.symbol, level_id, price, kind, min(z.i) AS break_i FROM lv JOIN z ON z.symbol = lv.symbol AND z.i > known_i AND CASE WHEN kind = 'H' THEN z.c > price AND z.pc <= price ELSE z.c < price AND z.pc >= price END GROUP BY ALL),
    t AS (SELECT b.symbol, level_id, z.i, CASE WHEN kind = 'H' THEN l - price ELSE price - h END AS near, CASE WHEN kind = 'H' THEN c > price ELSE c < price END AS good FROM b JOIN z ON z.symbol = b.symbol AND z.i > break_i AND z.i <= break_i + 48),
    g AS (SELECT symbol, level_id, min(i) AS touch_i, min(i) FILTER (WHERE near <= 0) AS fill_i, arg_min(good, i) AS rejected FROM t WHERE near <= 5 GROUP BY 1, 2)
    SELECT b.symbol, b.level_id, round(price, 6) AS price, break_i, touch_i, fill_i, coalesce(rejected, false) AS rejected FROM b LEFT JOIN g ON b.symbol = g.symbol AND b.level_id = g.level_id"""
)
def retests(spark, d):
    b = hourly(spark, d)
    out = structure.retests(b, _levels(b), 5.0, 48)
    return shown(out.select("symbol", *(F.col(k).cast("long").alias(k) for k in ("level_id", "break_i", "touch_i", "fill_i")), "price", "rejected"))


@query(
    f"""WITH RECURSIVE {HOURLY}, p AS (SELECT symbol, h AS x, row_number() OVER (PARTITION BY symbol ORDER BY h) AS k FROM bars),
    w(symbol, k, x, first, c) AS (SELECT symbol, k, x, x, 1 FROM p WHERE k = 1 UNION ALL SELECT p.symbol, p.k, p.x, CASE WHEN p.x - w.first <= 6 THEN w.first ELSE p.x END, CASE WHEN p.x - w.first <= 6 THEN w.c ELSE w.c + 1 END FROM w JOIN p ON p.symbol = w.symbol AND p.k = w.k + 1)
    SELECT symbol, {r6('min(x) AS low', 'max(x) AS high', 'avg(x) AS mean')}, count(*)::INTEGER AS n FROM w GROUP BY symbol, c"""
)
def cluster_levels(spark, d):
    return shown(structure.cluster_levels(hourly(spark, d), "symbol", "h", F.lit(6.0)))


# ---- outcomes ------------------------------------------------------------------------------------------------------
_LABEL = f"""WITH {HOURLY}, a AS (SELECT symbol, ts, c, list(h) OVER w AS hs, list(l) OVER w AS ls, list(c) OVER w AS cs FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)),
b AS (SELECT *, coalesce(len(cs), 0) AS n, list_position(list_transform(ls, lambda x: x <= c - 60), true) AS bs, list_position(list_transform(hs, lambda x: x >= c + 120), true) AS bt, list_position(list_transform(hs, lambda x: x >= c + 60), true) AS ss, list_position(list_transform(ls, lambda x: x <= c - 120), true) AS st FROM a)"""


@query(
    _LABEL
    + """, k AS (SELECT *, CASE WHEN n = 12 THEN CASE WHEN bt > 0 AND (coalesce(bs, 0) = 0 OR bt < bs) THEN 1 ELSE 0 END END AS buy, CASE WHEN n = 12 THEN CASE WHEN st > 0 AND (coalesce(ss, 0) = 0 OR st < ss) THEN 1 ELSE 0 END END AS sell FROM b),
    r AS (SELECT *, CASE WHEN n = 12 THEN (CASE WHEN buy = 1 THEN 120 WHEN bs > 0 THEN -60 ELSE cs[-1] - c END - 2) / 60 END AS r_buy, CASE WHEN n = 12 THEN (CASE WHEN sell = 1 THEN 120 WHEN ss > 0 THEN -60 ELSE c - cs[-1] END - 2) / 60 END AS r_sell FROM k)
    SELECT symbol, ts, buy, sell, round(r_buy, 6) AS r_buy, round(r_sell, 6) AS r_sell, CASE WHEN n = 12 THEN CASE WHEN buy = 1 AND (sell = 0 OR r_buy >= r_sell) THEN 'buy' WHEN sell = 1 THEN 'sell' ELSE 'hold' END END AS best FROM r"""
)
def labels_tp(spark, d):
    return shown(outcomes.trade_labels(hourly(spark, d), F.lit(60.0), F.lit(120.0), F.lit(2.0), 12), "symbol", "ts", "buy", "sell", "r_buy", "r_sell", "best")


@query(
    _LABEL
    + """ SELECT symbol, ts, CASE WHEN bs > 0 AND (coalesce(bt, 0) = 0 OR bs <= bt) THEN 'loss' WHEN bt > 0 THEN 'win' WHEN n = 12 THEN 'timeout' END AS outcome,
    round(CASE WHEN bs > 0 AND (coalesce(bt, 0) = 0 OR bs <= bt) THEN -60 WHEN bt > 0 THEN 120 WHEN n = 12 THEN cs[-1] - c END, 6) AS move, CASE WHEN bs > 0 AND (coalesce(bt, 0) = 0 OR bs <= bt) THEN bs WHEN bt > 0 THEN bt WHEN n = 12 THEN 12 END::BIGINT AS held FROM b"""
)
def trade_exits(spark, d):
    return shown(outcomes.exits(hourly(spark, d), F.lit(60.0), F.lit(120.0), 12), "symbol", "ts", "outcome", "move", "held")


@query(f"WITH {HOURLY} SELECT symbol, ts, round(greatest(c - min(l) OVER w, 0), 6) AS mae, round(greatest(max(h) OVER w - c, 0), 6) AS mfe FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)")
def excursions(spark, d):
    rows = outcomes.excursions(hourly(spark, d), 24)
    return shown(rows, "symbol", "ts", "mae", "mfe")


@query(
    f"""WITH {HOURLY}, a AS (SELECT symbol, ts, c, list(c) OVER w AS cs FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)),
    b AS (SELECT *, coalesce(list_position(list_transform(cs, lambda x: x > c + 100), true), 0) AS u, coalesce(list_position(list_transform(cs, lambda x: x < c - 100), true), 0) AS q FROM a)
    SELECT symbol, ts, CASE WHEN u > 0 AND (q = 0 OR u < q) THEN 1 WHEN q > 0 THEN 0 END AS continues FROM b"""
)
def continuation(spark, d):
    return shown(outcomes.continuation(hourly(spark, d), F.col("c") + 100, F.col("c") - 100, 24), "symbol", "ts", "continues")


def _trades(spark, d):
    """Line items as trades: result in units of risk, by return flag, in order of ship date and key."""
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ((F.col("l_discount") - 0.05) * 20 + F.col("l_tax")).alias("r"))


T = "t AS (SELECT l_returnflag AS kind, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_discount - 0.05) * 20 + l_tax AS r FROM lineitem)"
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r"]


@query(
    f"""WITH {T}, c AS (SELECT *, row_number() OVER w AS n, sum(r) OVER (PARTITION BY kind ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, r ROWS UNBOUNDED PRECEDING) AS cum FROM t WINDOW w AS (PARTITION BY kind ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, r)),
    p AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY kind ORDER BY n ROWS UNBOUNDED PRECEDING)) AS peak, n - row_number() OVER (PARTITION BY kind, r <= 0 ORDER BY n) AS run FROM c),
    s AS (SELECT kind, max(k) AS longest FROM (SELECT kind, run, count(*) AS k FROM p WHERE r <= 0 GROUP BY 1, 2) GROUP BY 1),
    g AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE r > 0) AS wins, avg(r) AS expectancy, sum(r) AS total, sum(r) FILTER (WHERE r > 0) / sum(-r) FILTER (WHERE r < 0) AS pf, max(peak - cum) AS dd FROM p GROUP BY 1),
    w AS (SELECT *, wins / n AS p, 1.959964 AS z FROM g)
    SELECT w.kind, n, wins, {r6('p AS win_rate', '(p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS ci_low', '(p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS ci_high', 'expectancy AS expectancy', 'pf AS profit_factor')}, round(total, 3) AS total, round(dd, 3) AS max_drawdown, longest AS longest_losing FROM w JOIN s USING (kind)"""
)
def backtest_summary(spark, d):
    out = outcomes.summarize(_trades(spark, d), ["kind"], order=ORDER)
    return shown(out, "kind", "n", "wins", "win_rate", "ci_low", "ci_high", "expectancy", "profit_factor", "total", "max_drawdown", "longest_losing").withColumns({"total": F.round("total", 3), "max_drawdown": F.round("max_drawdown", 3)})


@query(
    f"""WITH {T}, c AS (SELECT kind, row_number() OVER w AS n, sum(r) OVER (PARTITION BY kind ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, r ROWS UNBOUNDED PRECEDING) AS equity, count(*) OVER (PARTITION BY kind) AS k FROM t WINDOW w AS (PARTITION BY kind ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, r))
    SELECT kind, n, round(equity, 3) AS equity FROM c WHERE (n - 1) % ceil(k / 200)::BIGINT = 0 OR n = k"""
)
def equity_curve(spark, d):
    return outcomes.equity_curve(_trades(spark, d), ["kind"], order=ORDER).select("kind", "n", F.round("equity", 3).alias("equity"))


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::TINYINT AS g1, grouping(l_linestatus)::TINYINT AS g2, count(*) AS n, round(avg(l_discount), 4) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, d):
    t = table(spark, d, "lineitem")
    rows = t.groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []], F.col("l_returnflag"), F.col("l_linestatus"))
    return rows.agg(F.grouping("l_returnflag").alias("g1"), F.grouping("l_linestatus").alias("g2"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 4).alias("mean"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT year(l_shipdate)::INTEGER AS y, l_returnflag, count(*) AS n FROM lineitem GROUP BY ROLLUP (y, l_returnflag)")
def rollup(spark, d):
    return table(spark, d, "lineitem").rollup(F.year("l_shipdate").alias("y"), "l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).fillna(0)


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.75, 0.9, 0.95)) + " FROM lineitem GROUP BY 1")
def percentiles(spark, d):
    return shown(ordered.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {f"p{int(q * 100)}": q for q in (0.5, 0.75, 0.9, 0.95)}))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS n FROM lineitem) WHERE n % 7 = 0")
def stride_thin(spark, d):
    return outcomes.thin(table(spark, d, "lineitem"), ["l_returnflag"], ORDER[:3], 7).select("l_orderkey", "l_linenumber")


@query(
    """WITH t AS (SELECT event_id, epoch(ts) AS a, epoch(ts) + value * 100 AS b FROM events), k AS (SELECT min(a) + (max(a) - min(a)) * 0.8 AS cut FROM t)
    SELECT event_id, CASE WHEN a > cut THEN 'test' WHEN b <= cut THEN 'train' ELSE 'purged' END AS part FROM t, k"""
)
def purge_split(spark, d):
    e = table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("a"), "value").withColumn("b", F.col("a") + F.col("value") * 100)
    return outcomes.purged_split(e, "a", "b", 0.2).select("event_id", "part")


@query(
    f"""WITH {DAILY}, z AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), f AS (SELECT *, unnest(range(4)) AS fold FROM z),
    e AS (SELECT *, floor(n * 0.5) AS s FROM f), k AS (SELECT *, floor(n * 0.5 + (n - s) * fold / 4) AS a, floor(n * 0.5 + (n - s) * (fold + 1) / 4) AS b FROM e)
    SELECT symbol, ts, fold::INTEGER AS fold, CASE WHEN i >= a AND i < b THEN 'test' ELSE 'train' END AS part FROM k WHERE (i >= a AND i < b) OR i < a - 5"""
)
def walk_forward(spark, d):
    return shown(outcomes.walk_forward(daily(spark, d).select("symbol", "ts"), ["ts"], ["symbol"], 4, 0.5, 5))


@query(
    """WITH RECURSIVE s AS (SELECT event_type, event_id, epoch(ts) AS a, epoch(ts) + value * 300 AS b, row_number() OVER (PARTITION BY event_type ORDER BY epoch(ts), epoch(ts) + value * 300) AS k FROM events),
    w(event_type, k, event_id, free, taken) AS (SELECT event_type, k, event_id, b, true FROM s WHERE k = 1 UNION ALL SELECT s.event_type, s.k, s.event_id, CASE WHEN s.a >= w.free THEN s.b ELSE w.free END, s.a >= w.free FROM w JOIN s ON s.event_type = w.event_type AND s.k = w.k + 1)
    SELECT event_type, event_id FROM w WHERE taken"""
)
def non_overlapping(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("a"), "value").withColumn("b", F.col("a") + F.col("value") * 300).drop("value")
    return outcomes.non_overlapping(e, "event_type", "a", "b").select("event_type", "event_id")


# ---- across series -------------------------------------------------------------------------------------------------
RET = "r AS (SELECT symbol, ts, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars), k AS (SELECT ts FROM r WHERE r IS NOT NULL GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)), a AS (SELECT r.* FROM r JOIN k USING (ts) WHERE r IS NOT NULL)"


@query(f"WITH {DAILY}, {RET} SELECT x.symbol AS a, y.symbol AS b, {r6('corr(x.r, y.r) AS corr', 'covar_samp(x.r, y.r) / var_samp(y.r) AS beta')}, count(*) AS n FROM a x JOIN a y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY 1, 2")
def corr_matrix(spark, d):
    return shown(cross.correlation_matrix(cross.aligned_returns(daily(spark, d))))


@query(
    f"""WITH {DAILY}, {RET}, w AS (SELECT ts, max(r) FILTER (WHERE symbol = '1-URGENT') AS x, max(r) FILTER (WHERE symbol = '2-HIGH') AS y FROM a GROUP BY ts)
    SELECT ts, round(CASE WHEN count(*) OVER v = 60 THEN corr(x, y) OVER v END, 6) AS corr FROM w WHERE x IS NOT NULL AND y IS NOT NULL WINDOW v AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""
)
def rolling_corr(spark, d):
    return shown(cross.rolling_correlation(cross.aligned_returns(daily(spark, d)), "1-URGENT", "2-HIGH", 60), "ts", "corr")


@query(
    f"""WITH {DAILY}, {RET}, p AS (SELECT ts, symbol AS leader, lag(r) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM a)
    SELECT leader, a.symbol AS follower, round(corr(a.r, y), 6) AS corr, count(*) AS n FROM a JOIN p USING (ts) WHERE leader <> a.symbol AND y IS NOT NULL GROUP BY 1, 2"""
)
def lead_lag(spark, d):
    return shown(cross.lead_lag(cross.aligned_returns(daily(spark, d))))


@query(
    f"""WITH {HOURLY}, grid AS (SELECT t.ts, s.symbol FROM (SELECT DISTINCT ts FROM bars) t, (SELECT DISTINCT symbol FROM bars) s), g AS (SELECT grid.symbol, grid.ts, ln(last_value(b.c IGNORE NULLS) OVER (PARTITION BY grid.symbol ORDER BY grid.ts ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)) AS p FROM grid LEFT JOIN bars b ON b.symbol = grid.symbol AND b.ts = grid.ts),
    q AS (SELECT *, p - lag(p) OVER (PARTITION BY symbol ORDER BY ts) AS r, p - lag(p, 12) OVER (PARTITION BY symbol ORDER BY ts) AS m FROM g),
    z AS (SELECT symbol, ts, m / nullif(CASE WHEN count(r) OVER w >= 30 THEN stddev_samp(r) OVER w END * sqrt(12), 0) AS z FROM q WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, round(CASE WHEN count(z) OVER (PARTITION BY ts) >= 4 THEN z - avg(z) OVER (PARTITION BY ts) END, 6) AS strength FROM z"""
)
def strength(spark, d):
    return shown(cross.strength(hourly(spark, d), 12, 100, 30, 4))


# ---- options -------------------------------------------------------------------------------------------------------
CHAIN = "chain AS (SELECT p_brand AS ticker, CASE WHEN l_returnflag = 'A' THEN 'call' ELSE 'put' END AS side, (p_size * 2 + 60)::DOUBLE AS strike, sum(l_quantity) AS oi, count(*)::DOUBLE AS volume, 0.1 + avg(l_tax) AS iv, 100.0::DOUBLE AS spot, 0.1::DOUBLE AS years FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def _chain(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.groupBy(F.col("p_brand").alias("ticker"), F.when(F.col("l_returnflag") == "A", "call").otherwise("put").alias("side"), (F.col("p_size") * 2 + 60).cast("double").alias("strike"))
    return rows.agg(F.sum("l_quantity").alias("oi"), F.count("*").cast("double").alias("volume"), (0.1 + F.avg("l_tax")).alias("iv"), F.lit(100.0).alias("spot"), F.lit(0.1).alias("years"))


@query(
    f"""WITH {CHAIN}, k AS (SELECT DISTINCT ticker, strike FROM chain), p AS (SELECT k.ticker, k.strike, round(sum(CASE WHEN side = 'call' THEN greatest(k.strike - c.strike, 0) ELSE greatest(c.strike - k.strike, 0) END * oi), 6) AS pain FROM k JOIN chain c ON c.ticker = k.ticker GROUP BY 1, 2)
    SELECT ticker, arg_min(strike, (pain, strike)) AS max_pain, min(pain) AS pain FROM p GROUP BY 1"""
)
def max_pain(spark, d):
    return shown(options.max_pain(_chain(spark, d)))


GEX = f"{CHAIN}, d AS (SELECT *, (ln(spot / strike) + (0.04 + 0.5 * iv * iv) * years) / (iv * sqrt(years)) AS d1 FROM chain), gex AS (SELECT ticker, strike, sum(CASE WHEN side = 'call' THEN 1 ELSE -1 END * exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (spot * iv * sqrt(years)) * oi * 100 * spot * spot * 0.01) AS gex, max(spot) AS spot FROM d GROUP BY 1, 2)"


@query(f"WITH {GEX} SELECT ticker, strike, round(gex, 4) AS gex FROM gex")
def gex(spark, d):
    return options.gamma_exposure(_chain(spark, d)).select("ticker", "strike", F.round("gex", 4).alias("gex"))


@query(
    f"""WITH {GEX}, c AS (SELECT *, sum(gex) OVER (PARTITION BY ticker ORDER BY strike ROWS UNBOUNDED PRECEDING) AS cum FROM gex), p AS (SELECT *, lag(cum) OVER (PARTITION BY ticker ORDER BY strike) AS c0, lag(strike) OVER (PARTITION BY ticker ORDER BY strike) AS k0 FROM c),
    x AS (SELECT ticker, spot, k0 + (strike - k0) * -c0 / (cum - c0) AS x FROM p WHERE c0 * cum < 0) SELECT ticker, round(arg_min(x, (abs(x - spot), x)), 5) AS flip FROM x GROUP BY 1"""
)
def gamma_flip(spark, d):
    return options.gamma_flip(options.gamma_exposure(_chain(spark, d))).select("ticker", F.round("flip", 5).alias("flip"))


@query(f"WITH {CHAIN} SELECT ticker, side, strike, oi, rank::INTEGER AS rank FROM (SELECT ticker, side, strike, oi, row_number() OVER (PARTITION BY ticker, side ORDER BY oi DESC, strike) AS rank FROM chain WHERE oi > 0) WHERE rank <= 5")
def walls(spark, d):
    return options.walls(_chain(spark, d))


@query(
    f"""WITH {CHAIN}, n AS (SELECT ticker, arg_min(strike, (abs(strike - spot), strike)) AS atm FROM chain GROUP BY 1)
    SELECT ticker, {r6("sum(oi) FILTER (WHERE side = 'call') AS call_oi", "sum(oi) FILTER (WHERE side = 'put') AS put_oi", "sum(oi) FILTER (WHERE side = 'put') / sum(oi) FILTER (WHERE side = 'call') AS oi_ratio", "avg(iv) FILTER (WHERE strike = atm) AS atm_iv", "100 * avg(iv) FILTER (WHERE strike = atm) * sqrt(0.1::DOUBLE) AS expected_move",
    "avg(iv) FILTER (WHERE side = 'put' AND strike BETWEEN 93 AND 97) - avg(iv) FILTER (WHERE side = 'call' AND strike BETWEEN 103 AND 107) AS skew")} FROM chain JOIN n USING (ticker) GROUP BY 1"""
)
def chain_summary(spark, d):
    return shown(options.chain_summary(_chain(spark, d)), "ticker", "call_oi", "put_oi", "oi_ratio", "atm_iv", "expected_move", "skew")
