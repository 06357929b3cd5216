"""Queries over whole sets of indicators: feature columns of each bar, and the pack of each symbol's last one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators
from .common import DAILY, daily, r6, shown
from .market import _over, _smooth

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Bars with what smoothing reads, and the smoothed series: range e, gains u, losses w, the long mean m, fast a and slow b.
_ALL = f"""xa AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY ts) AS pc, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars),
x AS MATERIALIZED (SELECT *, greatest(h - l, coalesce(abs(h - pc), 0), coalesce(abs(l - pc), 0)) AS tr FROM xa),
{_smooth('tr', '(1.0::DOUBLE / 14)', 14, 'e')}, {_smooth('c', '(2.0::DOUBLE / 22)', 21, 'm')}, {_smooth('c', '(2.0::DOUBLE / 13)', 12, 'a')}, {_smooth('c', '(2.0::DOUBLE / 27)', 26, 'b')},
g AS MATERIALIZED (SELECT symbol, i - 1 AS i, greatest(c - pc, 0) AS up, greatest(pc - c, 0) AS down FROM x WHERE i > 1),
{_smooth('up', '(1.0::DOUBLE / 14)', 14, 'u').replace('FROM x', 'FROM g AS x').replace('JOIN x', 'JOIN g AS x')}, {_smooth('down', '(1.0::DOUBLE / 14)', 14, 'w').replace('FROM x', 'FROM g AS x').replace('JOIN x', 'JOIN g AS x')},
sm AS (SELECT symbol, i, {', '.join(f'CASE WHEN count(*) {_over(n)} = {n} THEN avg(c) {_over(n)} END AS sma{n}' for n in (20, 50, 200))}, stddev_pop(c) {_over(20)} AS dev FROM x),
al AS (SELECT x.*, CASE WHEN x.i >= 14 THEN e.y END AS atr, CASE WHEN x.i >= 15 THEN CASE WHEN w.y = 0 AND u.y = 0 THEN 50 WHEN w.y = 0 THEN 100 ELSE 100 - 100 / (1 + u.y / w.y) END END AS rsi, CASE WHEN x.i >= 21 THEN m.y END AS ema21, CASE WHEN x.i >= 26 THEN a.y - b.y END AS macd, sma20, sma50, sma200, dev
  FROM x JOIN e USING (symbol, i) JOIN m USING (symbol, i) JOIN a USING (symbol, i) JOIN b USING (symbol, i) JOIN sm USING (symbol, i) LEFT JOIN u ON u.symbol = x.symbol AND u.i = x.i - 1 LEFT JOIN w ON w.symbol = x.symbol AND w.i = x.i - 1)"""


@query(f"WITH RECURSIVE {DAILY}, {_ALL} SELECT symbol, ts, {r6('atr / c AS atr_pct', 'rsi AS rsi_14', *(f'c / sma{n} - 1 AS dist_sma{n}' for n in (20, 50, 200)))} FROM al")
def level_features(spark, d):
    """The average range as a share of the close, the strength index, and distances to three means."""
    return shown(indicators.level_features(daily(spark, d)), "symbol", "ts", "atr_pct", "rsi_14", "dist_sma20", "dist_sma50", "dist_sma200")


_DIST = [f"(c - {k}) / nullif(atr, 0) AS dist_{k}_atr" for k in ("sma20", "sma50", "sma200", "ema21")]


@query(
    f"""WITH RECURSIVE {DAILY}, {_ALL}, la AS (SELECT symbol, max(ts) AS last_ts FROM bars GROUP BY 1), yr AS (SELECT symbol, max(h) AS high_52w, min(l) AS low_52w FROM bars JOIN la USING (symbol) WHERE ts >= last_ts - INTERVAL 365 days GROUP BY 1)
    SELECT symbol, ts, {r6('c AS last', '(c / pc - 1) * 100 AS change_pct', 'atr AS atr14', 'atr / c * 100 AS atr14_pct', 'rsi AS rsi14', 'sma20 AS sma20', 'sma50 AS sma50', 'sma200 AS sma200', 'ema21 AS ema21', 'macd AS macd', 'sma20 + 2 * dev AS upper', 'sma20 - 2 * dev AS lower', *_DIST, 'high_52w AS high_52w', 'low_52w AS low_52w', '(c - low_52w) / nullif(high_52w - low_52w, 0) * 100 AS position_pct')}
    FROM al JOIN la USING (symbol) JOIN yr USING (symbol) WHERE ts = last_ts"""
)
def frame_pack(spark, d):
    """What the last bar of each symbol shows, with its place in the range of a year."""
    return shown(indicators.frame_pack(daily(spark, d)))
