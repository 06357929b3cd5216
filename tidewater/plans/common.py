"""Inputs and output rules that the query modules share: bars of the test tables, rounding, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars
from ..session import table

#: Hourly bars of event values, daily bars of order prices; ties by key.
HOURLY = "bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, event_id)) AS c, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2)"
DAILY = "bars AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o, max(o_totalprice) AS h, min(o_totalprice) AS l, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS c, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2)"
NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars)"


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.ticks(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.from_ticks(event_ticks(spark, sf_dir), "1h")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.from_ticks(bars.ticks(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey"), "1d")


def shown(df: DataFrame, *cols: str) -> DataFrame:
    """Chosen columns, doubles to six places (sums differ in their last bits), instants without zone."""
    df = df.select(*cols) if cols else df
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("timestamp_ntz").alias(c) if kinds[c] == "timestamp" else F.col(c) for c in df.columns])


def r6(*exprs: str) -> str:
    """SQL of expressions 'value AS name' rounded as shown() does."""
    out = []
    for e in exprs:
        value, _, name = e.rpartition(" AS ")
        out.append(f"round({value}, 6) AS {name}")
    return ", ".join(out)
