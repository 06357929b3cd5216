"""Readers of candle and tick files into (symbol, ts, o, h, l, c, v), and the minute store."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bars import NEW_YORK, prefer

#: The layouts of the supported files.
SEMICOLON_SCHEMA = "stamp string, o double, h double, l double, c double, v double"
SEMICOLON_STAMP = "yyyyMMdd HHmmss"
DAY_RECORD = np.dtype([("sec", ">u4"), ("o", ">u4"), ("c", ">u4"), ("l", ">u4"), ("h", ">u4"), ("v", ">f4")])
NESTED_SCHEMA = "instrument string, granularity string, candles array<struct<complete:boolean,volume:double,time:string,mid:struct<o:string,h:string,l:string,c:string>>>"


def _symbol_of(path: Column) -> Column:
    """The first six letters in a row of a file's name, upper-cased."""
    return F.upper(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"([A-Za-z]{6})", 1))


def local_to_utc(ts: Column, zone: str) -> Column:
    """A local wall time as an instant. Times that clocks skip move forward; those that happen twice are null."""
    instant = F.to_utc_timestamp(ts, zone)
    again = F.from_utc_timestamp(instant + F.expr("interval 1 hour"), zone) == ts
    return F.when(~again, instant)


def detect_zone(stamps: DataFrame, ts: str = "ts", daily_break: int = 45) -> DataFrame:
    """Which clock a file with a daily break runs on: the usual hour before the summer's breaks is 16 in New York wall
    time and 15 five hours behind UTC all year. One row: zone; null where there are no summer breaks."""
    # each month's stamps in order, with the first one of the next month at its end
    month = F.date_trunc("month", F.col(ts))
    firsts = stamps.groupBy(F.add_months(month, -1).cast("timestamp").alias("m_")).agg(F.min(ts).alias("after_"))
    rows = stamps.select(ts, month.alias("m_")).join(F.broadcast(firsts), "m_", "left")
    rows = rows.withColumn("next", F.coalesce(F.lead(ts).over(Window.partitionBy("m_").orderBy(ts)), "after_"))
    breaks = rows.where((F.col("next") > F.col(ts) + F.expr(f"interval {daily_break} minutes")) & F.month(ts).between(6, 8))
    hour = breaks.agg(F.mode(F.hour(ts), True).alias("h"))
    return hour.select(F.when(F.col("h") == 16, NEW_YORK).when(F.col("h") == 15, "-05:00").alias("zone"))


def read_semicolon(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """Minute files of 'yyyyMMdd HHmmss;o;h;l;c;v' in the clock of `zone`; the symbol is in the file's name."""
    return parse_semicolon(spark.read.text(path).withColumn("symbol", _symbol_of(F.col("_metadata.file_path"))), zone)


def parse_semicolon(lines: DataFrame, zone: str) -> DataFrame:
    """Bars of lines (symbol, value); damaged ones go."""
    rows = lines.select("symbol", F.from_csv("value", SEMICOLON_SCHEMA, {"sep": ";"}).alias("k")).select("symbol", "k.*")
    local = F.try_to_timestamp("stamp", F.lit(SEMICOLON_STAMP))
    return rows.select("symbol", local_to_utc(local, zone).alias("ts"), "o", "h", "l", "c", "v").where("ts is not null and c is not null")


def read_terminal(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """Exports of a trading terminal: 'yyyy.MM.dd HH:mm' in one or two columns, with or without a header, parted by tabs
    or commas; lines of neither layout go."""
    return parse_terminal(spark.read.text(path).withColumn("symbol", _symbol_of(F.col("_metadata.file_path"))), zone)


def parse_terminal(rows: DataFrame, zone: str) -> DataFrame:
    """Bars of such lines (symbol, value)."""
    parts = F.split(F.col("value"), r"[,\t]")
    stamp = F.try_to_timestamp(F.concat_ws(" ", parts[0], F.substring(parts[1], 1, 5)), F.lit("yyyy.MM.dd HH:mm"))
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    out = rows.select("symbol", local_to_utc(stamp, zone).alias("ts"), number(3).alias("o"), number(4).alias("h"), number(5).alias("l"), number(6).alias("c"), F.coalesce(number(7), F.lit(0.0)).alias("v"))
    return out.where("ts is not null and c is not null")


def read_nested_json(spark: SparkSession, path: str) -> DataFrame:
    """Responses with an array of candles with mid prices as text; incomplete candles have complete false."""
    return parse_nested(spark.read.text(path, wholetext=True))


def parse_nested(payloads: DataFrame) -> DataFrame:
    """Bars of such responses as text (value)."""
    rows = payloads.select(F.from_json("value", NESTED_SCHEMA).alias("p")).select("p.instrument", F.explode("p.candles").alias("k"))
    price = lambda p: F.col(f"k.mid.{p}").try_cast("double").alias(p)
    out = rows.select(F.regexp_replace("instrument", "_", "").alias("symbol"), F.col("k.time").try_cast("timestamp").alias("ts"), *(price(p) for p in "ohlc"), F.col("k.volume").alias("v"), F.coalesce("k.complete", F.lit(True)).alias("complete"))
    return out.where("ts is not null and c is not null")


def decode_day(blob: bytes, divisor: float) -> np.ndarray:
    """Records of one compressed day; minutes without volume go."""
    raw = lzma.decompress(blob) if blob else b""
    rows = np.frombuffer(raw[: len(raw) // DAY_RECORD.itemsize * DAY_RECORD.itemsize], DAY_RECORD)
    return rows[rows["v"] > 0]


def encode_day(rows: np.ndarray) -> bytes:
    return lzma.compress(rows.astype(DAY_RECORD).tobytes(), format=lzma.FORMAT_ALONE)


def read_days(spark: SparkSession, path: str, divisor: float) -> DataFrame:
    """Compressed day files named .../SYMBOL/yyyy-MM-dd.bi5: one task reads a file, whose size a day bounds."""
    files = spark.read.format("binaryFile").load(path)
    name = F.split("path", "/")
    return decode_days(files.select(F.element_at(name, -2).alias("symbol"), F.regexp_extract(F.element_at(name, -1), r"(\d{4}-\d{2}-\d{2})", 1).alias("day"), "content").where("day <> ''"), divisor)


def encode_days(bars: DataFrame, divisor: float) -> DataFrame:
    """(symbol, day, content) of bars: each day's as one compressed record block."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("sec")
        rows = np.zeros(len(own), DAY_RECORD)
        rows["sec"], rows["v"] = own["sec"], own["v"]
        for k in "ohlc":
            rows[k] = np.rint(own[k].to_numpy(float) * divisor)
        return pd.DataFrame({"symbol": [own["symbol"].iloc[0]], "day": [own["day"].iloc[0]], "content": [encode_day(rows)]})

    rows = bars.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.unix_timestamp("ts") % 86400).alias("sec"), "o", "h", "l", "c", "v")
    return rows.groupBy("symbol", "day").applyInPandas(run, "symbol string, day string, content binary")


def decode_days(files: DataFrame, divisor: float) -> DataFrame:
    """Bars of compressed days (symbol, day, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for symbol, day, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows = decode_day(blob, divisor)
                ts = (np.datetime64(day, "us") + rows["sec"].astype("timedelta64[s]")).astype("datetime64[us]")
                cols = [pa.array([symbol] * len(rows), pa.string()), pa.array(ts, pa.timestamp("us", "UTC"))]
                cols += [pa.array(rows[k].astype(float) / divisor) for k in "ohlc"] + [pa.array(rows["v"].astype(float))]
                yield pa.RecordBatch.from_arrays(cols, ["symbol", "ts", "o", "h", "l", "c", "v"])

    return files.select("symbol", "day", "content").mapInArrow(run, "symbol string, ts timestamp, o double, h double, l double, c double, v double")


def write_store(spark: SparkSession, bars: DataFrame, path: str, replace: bool = False) -> None:
    """Merges bars into a table partitioned by symbol and year: minutes already there stay unless `replace`. Only the
    years that `bars` touches are read and written again; the merge is checkpointed before it overwrites its input."""
    from ..session import checkpointed

    new = bars.withColumn("year", F.year("ts"))
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = None
    if old is not None:
        old = old.join(F.broadcast(new.select("symbol", "year").distinct()), ["symbol", "year"], "left_semi").select(*new.columns)
        new = checkpointed(prefer(new, old, ["symbol", "ts"]) if replace else prefer(old, new, ["symbol", "ts"]))
    new.repartition("symbol", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "year").parquet(path)


def read_store(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None) -> DataFrame:
    """Bars of the store; symbols and the start's year prune its folders."""
    rows = spark.read.parquet(path)
    if symbols:
        rows = rows.where(F.col("symbol").isin(symbols))
    if start:
        rows = rows.where((F.col("year") >= int(start[:4])) & (F.col("ts") >= F.lit(start).cast("timestamp")))
    return rows.drop("year")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of the store's files: equal before and after, the store is unchanged."""
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified")).distinct()
