"""Indicators over ordered bars: rolling frames, and recursions by chunks of time with one number carried between them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_symbol():
    """Rows of a symbol in time order; made on use, since a window needs a running session."""
    return Window.partitionBy("symbol").orderBy("ts")


def rolling(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def full(value: Column, n: int, of: str = "c") -> Column:
    """value where the last n rows are all there, else null."""
    return F.when(F.count(F.col(of)).over(rolling(n)) == n, value)


def sma(of: str, n: int) -> Column:
    return full(F.avg(of).over(rolling(n)), n, of)


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Mean and bands of k population deviations, place within them and their width over the mean."""
    mid, dev = F.avg("c").over(rolling(n)), F.stddev_pop("c").over(rolling(n))
    out = bars.withColumns({"mid": full(mid, n), "upper": full(mid + k * dev, n), "lower": full(mid - k * dev, n)})
    width = F.col("upper") - F.col("lower")
    return out.withColumns({"pct_b": F.when(width != 0, (F.col("c") - F.col("lower")) / width), "bandwidth": F.when(F.col("mid") != 0, width / F.col("mid"))})


def log_return(n: int = 1) -> Column:
    return F.log(F.col("c") / F.lag("c", n).over(by_symbol()))


def realized_vol(bars: DataFrame, n: int = 20) -> DataFrame:
    """Sample deviation of n log returns, by the year: bars a year follow from the symbol's span, 252 under 3 bars."""
    whole = Window.partitionBy("symbol")
    count, span = F.count("*").over(whole), (F.unix_timestamp(F.max("ts").over(whole)) - F.unix_timestamp(F.min("ts").over(whole))) / 86400 / 365.25
    a_year = F.when((count < 3) | (span <= 0), 252.0).otherwise((count - 1) / span)
    out = bars.withColumn("r", log_return()).withColumn("a_year", a_year)
    return out.withColumn("rv", F.when(F.count("r").over(rolling(n)) == n, F.stddev_samp("r").over(rolling(n)) * F.sqrt("a_year")))


def true_range() -> Column:
    before = F.lag("c").over(by_symbol())
    return F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before))


#: Rows of a chunk at most, and seconds of time that one lies in.
CHUNK_ROWS, CHUNK_SECONDS = 256, 32 * 86400


def smoothed(rows: DataFrame, columns: dict[str, tuple[str, float, int]]) -> DataFrame:
    """Adds exponential averages: name -> (source column, weight of the newest value, values needed). Each starts at its
    source's first value, skips nulls and is null until it has seen enough values.

    Rows are cut into chunks of time. Within one, a running sum of weighted values gives what its rows add; what a chunk
    passes on is one number and a count for each average, carried from chunk to chunk in a small pass over these alone."""
    keep = {name: 1 - alpha for name, (_, alpha, _) in columns.items()}
    size = min([CHUNK_ROWS, *(int(250 / -math.log10(w)) for w in keep.values() if w > 0)])
    own = Window.partitionBy("symbol", "bucket_").orderBy("ts")
    rows = rows.withColumn("bucket_", F.floor(F.unix_timestamp("ts") / CHUNK_SECONDS))
    rows = rows.withColumn("chunk_", F.floor((F.row_number().over(own) - 1) / size))
    key = ["symbol", "bucket_", "chunk_"]
    chunk = Window.partitionBy(*key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"n_{name}": F.count(source).over(chunk) for name, (source, _, _) in columns.items()})
    # a value of the k-th row counts w^(n-k) at the n-th: its share without w^n is summed up
    rows = rows.withColumns({f"t_{name}": F.sum(F.col(source) * F.pow(F.lit(keep[name] or 1.0), 1 - F.col(f"n_{name}"))).over(chunk) for name, (source, _, _) in columns.items()})
    parts = rows.groupBy(*key).agg(*[f.alias(f"{k}_{name}") for name, (source, _, _) in columns.items() for k, f in (
        ("n", F.max(f"n_{name}")), ("t", F.max_by(f"t_{name}", "ts")), ("f", F.min_by(source, F.when(F.col(source).isNotNull(), F.col("ts")))), ("l", F.max_by(source, F.when(F.col(source).isNotNull(), F.col("ts"))))
    )])
    schema = "symbol string, bucket_ long, chunk_ long" + "".join(f", c_{name} double, s_{name} long" for name in columns)

    def carry(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["bucket_", "chunk_"]).reset_index(drop=True)
        out = own[key].copy()
        for name, (_, alpha, _) in columns.items():
            w, value, seen = keep[name], None, 0
            came, before = [], []
            for n, t, first, last in zip(*(own[f"{k}_{name}"] for k in "ntfl"), strict=True):
                came.append(first if value is None and n else value)
                before.append(seen)
                if n:
                    value = w**n * came[-1] + alpha * w ** (n - 1) * t if w > 0 else last
                    seen += n
            out[f"c_{name}"], out[f"s_{name}"] = pd.array(came, "Float64"), before
        return out

    rows = rows.join(parts.groupBy("symbol").applyInPandas(carry, schema), key)
    for name, (source, alpha, least) in columns.items():
        w, n = F.lit(keep[name]), F.col(f"n_{name}")
        value = F.when(n == 0, F.col(f"c_{name}")).otherwise(F.pow(w, n) * F.col(f"c_{name}") + alpha * F.pow(w, n - 1) * F.col(f"t_{name}"))
        if keep[name] <= 0:
            value = F.coalesce(F.last(source, ignorenulls=True).over(chunk), F.col(f"c_{name}"))
        rows = rows.withColumn(name, F.when(F.col(f"s_{name}") + n >= least, value))
    return rows.drop("bucket_", "chunk_", *[f"{k}_{name}" for name in columns for k in "ntcs"])


def span(n: int) -> float:
    """Newest value's weight of an n-bar exponential average."""
    return 2 / (n + 1)


def ema(bars: DataFrame, n: int) -> DataFrame:
    return smoothed(bars, {"ema": ("c", span(n), n)})


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return smoothed(bars.withColumn("tr", true_range()), {"atr": ("tr", 1 / n, n)})


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's strength index: 100 without losses, 50 without moves, null until n moves."""
    move = F.col("c") - F.lag("c").over(by_symbol())
    rows = bars.withColumns({"gain": F.greatest(move, F.lit(0.0) * move), "loss": F.greatest(-move, F.lit(0.0) * move)})
    rows = smoothed(rows, {"up": ("gain", 1 / n, n), "down": ("loss", 1 / n, n)})
    value = F.when((F.col("down") == 0) & (F.col("up") == 0), 50.0).when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("up") / F.when(F.col("down") != 0, F.col("down"))))
    return rows.withColumn("rsi", F.when(F.col("up").isNotNull(), value)).drop("gain", "loss", "up", "down")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    rows = smoothed(bars, {"fast_": ("c", span(fast), fast), "slow_": ("c", span(slow), slow)})
    rows = smoothed(rows.withColumn("macd", F.col("fast_") - F.col("slow_")), {"signal": ("macd", span(signal), signal)})
    return rows.withColumn("histogram", F.col("macd") - F.col("signal")).drop("fast_", "slow_")


def trend_regime(bars: DataFrame, fast: int = 50, slow: int = 200, back: int = 10) -> DataFrame:
    """up where close > fast mean > slow mean and the fast mean rises over `back` bars; down where all is reversed;
    range else; unknown until the slow mean has `back` + 1 values. Symbols with under slow + back bars use 20 and 50."""
    count = F.count("*").over(Window.partitionBy("symbol"))
    short = count < slow + back
    a = F.when(short, sma("c", 20)).otherwise(sma("c", fast))
    b = F.when(short, sma("c", 50)).otherwise(sma("c", slow))
    out = bars.withColumns({"fast": a, "slow": b}).withColumn("slope", F.col("fast") - F.lag("fast", back).over(by_symbol())).withColumn("ready", F.row_number().over(by_symbol()) >= F.when(short, 50).otherwise(slow) + back + 1)
    up = (F.col("c") > F.col("fast")) & (F.col("fast") > F.col("slow")) & (F.col("slope") > 0)
    down = (F.col("c") < F.col("fast")) & (F.col("fast") < F.col("slow")) & (F.col("slope") < 0)
    return out.withColumn("regime", F.when(~F.col("ready"), "unknown").when(up, "up").when(down, "down").otherwise("range")).drop("ready")


def swing_points(bars: DataFrame, k: int = 3) -> DataFrame:
    """Centred windows of 2k + 1 bars, complete ones only: is the bar's high (low) their highest (lowest)."""
    own = by_symbol().rowsBetween(-k, k)
    whole = F.count("*").over(own) == 2 * k + 1
    return bars.withColumns({"swing_high": whole & (F.col("h") == F.max("h").over(own)), "swing_low": whole & (F.col("l") == F.min("l").over(own))})


def body_swings(bars: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """Extremes of bodies: strictly beyond the `left` bodies before and not beaten by the `right` after; known `right`
    bars later (confirmed)."""
    rows = bars.withColumns({"top": F.greatest("o", "c"), "bottom": F.least("o", "c"), "i": F.row_number().over(by_symbol()) - 1})
    before, after = by_symbol().rowsBetween(-left, -1), by_symbol().rowsBetween(1, right)
    whole = (F.count("*").over(before) == left) & (F.count("*").over(after) == right)
    high = whole & (F.col("top") > F.max("top").over(before)) & (F.col("top") >= F.max("top").over(after))
    low = whole & (F.col("bottom") < F.min("bottom").over(before)) & (F.col("bottom") <= F.min("bottom").over(after))
    return rows.withColumns({"body_high": high, "body_low": low, "confirmed": F.when(high | low, F.col("i") + right)})


def impulses(bars_with_atr: DataFrame, body: float = 1.5, outer: float = 0.25) -> DataFrame:
    """Bodies of at least `body` times the last bar's average range that close in the outer share of their range."""
    spread = F.col("h") - F.col("l")
    move = F.col("c") - F.col("o")
    big = F.abs(move) >= body * F.lag("atr").over(by_symbol())
    up = big & (move > 0) & (F.col("c") >= F.col("h") - outer * spread)
    down = big & (move < 0) & (F.col("c") <= F.col("l") + outer * spread)
    return bars_with_atr.withColumns({"impulse_up": F.coalesce(up, F.lit(False)), "impulse_down": F.coalesce(down, F.lit(False))})


def candle_shape(bars_with_atr: DataFrame) -> DataFrame:
    """Body and wick shares of the range, place of the close, range and moves over the average range."""
    spread = F.when(F.col("h") > F.col("l"), F.col("h") - F.col("l"))
    a = F.when(F.col("atr") > 0, F.col("atr"))
    cols = {
        "body": (F.col("c") - F.col("o")) / spread,
        "upper_wick": (F.col("h") - F.greatest("o", "c")) / spread,
        "lower_wick": (F.least("o", "c") - F.col("l")) / spread,
        "close_pos": (F.col("c") - F.col("l")) / spread,
        "range_atr": (F.col("h") - F.col("l")) / a,
    }
    return bars_with_atr.withColumns(cols | {f"move_{n}": (F.col("c") - F.lag("c", n).over(by_symbol())) / a for n in (4, 16, 96)})


def returns(bars: DataFrame, lags=(1, 2, 3, 5, 10, 20), ahead: int = 5) -> DataFrame:
    """Log returns over several lags, deviation ratios, place in the 20-bar range, hour and weekday (Monday 0), and the
    log return `ahead` bars on."""
    rows = bars.withColumns({f"ret_{n}": log_return(n) for n in lags})
    low, high = F.min("l").over(rolling(20)), F.max("h").over(rolling(20))
    return rows.withColumns(
        {
            "rv_20": full(F.stddev_samp("ret_1").over(rolling(20)), 20, "ret_1"),
            "rv_ratio": full(F.stddev_samp("ret_1").over(rolling(5)), 5, "ret_1") / F.nullif(full(F.stddev_samp("ret_1").over(rolling(20)), 20, "ret_1"), F.lit(0.0)),
            "range_pos_20": full((F.col("c") - low) / F.nullif(high - low, F.lit(0.0)), 20),
            "dow": F.weekday("ts"),
            "hour": F.hour("ts"),
            "target": F.log(F.lead("c", ahead).over(by_symbol()) / F.col("c")),
        }
    )


def forming(bars: DataFrame, coarse: Column) -> DataFrame:
    """What a coarser bar, named by `coarse`, looks like at each of its finer bars: first open, extremes and close so
    far, and the close's place between the extremes."""
    so_far = Window.partitionBy("symbol", "bin").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumn("bin", coarse)
    rows = rows.withColumns({"fo": F.first("o").over(so_far), "fh": F.max("h").over(so_far), "fl": F.min("l").over(so_far)})
    return rows.withColumn("fpos", (F.col("c") - F.col("fl")) / F.nullif(F.col("fh") - F.col("fl"), F.lit(0.0)))


def trailing_median_ratio(rows: DataFrame, of: str, days: int = 20) -> DataFrame:
    """`of` over its median of the last `days` days, the row itself not counted."""
    own = Window.partitionBy("symbol").orderBy(F.unix_timestamp("ts")).rangeBetween(-days * 86400, -1)
    return rows.withColumn("median", F.percentile(of, F.lit(0.5)).over(own)).withColumn("ratio", F.col(of) / F.col("median"))


def pivots(bars: DataFrame) -> DataFrame:
    """Classic pivot levels of each bar."""
    p = (F.col("h") + F.col("l") + F.col("c")) / 3
    spread = F.col("h") - F.col("l")
    rows = bars.withColumn("p", p)
    return rows.withColumns(
        {
            "r1": 2 * F.col("p") - F.col("l"), "s1": 2 * F.col("p") - F.col("h"),
            "r2": F.col("p") + spread, "s2": F.col("p") - spread,
            "r3": F.col("h") + 2 * (F.col("p") - F.col("l")), "s3": F.col("l") - 2 * (F.col("h") - F.col("p")),
        }
    )


def range_52w(bars: DataFrame, as_of: Column) -> DataFrame:
    """High, low and last close's place between them over the 365 days up to as_of."""
    rows = bars.where((F.col("ts") <= as_of) & (F.col("ts") > as_of - F.expr("interval 365 days")))
    out = rows.groupBy("symbol").agg(F.max("h").alias("high"), F.min("l").alias("low"), F.max_by("c", "ts").alias("close"))
    return out.withColumn("position", (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))


def z_move(bars: DataFrame, n: int, window: int = 5760, least: int = 1000) -> DataFrame:
    """The log move over n bars in deviations of one bar's return over `window` bars; null under `least` returns."""
    rows = bars.withColumn("r_", log_return())
    deviation = F.when(F.count("r_").over(rolling(window)) >= least, F.stddev_samp("r_").over(rolling(window)))
    return rows.withColumn("z", log_return(n) / F.nullif(deviation * F.sqrt(F.lit(n)), F.lit(0.0))).drop("r_")


def level_features(bars: DataFrame) -> DataFrame:
    """Adds atr_pct, rsi_14 and dist_sma20, 50 and 200: where a close stands, in shares of itself; null until the series are
    long enough, and where a mean is 0."""
    rows = rsi(atr(bars))
    c = F.col("c")
    return rows.withColumns({"atr_pct": F.col("atr") / F.nullif(c, F.lit(0.0)), "rsi_14": F.col("rsi")} | {f"dist_sma{n}": c / F.nullif(sma("c", n), F.lit(0.0)) - 1 for n in (20, 50, 200)}).drop("rsi", "tr")


def frame_pack(bars: DataFrame) -> DataFrame:
    """One row for each symbol's last bar: close, change, average range, strength, means and distances to them in average
    ranges, the difference of two means, bands, and high, low and place in the range of the 365 days up to it."""
    own = by_symbol()
    rows = macd(rsi(atr(bars))).withColumns({f"sma{n}": sma("c", n) for n in (20, 50, 200)} | {"dev_": F.stddev_pop("c").over(rolling(20)), "before_": F.lag("c").over(own)})
    rows = smoothed(rows, {"ema21": ("c", span(21), 21)})
    year = Window.partitionBy("symbol").orderBy(F.unix_timestamp("ts")).rangeBetween(-365 * 86400, 0)
    rows = rows.withColumns({"high_52w": F.max("h").over(year), "low_52w": F.min("l").over(year), "last_": F.max("ts").over(Window.partitionBy("symbol"))}).where("ts = last_")
    c, unit = F.col("c"), F.nullif("atr", F.lit(0.0))
    cols = {"last": c, "change_pct": (c / F.col("before_") - 1) * 100, "atr14": F.col("atr"), "atr14_pct": F.col("atr") / c * 100, "rsi14": F.col("rsi"), "upper": F.col("sma20") + 2 * F.col("dev_"), "lower": F.col("sma20") - 2 * F.col("dev_")}
    cols |= {f"dist_{k}_atr": (c - F.col(k)) / unit for k in ("sma20", "sma50", "sma200", "ema21")}
    cols["position_pct"] = (c - F.col("low_52w")) / F.nullif(F.col("high_52w") - F.col("low_52w"), F.lit(0.0)) * 100
    kept = ["last", "change_pct", "atr14", "atr14_pct", "rsi14", "sma20", "sma50", "sma200", "ema21", "macd", "upper", "lower", *(f"dist_{k}_atr" for k in ("sma20", "sma50", "sma200", "ema21")), "high_52w", "low_52w", "position_pct"]
    return rows.withColumns(cols).select("symbol", "ts", *kept)
