"""Ordered joins: as-of in either direction, bounded forward fill, first hits and bucketed ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], direction: str = "backward", inclusive: bool = True) -> DataFrame:
    """left with `values` of the last right row at or before it (or the next at or after it), within `by`.

    One shuffle on `by` of both sides together and a running last value: no pair of rows is formed, whatever a key's
    size. Equal instants match if inclusive. Of right rows at one instant the last in the order of the values counts.
    """
    back = direction == "backward"
    names = [f"v{i}_" for i in range(len(values))]
    keep = [c for c in left.columns]
    # at equal instants right rows come first going backward if they count, else last
    side = 0 if inclusive else 2
    ls = left.select(F.struct(*keep).alias("row_"), *[F.col(b).alias(f"k{i}_") for i, b in enumerate(by)], F.col(left_ts).alias("t_"), F.lit(1).alias("side_"), F.lit(None).alias("val_"))
    rs = right.select(F.lit(None).alias("row_"), *[F.col(b).alias(f"k{i}_") for i, b in enumerate(by)], F.col(right_ts).alias("t_"), F.lit(side).alias("side_"), F.struct(*[F.col(v).alias(n) for v, n in zip(values, names, strict=True)]).alias("val_"))
    both = ls.unionByName(rs)
    order = [F.col("t_"), F.col("side_"), F.col("val_")] if back else [F.col("t_").desc(), F.col("side_"), F.col("val_").desc()]
    own = Window.partitionBy(*[f"k{i}_" for i in range(len(by))]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("hit_", F.last("val_", ignorenulls=True).over(own)).where("side_ = 1")
    return out.select("row_.*", *[F.col(f"hit_.{n}").alias(v) for v, n in zip(values, names, strict=True)])


def grid(bars: DataFrame) -> DataFrame:
    """(ts, symbol) of every instant and every symbol: both meet by equality on the instant's bucket, each in its task."""
    parts = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = bars.select("ts").distinct().withColumn("b_", F.pmod(F.xxhash64("ts"), F.lit(parts)).cast("int"))
    names = bars.select("symbol").distinct().withColumn("b_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return at.join(names, "b_").drop("b_")


def fill_forward(rows: DataFrame, by: list[str], ts: str, value: str, limit: int) -> DataFrame:
    """Nulls of `value` take the last known one at most `limit` rows back."""
    own = Window.partitionBy(*by).orderBy(ts).rowsBetween(-limit, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(own))


def first_hit(bars: DataFrame, horizon: int, hit: Column, name: str) -> DataFrame:
    """For each bar, how many bars later (1 to horizon) `hit` first holds, null if never. `hit` is an expression over a
    later bar `x` and the bar's own columns, as in F.col('x.h') >= F.col('c') + 1."""
    own = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1, horizon)
    ahead = bars.withColumn("ahead_", F.collect_list(F.struct("o", "h", "l", "c")).over(own))
    return ahead.withColumn(name, hit).drop("ahead_")


def range_join(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, bucket: float, inclusive_end: bool = False) -> DataFrame:
    """Points joined to the spans that hold them, by equality on buckets of `bucket` units (seconds for timestamps).

    A span is repeated once for each bucket that it touches, so choose a bucket near the usual span."""
    number = lambda c: F.floor((F.unix_micros(c) / 1e6 if dict(spans.dtypes).get(start, "").startswith("timestamp") else c) / bucket)
    p = points.withColumn("b_", number(F.col(at)))
    s = spans.withColumn("b_", F.explode(F.sequence(number(F.col(start)), number(F.col(end)))))
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if inclusive_end else (F.col(at) < F.col(end)))
    return p.join(s, [*by, "b_"]).where(inside).drop("b_")
