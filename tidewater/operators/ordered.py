"""Row numbers and running sums over ordered groups of any size: by ranges, with what earlier ranges add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

RANGE_ROWS = 1_000_000


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds to rows of each group, in order: n (from 1), of (rows of the group) and, by name, running sums.

    Rows are cut into ranges of (group, order), so that a group of any size lies in many tasks. A window numbers and sums
    up each range's part of a group; a table of one row for each such part gives what the earlier parts add. Groups that
    are null are a group. Rows that tie in the order are numbered in any order."""
    sums = sums or {}
    parts = rows.count() // range_rows + 1
    ranged = rows.withColumns({f"s_{k}": v for k, v in sums.items()})
    if parts == 1:
        whole, so_far = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(*order)
        totals = {k: F.sum(f"s_{k}").over(so_far.rowsBetween(Window.unboundedPreceding, 0)) for k in sums}
        return ranged.withColumns({"n": F.row_number().over(so_far).cast("long"), "of": F.count("*").over(whole), **totals}).select(*rows.columns, "n", "of", *sums)
    ranged = checkpointed(ranged.repartitionByRange(parts, *by, *order).withColumn("part_", F.spark_partition_id()))
    key = [*by, "part_"]
    own = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumns({"n": F.row_number().over(Window.partitionBy(*key).orderBy(*order)), **{k: F.sum(f"s_{k}").over(own) for k in sums}})
    parted = ranged.groupBy(*key).agg(F.count("*").alias("rows_"), *(F.sum(f"s_{k}").alias(f"t_{k}") for k in sums))
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    before = parted.select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(key)], F.coalesce(F.sum("rows_").over(earlier), F.lit(0)).alias("b_n"), F.sum("rows_").over(whole).alias("of"), *(F.coalesce(F.sum(f"t_{k}").over(earlier), F.lit(0)).alias(f"b_{k}") for k in sums))
    on = [ranged[k].eqNullSafe(before[f"k{i}_"]) for i, k in enumerate(key)]
    for i, c in enumerate(on[1:], 1):
        on[0] = on[0] & c
    out = ranged.join(before, on[0])
    return out.withColumns({"n": F.col("n") + F.col("b_n"), **{k: F.col(k) + F.col(f"b_{k}") for k in sums}}).select(*rows.columns, "n", "of", *sums)


def running_peak(rows: DataFrame, by: list[str], value: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds to rows numbered by running() the largest value up to each: blocks of neighbouring numbers have their own
    running maximum, and the largest of the blocks before."""
    rows = rows.withColumn("block_", F.floor((F.col("n") - 1) / range_rows))
    key = [*by, "block_"]
    rows = rows.withColumn("own_", F.max(value).over(Window.partitionBy(*key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    tops = rows.groupBy(*key).agg(F.max(value).alias("top_"))
    earlier = Window.partitionBy(*by).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(key)], F.max("top_").over(earlier).alias("before_"))
    on = rows[key[0]].eqNullSafe(tops["k0_"])
    for i, k in enumerate(key[1:], 1):
        on = on & rows[k].eqNullSafe(tops[f"k{i}_"])
    return rows.join(tops, on).withColumn(name, F.greatest("own_", "before_")).drop("block_", "own_", "before_", *[f"k{i}_" for i in range(len(key))])


def tile(n: Column, of: Column, tiles: int) -> Column:
    """Which of `tiles` blocks, from 1, a row number falls into: sizes differ by one at most, larger ones first."""
    small, larger = F.floor(of / tiles), of % tiles
    head = larger * (small + 1)
    return F.when(n <= head, F.floor((n - 1) / (small + 1)) + 1).otherwise(larger + F.floor((n - 1 - head) / F.nullif(small, F.lit(0))) + 1)


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Exact percentiles of each group by name, linear between neighbouring values, as percentile() gives them; null for
    groups without a value. Equal values are counted first, their running counts lie in ranges, and a percentile is the
    least value that the count of its rank reaches, so that no task holds a group's values."""
    counts = checkpointed(rows.groupBy(*by, F.col(value).cast("double").alias("v_")).agg(F.count(value).alias("c_")))
    upto = running(counts, by, ["v_"], {"upto_": F.col("c_")}, range_rows)
    totals = counts.groupBy(*[F.col(k).alias(f"g{i}_") for i, k in enumerate(by)]).agg(F.sum("c_").alias("of_"))
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & upto[k].eqNullSafe(totals[f"g{i}_"])
    place = {name: F.lit(q) * (F.col("of_") - 1) for name, q in shares.items()}
    at = lambda rank: F.min(F.when(F.col("upto_") > rank, F.col("v_")))
    found = upto.drop("of").join(totals, on).groupBy(*by, "of_").agg(*(c for name, p in place.items() for c in (at(F.floor(p)).alias(f"low_{name}"), at(F.ceil(p)).alias(f"high_{name}"))))
    between = lambda low, high, p: F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)
    return found.select(*by, *(between(F.col(f"low_{name}"), F.col(f"high_{name}"), p).alias(name) for name, p in place.items()))
