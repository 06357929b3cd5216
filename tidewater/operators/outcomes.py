"""What happened after each bar: first stop or target within a horizon, excursions, continuation, entries and their sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .indicators import by_symbol
from .ordered import running, running_peak


def _ahead(bars: DataFrame, horizon: int) -> DataFrame:
    """Bars with what follows within the horizon; an array of bounded length for each row, no join."""
    return bars.withColumn("ahead_", F.collect_list(F.struct("h", "l", "c")).over(by_symbol().rowsBetween(1, horizon)))


def _first(condition) -> Column:
    """Position, from 1, of the first later bar for which the condition holds; null if none."""
    at = F.array_position(F.transform("ahead_", condition), F.lit(True))
    return F.when(at > 0, at)


def _beyond(field: str, d: int, entry: Column, distance: str):
    """Has a later bar gone at least `distance` from the entry in direction d?"""
    return lambda x: d * (x[field] - entry) >= F.col(distance)


def trade_labels(bars: DataFrame, stop: Column, target: Column, spread: Column, horizon: int) -> DataFrame:
    """For a purchase and a sale at each close: does the target come before the stop within the horizon (a tie is a
    stop), and the result in units of the stop, net of the spread; what times out counts by its last close. best names
    the side that won, the better of two, else hold. All null where the horizon isn't complete."""
    rows = _ahead(bars, horizon).withColumns({"stop_": stop, "target_": target, "cost_": spread})
    whole = F.size("ahead_") == horizon
    c = F.col("c")
    for side, d in (("buy", 1), ("sell", -1)):
        low, high = ("l", "h") if d > 0 else ("h", "l")
        hit_stop = _first(_beyond(low, -d, c, "stop_"))
        hit_target = _first(_beyond(high, d, c, "target_"))
        won = hit_target.isNotNull() & (hit_stop.isNull() | (hit_target < hit_stop))
        gain = F.when(won, F.col("target_")).when(hit_stop.isNotNull(), -F.col("stop_")).otherwise(d * (F.element_at("ahead_", -1)["c"] - c))
        rows = rows.withColumns({side: F.when(whole, won.cast("int")), f"r_{side}": F.when(whole, (gain - F.col("cost_")) / F.col("stop_"))})
    best = F.when((F.col("buy") == 1) & ((F.col("sell") == 0) | (F.col("r_buy") >= F.col("r_sell"))), "buy").when(F.col("sell") == 1, "sell").otherwise("hold")
    return rows.withColumn("best", F.when(whole, best)).drop("ahead_", "stop_", "target_", "cost_")


def exits(bars: DataFrame, stop: Column, target: Column, horizon: int) -> DataFrame:
    """How a purchase at each close ends: loss, win or timeout, its result in price and the bars held. Unlike labels, an
    exit before the data ends counts even where the horizon isn't complete; what is still open is null."""
    rows = _ahead(bars, horizon).withColumns({"stop_": stop, "target_": target})
    c = F.col("c")
    rows = rows.withColumns({"s_": _first(lambda x: x["l"] <= c - F.col("stop_")), "t_": _first(lambda x: x["h"] >= c + F.col("target_"))})
    loss = F.col("s_").isNotNull() & (F.col("t_").isNull() | (F.col("s_") <= F.col("t_")))
    outcome = F.when(loss, "loss").when(F.col("t_").isNotNull(), "win").when(F.size("ahead_") == horizon, "timeout")
    move = F.when(loss, -F.col("stop_")).when(F.col("t_").isNotNull(), F.col("target_")).when(F.size("ahead_") == horizon, F.element_at("ahead_", -1)["c"] - c)
    held = F.when(loss, F.col("s_")).when(F.col("t_").isNotNull(), F.col("t_")).when(F.size("ahead_") == horizon, F.lit(horizon).cast("long"))
    return rows.withColumns({"outcome": outcome, "move": move, "held": held}).drop("ahead_", "stop_", "target_", "s_", "t_")


def excursions(bars: DataFrame, horizon: int) -> DataFrame:
    """Largest adverse and favourable move from each close over the next bars of the horizon, as far as there are any."""
    own = by_symbol().rowsBetween(1, horizon)
    return bars.withColumns({"mae": F.greatest(F.col("c") - F.min("l").over(own), F.lit(0.0)), "mfe": F.greatest(F.max("h").over(own) - F.col("c"), F.lit(0.0))})


def continuation(bars: DataFrame, upper: Column, lower: Column, horizon: int) -> DataFrame:
    """1 where a close beyond `upper` comes before one beyond `lower` within the horizon, 0 the other way, else null."""
    rows = _ahead(bars, horizon).withColumns({"hi_": upper, "lo_": lower})
    rows = rows.withColumns({"u_": _first(lambda x: x["c"] > F.col("hi_")), "d_": _first(lambda x: x["c"] < F.col("lo_"))})
    value = F.when(F.col("u_").isNotNull() & (F.col("d_").isNull() | (F.col("u_") < F.col("d_"))), 1).when(F.col("d_").isNotNull(), 0)
    return rows.withColumn("continues", value).drop("ahead_", "hi_", "lo_", "u_", "d_")


def wilson(wins: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Score interval of a rate, within 0 and 1; null without trials."""
    p, d = wins / n, 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def summarize(trades: DataFrame, by: list[str], result: str = "r", order: list[str] | None = None, target_r: float = 1.0, cost_r: float = 0.05, least: int = 100) -> DataFrame:
    """Per group: trades, wins, rate with interval, break-even rate, expectancy, profit factor, total, largest drawdown
    from 0 on, longest losing streak and a verdict. Drawdown and streak follow `order` (columns that order trades)."""
    lost = F.col(result) <= 0
    rows = running(trades, by, order or ["ts"], {"cum_": F.col(result), "lost_n_": lost.cast("int")})
    rows = running_peak(rows, by, "cum_", "peak_").withColumn("peak_", F.greatest(F.lit(0.0), "peak_"))
    streaks = rows.where(lost).groupBy(*by, F.col("n") - F.col("lost_n_")).count().groupBy(*by).agg(F.max("count").alias("longest_losing"))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum((F.col(result) > 0).cast("int")).alias("wins"),
        F.avg(result).alias("expectancy"),
        F.sum(result).alias("total"),
        F.sum(F.when(F.col(result) > 0, F.col(result))).alias("gained_"),
        F.sum(F.when(F.col(result) < 0, -F.col(result))).alias("lost_"),
        F.max(F.col("peak_") - F.col("cum_")).alias("max_drawdown"),
    )
    low, high = wilson(F.col("wins"), F.col("n"))
    even = (1 + cost_r) / (1 + target_r)
    out = out.join(streaks, by, "left").withColumns(
        {"win_rate": F.col("wins") / F.col("n"), "ci_low": low, "ci_high": high, "breakeven": F.lit(even), "profit_factor": F.col("gained_") / F.nullif("lost_", F.lit(0.0)), "longest_losing": F.coalesce("longest_losing", F.lit(0).cast("long"))}
    )
    verdict = F.when(F.col("n") < least, "insufficient data").when((F.col("ci_low") > even) & (F.col("expectancy") > 0), "edge").otherwise("no proven edge")
    return out.withColumn("verdict", verdict).drop("gained_", "lost_")


def equity_curve(trades: DataFrame, by: list[str], result: str = "r", order: list[str] | None = None, points: int = 200) -> DataFrame:
    """Cumulative result at every k-th trade, so that at most about `points` remain, and at the last."""
    rows = running(trades, by, order or ["ts"], {"equity": F.col(result)})
    step = F.ceil(F.col("of") / points)
    return rows.where(((F.col("n") - 1) % step == 0) | (F.col("n") == F.col("of"))).select(*by, "n", "equity")


def thin(rows: DataFrame, by: list[str], order: list[str], stride: int) -> DataFrame:
    """Every stride-th row of each group, from the first."""
    return running(rows, by, order).where((F.col("n") - 1) % stride == 0).select(*rows.columns)


def purged_split(rows: DataFrame, start: str, end: str, share: float) -> DataFrame:
    """Adds part: test for rows that start after the time cut (not the row cut) that leaves `share` of the span, train
    for earlier rows whose outcome is known by the cut, purged for the rest."""
    lo, hi = F.min(start), F.max(start)
    cut = rows.select((lo.cast("double") + (hi.cast("double") - lo.cast("double")) * (1 - share)).alias("cut_"))
    part = F.when(F.col(start).cast("double") > F.col("cut_"), "test").when(F.col(end).cast("double") <= F.col("cut_"), "train").otherwise("purged")
    return rows.join(F.broadcast(cut)).withColumn("part", part).drop("cut_")


def walk_forward(rows: DataFrame, order: list[str], by: list[str], folds: int, first_share: float, gap: int) -> DataFrame:
    """(.., fold, part): consecutive test blocks after the first share, each trained on all rows before it but the last
    `gap`; a row is in several folds' training parts."""
    own = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumns({"i_": F.row_number().over(own) - 1, "of_": F.count("*").over(Window.partitionBy(*by))})
    edge = lambda k: F.floor(F.col("of_") * first_share + (F.col("of_") - F.floor(F.col("of_") * first_share)) * k / folds)
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    a, b = edge(F.col("fold")), edge(F.col("fold") + 1)
    part = F.when((F.col("i_") >= a) & (F.col("i_") < b), "test").when(F.col("i_") < a - gap, "train")
    return rows.withColumn("part", part).where("part is not null").drop("i_", "of_")


def non_overlapping(signals: DataFrame, by: str, start: str, end: str, range_rows: int = 100_000) -> DataFrame:
    """Greedy choice by time: a signal is taken if the one taken before it has ended.

    Rows lie in ranges of (by, start, end); a task streams its range and keeps only the key and the end of the last one
    taken. What a range passes on to the next is found in rounds, until no range starts from another state than the round
    before: two or three rounds where signals end within a range, as many as there are ranges at worst."""
    import pickle

    import pyarrow as pa
    from pyspark import TaskContext

    order = [F.col(by), F.asc_nulls_last(start), F.asc_nulls_last(end), F.xxhash64(*signals.columns)]
    ranges = signals.count() // range_rows + 1  # long ranges: signals seldom reach over one
    rows = checkpointed(signals.repartitionByRange(ranges, *order).sortWithinPartitions(*order))

    def walk(batch: pa.RecordBatch, state: tuple | None) -> tuple[list[bool], tuple | None]:
        taken = []
        for k, a, b in zip(*(batch.column(c).to_pylist() for c in (by, start, end)), strict=True):
            if state is None or state[0] != k:
                state = (k, False, None)
            ok = not state[1] or a is not None and state[2] is not None and a >= state[2]
            taken.append(ok)
            state = (k, True, b) if ok else state
        return taken, state

    def last(came: dict[int, bytes], known: frozenset[int]):
        def run(batches):
            at = TaskContext.get().partitionId()
            if at in known:
                return
            state = pickle.loads(came[at]) if at in came else None
            for batch in batches:
                _, state = walk(batch, state)
            yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int32()), "state": pa.array([pickle.dumps(state)], pa.binary())})

        return run

    def chosen(came: dict[int, bytes]):
        def run(batches):
            at = TaskContext.get().partitionId()
            state = pickle.loads(came[at]) if at in came else None
            for batch in batches:
                taken, state = walk(batch, state)
                yield batch.filter(pa.array(taken, pa.bool_()))

        return run

    came: dict[int, bytes] = {}
    left: dict[int, bytes] = {}
    known: frozenset[int] = frozenset()
    while True:
        left |= {r["part"]: bytes(r["state"]) for r in rows.mapInArrow(last(came, known), "part int, state binary").collect()}
        now, carried = {}, None
        for part in range(max(left, default=-1) + 1):
            if carried is not None:
                now[part] = carried
            carried = left.get(part, carried)
        if now == came:
            return rows.mapInArrow(chosen(came), signals.schema)
        known = frozenset(part for part in left if now.get(part) == came.get(part))
        came = now
