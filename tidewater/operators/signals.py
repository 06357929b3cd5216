"""Signals and what came of them: structure and box events with their trades, retest entries, odds of box edges."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .indicators import by_symbol
from .outcomes import wilson
from .ranges import RANGE_ROWS, Joining, pass_over
from .structure import boxes, run_structure, swings_in_turn

#: Fixed values, in average ranges and bars.
BREAK_TOL, ZONE_WIDTH, ZONE_SHARE, SWEEP_REACH = 0.1, 0.25, 0.3, 0.25
HORIZON, FAKEOUT_BARS, RETEST_BARS, FAIL_BARS, SWEEP_BARS = 48, 3, 24, 3, 5
STOP_BUFFER, MOST_RISK = 0.2, 10.0


def _first(array: str, condition, least: int = 0) -> Column:
    """Place, from 0, of the first element from `least` on for which the condition holds; null if none."""
    places = F.filter(F.transform(array, lambda x, k: F.when(condition(x) & (k >= least), k)), lambda k: k.isNotNull())
    return F.try_element_at(places, F.lit(1))


def _before(a: Column, b: Column, ties: bool = False) -> Column:
    """1 where a comes before b (or with it), 0 where b comes and a doesn't before it, null where neither comes."""
    wins = a.isNotNull() & (b.isNull() | ((a <= b) if ties else (a < b)))
    return F.when(wins, 1).when(b.isNotNull(), 0)


# ---- structure signals ---------------------------------------------------------------------------------------------
def structure_signals(bars: DataFrame) -> DataFrame:
    """(symbol, i, dir, types, level, box): breaks of structure, closes out of a box that held until then, and closes back
    into one within FAIL_BARS of leaving it; what fires on one bar in one direction is one signal with all its types in
    order, the first one's level and the first box there is."""
    box = "struct<low:double,high:double,inside:int>"
    breaks = run_structure(bars).where("event in ('bos_up', 'bos_down')")
    found = breaks.select("symbol", "i", F.when(F.col("event") == "bos_up", 1).otherwise(-1).alias("dir"), F.col("event").alias("type"), "level", F.lit(None).cast(box).alias("box"))
    own = by_symbol()
    rows = boxes(bars).select("symbol", "ts", "i", "c", F.when(F.col("mother").isNotNull(), F.struct(F.col("box_low").alias("low"), F.col("box_high").alias("high"), F.col("inside").cast("int").alias("inside"))).alias("b0"))
    rows = rows.withColumns({f"b{k}": F.lag("b0", k).over(own) for k in (1, 2, 3)} | {f"c{k}": F.lag("c", k).over(own) for k in (1, 2)})
    c, b1 = F.col("c"), F.col("b1")
    out = rows.where((F.col("i") >= 2) & ((c > b1["high"]) | (c < b1["low"])))
    up = c > b1["high"]
    found = found.unionByName(out.select("symbol", "i", F.when(up, 1).otherwise(-1).alias("dir"), F.when(up, "box_breakout_up").otherwise("box_breakout_down").alias("type"), F.when(up, b1["high"]).otherwise(b1["low"]).alias("level"), b1.cast(box).alias("box")))
    within = lambda x, b: (x >= b["low"]) & (x <= b["high"])
    b2, b3 = F.col("b2"), F.col("b3")
    two = b2.isNotNull() & within(c, b2) & (F.col("i") >= 3)
    three = b2.isNull() & b3.isNotNull() & within(c, b3) & ~within(F.col("c1"), b3) & (F.col("i") >= 4)
    failed = rows.where(F.col("b0").isNull() & b1.isNull() & (two | three))
    failed = failed.withColumns({"box": F.coalesce(b2, b3).cast(box), "left": F.when(b2.isNotNull(), F.col("c1")).otherwise(F.col("c2"))})
    high = F.col("left") > F.col("box.high")
    found = found.unionByName(failed.select("symbol", "i", F.when(high, -1).otherwise(1).alias("dir"), F.lit("failed_breakout").alias("type"), F.when(high, F.col("box.high")).otherwise(F.col("box.low")).alias("level"), "box"))
    merged = found.groupBy("symbol", "i", "dir").agg(F.array_sort(F.collect_list(F.struct("type", "level", "box"))).alias("all"))
    first_box = F.try_element_at(F.filter(F.col("all.box"), lambda b: b.isNotNull()), F.lit(1))
    return merged.select("symbol", "i", "dir", F.col("all.type").alias("types"), F.element_at("all.level", 1).alias("level"), first_box.alias("box"))


class ProtectedMachine(Joining):
    """Swings (step 0) and signals (step 1). State: of the swings seen those that no later one of their kind lies beyond,
    lows from old to new in ascending order, and highs with their sign changed."""

    out = "i int, dir int, entry double, protected double"

    def start(self):
        return {"L": [], "H": []}

    def join(self, before, own):
        return {k: [x for x in before[k] if not own[k] or x < own[k][0]] + own[k] for k in "LH"}

    def run(self, state, rows, ahead):
        out = []
        for i, step, kind, level, d, entry in zip(*(rows[n].tolist() for n in ("i", "step", "kind", "level", "dir", "entry")), strict=True):
            if step:
                stack = state["L" if d > 0 else "H"]
                at = bisect.bisect_left(stack, d * entry)
                if at:
                    out.append((int(i), int(d), entry, d * stack[at - 1]))
                continue
            x, stack = level if kind == "L" else -level, state[kind]
            del stack[bisect.bisect_left(stack, x) :]
            stack.append(x)
        return state, out


def protected_swings(signals: DataFrame, bars: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Signals (symbol, i, dir, entry) with the price of the last swing known by then that lies against them: a low below
    a long entry, a high above a short one. Signals without one go. A pass over ranges of a symbol's bars."""
    none = F.lit(None)
    key = ["symbol", "i", "dir", "entry"]
    swings = swings_in_turn(bars).select("symbol", F.col("known_i").cast("int").alias("i"), F.lit(0).alias("step"), "level_i", "kind", "level", none.cast("int").alias("dir"), none.cast("double").alias("entry"))
    asked = signals.select("symbol", F.col("i").cast("int").alias("i"), F.lit(1).alias("step"), none.cast("int").alias("level_i"), none.cast("string").alias("kind"), none.cast("double").alias("level"), F.col("dir").cast("int").alias("dir"), F.col("entry").cast("double").alias("entry"))
    found, _ = pass_over(swings.unionByName(asked.distinct()), ProtectedMachine(), order=("i", "step", "level_i", "kind"), range_rows=range_rows)
    return signals.join(found, key)


def structure_trades(bars_with_atr: DataFrame, horizon: int = 24, target_r: float = 1.0, cost_r: float = 0.05) -> DataFrame:
    """One trade for each structure signal: entry at the close, stop beyond the protected swing, target at target_r times
    the risk; loss (a tie is one), win or timeout within the horizon, r and r_net. Open trades, and those with a risk of 0
    or over MOST_RISK average ranges, go."""
    own = by_symbol()
    rows = bars_with_atr.withColumns({"i": F.row_number().over(own) - 1, "ahead": F.collect_list(F.struct("h", "l", "c")).over(own.rowsBetween(1, horizon))})
    signals = checkpointed(structure_signals(bars_with_atr)).select("symbol", "i", "dir", "types", "box").join(rows.select("symbol", "i", "ts", F.col("c").alias("entry"), "atr", "ahead").where("atr > 0"), ["symbol", "i"])
    plan = signals.select("symbol", "i", "dir", "entry", "atr")
    d = F.col("dir")
    stop = F.col("protected") - d * STOP_BUFFER * F.col("atr")
    plan = protected_swings(plan, bars_with_atr).withColumn("stop", stop).withColumn("risk", (F.col("entry") - F.col("stop")) * d)
    plan = plan.where((F.col("risk") > 0) & (F.col("risk") <= MOST_RISK * F.col("atr"))).select("symbol", "i", "dir", "stop", "risk")
    trades = signals.join(plan, ["symbol", "i", "dir"])
    against, along = lambda x: F.when(d > 0, x["l"]).otherwise(-x["h"]), lambda x: F.when(d > 0, x["h"]).otherwise(-x["l"])
    target = d * F.col("entry") + target_r * F.col("risk")
    trades = trades.withColumns({"s": _first("ahead", lambda x: against(x) <= d * F.col("stop")), "t": _first("ahead", lambda x: along(x) >= target)})
    whole = F.size("ahead") == horizon
    lost, won = F.col("s").isNotNull() & (F.col("t").isNull() | (F.col("s") <= F.col("t"))), F.col("t").isNotNull()
    out = trades.withColumns(
        {
            "outcome": F.when(lost, "loss").when(won, "win").when(whole, "timeout"),
            "r": F.when(lost, -1.0).when(won, target_r).when(whole, (F.element_at("ahead", -1)["c"] - F.col("entry")) * d / F.col("risk")),
            "bars_held": F.when(lost, F.col("s") + 1).when(won, F.col("t") + 1).when(whole, F.lit(horizon)),
            "box_width_atr": (F.col("box.high") - F.col("box.low")) / F.col("atr"),
        }
    )
    return out.where("outcome is not null").withColumn("r_net", F.col("r") - cost_r).select("symbol", "ts", "i", "dir", "types", "entry", "stop", "risk", "outcome", "r", "r_net", "bars_held", "box_width_atr")


def width_bucket(width: Column) -> Column:
    """Box width in average ranges, as a label."""
    return F.when(width.isNull(), "no box").when(width < 0.5, "<0.5 ATR").when(width < 1, "0.5-1 ATR").when(width < 2, "1-2 ATR").otherwise(">=2 ATR")


def sweep_counts(bars: DataFrame, back: int = SWEEP_BARS) -> DataFrame:
    """For each bar how many sweeps of highs and of lows it and the `back` bars before it hold."""
    hits = run_structure(bars).where("event in ('sweep_high', 'sweep_low')").groupBy("symbol", "ts").agg(*(F.sum((F.col("event") == e).cast("int")).alias(e) for e in ("sweep_high", "sweep_low")))
    near = by_symbol().rowsBetween(-back, 0)
    rows = bars.select("symbol", "ts").join(hits, ["symbol", "ts"], "left")
    return rows.select("symbol", "ts", *(F.coalesce(F.sum(e).over(near), F.lit(0)).alias(e) for e in ("sweep_high", "sweep_low")))


# ---- retest trades -------------------------------------------------------------------------------------------------
def _retest_entries(bars: DataFrame, retests: DataFrame, horizon: int) -> DataFrame:
    """One row for each way to trade a retest, with its entry and the bars from it on."""
    own = by_symbol()
    rows = bars.withColumns({"i": F.row_number().over(own) - 1, "path": F.collect_list(F.struct("h", "l", "c")).over(own.rowsBetween(0, horizon - 1)), "before": F.lag("c").over(own)})
    way = lambda kind, ok, start, entry, skip: F.when(ok, F.struct(F.lit(kind).alias("entry_kind"), start.cast("int").alias("start_i"), F.lit(entry).alias("at"), F.lit(skip).alias("skip")))
    after = F.col("touch_i") + 1
    ways = F.array_compact(F.array(way("touch", F.col("fill_i").isNotNull(), F.col("fill_i"), "level", 1), *(way(k, F.col("rejected"), after, e, 0) for k, e in (("reject_close", "before"), ("next_open", "open")))))
    trades = retests.where("touch_i is not null").withColumn("w", F.explode(ways)).select("symbol", "level_id", "dir", "price", "touch_i", "w.*")
    once = Window.partitionBy("symbol", "entry_kind", "start_i", "dir").orderBy("touch_i", "level_id")
    trades = trades.withColumn("n", F.row_number().over(once)).where("n = 1").join(rows.select("symbol", F.col("i").alias("start_i"), "o", "before", "path"), ["symbol", "start_i"])
    entry = F.when(F.col("at") == "level", F.col("price")).when(F.col("at") == "before", F.col("before")).otherwise(F.col("o"))
    return trades.withColumn("entry", entry)


def _retest_outcomes(trades: DataFrame, stop: Column, target: Column, spread: float, horizon: int) -> DataFrame:
    d = F.col("dir")
    against, along = lambda x: F.when(d > 0, x["l"]).otherwise(-x["h"]), lambda x: F.when(d > 0, x["h"]).otherwise(-x["l"])
    hit = F.filter(F.transform("path", lambda x, k: F.when((along(x) >= d * F.col("entry") + target) & (k >= F.col("skip")), k)), lambda k: k.isNotNull())
    trades = trades.withColumns({"s": _first("path", lambda x: against(x) <= d * F.col("entry") - stop), "t": F.try_element_at(hit, F.lit(1))})
    lost, won, whole = F.col("s").isNotNull() & (F.col("t").isNull() | (F.col("s") <= F.col("t"))), F.col("t").isNotNull(), F.size("path") == horizon
    outcome = F.when(lost, "loss").when(won, "win").when(whole, "timeout")
    move = F.when(lost, -stop).when(won, target).when(whole, (F.element_at("path", -1)["c"] - F.col("entry")) * d)
    return trades.withColumns({"outcome": outcome, "move": move - spread}).where("outcome is not null")


def retest_trades(bars: DataFrame, retests: DataFrame, stop: float, target: float, spread: float, horizon: int) -> DataFrame:
    """(symbol, entry_kind, start_i, dir, entry, outcome, move) of three ways to trade a retest (symbol, level_id, dir,
    price, touch_i, fill_i, rejected): `touch` at the level itself, whose target doesn't count on that bar;
    `reject_close` at the close of a rejecting touch and `next_open` after it. One trade for each kind, bar and
    direction, that of the earliest touch; open ones go. move is net of the spread."""
    trades = _retest_outcomes(_retest_entries(bars, retests, horizon), F.lit(stop), F.lit(target), spread, horizon)
    return trades.select("symbol", "entry_kind", "start_i", "dir", "entry", "outcome", "move")


def retest_grid(bars: DataFrame, retests: DataFrame, stops: list[float], targets: list[float], spread: float, horizon: int) -> DataFrame:
    """The same trades under each pair of stop and target, in those columns: entries and their bars are found once, and
    the grid is laid over them."""
    cells = [F.struct(F.lit(a).alias("stop"), F.lit(b).alias("target")) for a in stops for b in targets]
    trades = _retest_entries(bars, retests, horizon).withColumn("cell_", F.explode(F.array(*cells))).withColumns({"stop": F.col("cell_.stop"), "target": F.col("cell_.target")})
    return _retest_outcomes(trades, F.col("stop"), F.col("target"), spread, horizon).select("symbol", "entry_kind", "start_i", "dir", "stop", "target", "entry", "outcome", "move")


def summarize_moves(trades: DataFrame, by: list[str], stop: float, target: float, spread: float, fewest: int = 100) -> DataFrame:
    """Per group of trades (outcome, move in price): counts, rate with interval, break-even rate, mean move, its share of
    the stop, profit factor and verdict."""
    out = trades.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.sum((F.col("outcome") == o).cast("int")).alias(k) for o, k in (("win", "wins"), ("loss", "losses"), ("timeout", "timeouts"))), F.avg("move").alias("expectancy"), F.sum("move").alias("total"),
        F.sum(F.when(F.col("move") > 0, F.col("move"))).alias("gained_"), F.sum(F.when(F.col("move") < 0, -F.col("move"))).alias("lost_"),
    )
    low, high = wilson(F.col("wins"), F.col("n"))
    even = min(1.0, (stop + spread) / (stop + target))
    verdict = F.when(F.col("n") < fewest, "insufficient data").when((low > even) & (F.col("expectancy") > 0), "edge").otherwise("no proven edge")
    return out.withColumns({"win_rate": F.col("wins") / F.col("n"), "ci_low": low, "ci_high": high, "breakeven": F.lit(even), "expectancy_r": F.col("expectancy") / stop, "profit_factor": F.col("gained_") / F.nullif("lost_", F.lit(0.0)), "verdict": verdict}).drop("gained_", "lost_")


def best_cell(cells: DataFrame, by: list[str], fewest: int = 50) -> DataFrame:
    """Of each group's grid cells (stop, target, n, expectancy) with enough trades the one that earns most, ties to the
    smaller stop, then target."""
    ok = cells.where((F.col("n") >= fewest) & F.col("expectancy").isNotNull())
    return ok.groupBy(*by).agg(F.max_by(F.struct("stop", "target", "n", "expectancy"), F.struct("expectancy", -F.col("stop"), -F.col("target"))).alias("best")).select(*by, "best.*")


# ---- box odds ------------------------------------------------------------------------------------------------------
def box_events(states: DataFrame, bars_with_atr: DataFrame, target: float, horizon: int = HORIZON) -> DataFrame:
    """(symbol, i, side, kind, outcome 1 or 0) of what happens at the edges of the box known a bar before: closes outside
    and whether they run on by `target` or an average range before closing back; sweeps that close back and whether they
    reach the middle or the other edge before a close beyond the wick; first arrivals in an edge's zone and whether they
    reach the middle before a close beyond. What isn't decided within the horizon gives no row."""
    own = by_symbol()
    rows = bars_with_atr.join(states.select("symbol", "ts", "i", "top", "bottom", "status"), ["symbol", "ts"])
    rows = rows.withColumns({"past": F.lag(F.struct("top", "bottom", "status", "atr", "h", "l")).over(own), "ahead": F.collect_list(F.struct("h", "l", "c")).over(own.rowsBetween(1, horizon))})
    rows = rows.where("i >= 2 and past.status = 'inside' and past.atr > 0").withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    d = F.col("side")
    far, back = lambda x: F.when(d > 0, x["h"]).otherwise(-x["l"]), lambda x: F.when(d > 0, x["l"]).otherwise(-x["h"])
    a = F.col("past.atr")
    height = F.col("past.top") - F.col("past.bottom")
    # all turned so that the edge is above: prices times the side
    rows = rows.withColumns({"edge": F.when(d > 0, F.col("past.top")).otherwise(-F.col("past.bottom")), "opp": F.when(d > 0, F.col("past.bottom")).otherwise(-F.col("past.top")), "mid": d * (F.col("past.top") + F.col("past.bottom")) / 2, "tol": BREAK_TOL * a, "width": F.least(ZONE_WIDTH * a, ZONE_SHARE * height), "close": d * F.col("c"), "reach": F.when(d > 0, F.col("h")).otherwise(-F.col("l")), "was": far(F.col("past")) >= F.when(d > 0, F.col("past.top")).otherwise(-F.col("past.bottom")) - F.least(ZONE_WIDTH * a, ZONE_SHARE * height)})
    edge, tol, close, reach = F.col("edge"), F.col("tol"), F.col("close"), F.col("reach")
    beyond = close - edge > tol
    closed_back = _first("ahead", lambda x: d * x["c"] - edge <= 0)
    to_mid, to_opp = _first("ahead", lambda x: back(x) - F.col("mid") <= 0), _first("ahead", lambda x: back(x) - F.col("opp") <= 0)
    over_wick, over_edge = _first("ahead", lambda x: d * x["c"] - reach > 0), _first("ahead", lambda x: d * x["c"] - edge > tol)
    swept = ~beyond & (reach - edge > tol)
    arrives = ~beyond & (reach >= edge - F.col("width")) & ~F.col("was")
    one = lambda kind, ok, value: F.when(ok, F.struct(F.lit(kind).alias("kind"), value.alias("outcome")))
    found = F.array_compact(
        F.array(
            one("break_continues_target", beyond, _before(_first("ahead", lambda x: far(x) >= close + target), closed_back, ties=True)),
            one("break_continues_1atr", beyond, _before(_first("ahead", lambda x: far(x) >= close + a), closed_back, ties=True)),
            one("sweep_to_mid", swept, _before(to_mid, over_wick)),
            one("sweep_to_opposite_edge", swept, _before(to_opp, over_wick)),
            one("edge_fade_to_mid", arrives, _before(to_mid, over_edge)),
        )
    )
    return rows.select("symbol", "i", "side", F.explode(found).alias("e")).select("symbol", "i", "side", "e.*").where("outcome is not null")


def fakeouts(breaks: DataFrame, bars_with_atr: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Breaks with what came of them: fakeout (closed back within FAKEOUT_BARS; null while that isn't known), and for
    fakeouts, within the horizon after the close back and until a close beyond either side, whether price reached the
    middle and the opposite edge and which side broke; complete tells whether the horizon lies in the data. For real
    breaks: whether the edge was touched again within RETEST_BARS, and how far beyond at most."""
    own = by_symbol()
    numbered = bars_with_atr.withColumns({"i": F.row_number().over(own) - 1, "n": F.count("*").over(Window.partitionBy("symbol"))})
    here = numbered.withColumn("after", F.collect_list(F.struct("h", "l")).over(own.rowsBetween(1, RETEST_BARS))).select("symbol", "i", "n", F.col("atr").alias("unit"), "after")
    there = numbered.withColumn("path", F.collect_list(F.struct("h", "l", "c")).over(own.rowsBetween(0, horizon))).select("symbol", F.col("i").alias("back_i"), F.col("atr").alias("back_unit"), "path")
    rows = breaks.join(here, ["symbol", "i"]).join(there, ["symbol", "back_i"], "left")
    d = F.col("side")
    wait = F.col("back_i") - F.col("i")
    fake = F.when(F.col("i") + FAKEOUT_BARS < F.col("n"), F.coalesce(wait <= FAKEOUT_BARS, F.lit(False)))
    # turned so that the broken edge is above
    edge, opp, mid = d * F.col("edge"), F.when(d > 0, F.col("bottom")).otherwise(-F.col("top")), d * (F.col("top") + F.col("bottom")) / 2
    back = lambda x: F.when(d > 0, x["l"]).otherwise(-x["h"])
    tol = BREAK_TOL * F.coalesce("back_unit", F.lit(0.0))
    rows = rows.withColumns({"fakeout": fake, "other_": _first("path", lambda x: d * x["c"] - opp < -tol), "same_": _first("path", lambda x: d * x["c"] - edge > tol, 1)})
    rows = rows.withColumn("last_", F.coalesce(F.least("other_", "same_"), F.lit(horizon)))
    by_then = lambda level: F.coalesce(_first("path", lambda x: back(x) - level <= 0) <= F.col("last_"), F.lit(False))
    is_fake = F.coalesce(F.col("fakeout"), F.lit(False))
    broke = lambda a, b, ties: F.coalesce(_before(F.col(a), F.col(b), ties) == 1, F.lit(False))
    near = BREAK_TOL * F.coalesce("unit", F.lit(0.0))
    bars_left = F.least(F.coalesce(wait - 1, F.lit(RETEST_BARS)), F.lit(RETEST_BARS))
    depths = F.filter(F.transform(F.slice("after", 1, bars_left), lambda x: F.when(back(x) - edge <= near, F.greatest(edge - back(x), F.lit(0.0)))), lambda x: x.isNotNull())
    real = ~F.col("fakeout") & (F.col("i") + RETEST_BARS < F.col("n"))
    return rows.withColumns(
        {
            "reached_mid": F.when(is_fake, by_then(mid)), "reached_opposite_edge": F.when(is_fake, by_then(opp)),
            "broke_opposite_side": F.when(is_fake, broke("other_", "same_", True)), "broke_same_side": F.when(is_fake, broke("same_", "other_", False)),
            "complete": F.when(is_fake, F.col("back_i") + horizon < F.col("n")),
            "retested": F.when(real, F.size(depths) > 0), "retest_depth": F.when(real, F.array_max(depths)),
        }
    ).drop("n", "unit", "after", "back_unit", "path", "other_", "same_", "last_")


def break_events(followed: DataFrame) -> DataFrame:
    """(symbol, i, kind, outcome) of breaks with what came of them: whether they were fakeouts, in all and by the impulse
    before, attempt and body; what fakeouts led to where that is decided; whether real ones came back to the edge."""
    flag = lambda c: c.cast("int")
    fake = flag(F.col("fakeout"))
    lead = F.when(F.col("lead") == 0, "no_impulse").when(F.col("lead") == F.col("side"), "with_impulse").otherwise("against_impulse")
    body = F.when(F.col("body_atr").isNotNull(), F.when(F.col("body_atr") >= 1, ">=1 ATR").otherwise("<1 ATR"))
    one = lambda kind, value: F.struct(kind.alias("kind"), value.alias("outcome"))
    split = lambda name, value: F.concat(F.lit(f"break_is_fakeout|{name}="), value)
    decided = lambda c: F.when(F.col("complete") | F.col(c), flag(F.col(c)))
    found = F.array(
        one(F.lit("break_is_fakeout"), fake), one(split("lead_in", lead), fake), one(split("attempt", F.when(F.col("attempt") == 1, "first").otherwise("later")), fake), one(split("body", body), fake),
        one(F.lit("fakeout_reaches_opposite_edge"), decided("reached_opposite_edge")), one(F.lit("fakeout_then_breaks_opposite_side"), decided("broke_opposite_side")), one(F.lit("real_break_retests_edge"), flag(F.col("retested"))),
    )
    return followed.select("symbol", "i", F.explode(found).alias("e")).select("symbol", "i", "e.*").where("kind is not null and outcome is not null")


def odds(events: DataFrame) -> DataFrame:
    """(kind, n, wins, rate, ci_low, ci_high) of events (kind, outcome)."""
    out = events.groupBy("kind").agg(F.count("*").alias("n"), F.sum("outcome").alias("wins"))
    low, high = wilson(F.col("wins"), F.col("n"))
    return out.withColumns({"rate": F.col("wins") / F.col("n"), "ci_low": low, "ci_high": high})


def box_sweeps(states: DataFrame, bars_with_atr: DataFrame, most: int = 6) -> DataFrame:
    """Of each symbol's last box the wicks beyond its edges that closed back inside, the `most` largest, in order of time:
    (symbol, ts, side, level, beyond)."""
    own = by_symbol()
    last = states.groupBy("symbol").agg(F.max_by(F.struct("top", "bottom", "start_i"), "i").alias("box")).where("box.top is not null").select("symbol", "box.*")
    rows = bars_with_atr.withColumns({"i": F.row_number().over(own) - 1, "unit": F.coalesce(F.lag("atr").over(own), "atr")}).join(F.broadcast(last), "symbol").where("i >= start_i")
    tol, least = BREAK_TOL * F.col("unit"), SWEEP_REACH * F.col("unit")
    high, low = F.col("h") - F.col("top"), F.col("bottom") - F.col("l")
    side = lambda ok, name, level, beyond: F.when(ok, F.struct(F.lit(name).alias("side"), F.col(level).alias("level"), beyond.alias("beyond")))
    found = F.array_compact(F.array(side((high >= least) & (F.col("c") <= F.col("top") + tol), "high", "top", high), side((low >= least) & (F.col("c") >= F.col("bottom") - tol), "low", "bottom", low)))
    rows = rows.select("symbol", "ts", F.explode(found).alias("s")).select("symbol", "ts", "s.*")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("beyond"), "ts", "side"))
    return rows.withColumn("n_", rank).where(F.col("n_") <= most).drop("n_")
