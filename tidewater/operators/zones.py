"""Price zones: levels merge into zones that touches hold, break and wear out, in one ordered pass over bars and levels."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_symbol
from .ranges import RANGE_ROWS, WARM_ROWS, Machine, pass_over

#: Fixed values, in average ranges and bars.
IMPULSE_BODY, IMPULSE_OUTER = 1.5, 0.25
AWAY, PUSH, RESOLVE, FOLLOW, RETIRE, LOOK_BACK, LIFETIME = 1.0, 2.0, 16, 16, 4, 60, 200

#: What a zone is, in the order of its state.
ZONE = ("price", "tol", "known_i", "expires_i", "members", "frames", "holds", "through", "flips", "retest", "free", "touch")
PRICE, TOL, KNOWN, EXPIRES, MEMBERS, FRAMES, HOLDS, THROUGH, FLIPS, RETEST, FREE, TOUCH = range(len(ZONE))
#: An open touch: its bar, side, average range, depth, and what the zone was as it began.
BAR, SIDE, RANGE, DEPTH, PRIOR, FLIPPED, IS_RETEST, APPROACH, SEEN = range(9)


class ZoneMachine(Machine):
    """Bars (step 0) and levels (step 1, after the bar that confirms them) in order.

    A bar first settles open touches: a close beyond the zone breaks it, a move away by an average range holds it, RESOLVE
    bars without either stall. A bar that reaches a free zone opens a touch. A zone closed through RETIRE times is retired:
    no touch and no level counts for it any more. A level joins the nearest zone that lives then and lies within the
    larger tolerance, the lower one of two as near, and prolongs it; else it opens a zone. State: the zones alive, the last
    closes, and the directions of impulse candles among the last two bars."""

    out = (
        "what string, price double, tol double, known_i int, expires_i int, members int, frames int, holds int, through int, flips int, retired_i int, "
        "i int, resolved_i int, kind string, side int, depth double, prior_holds int, flipped boolean, is_retest boolean, approach string"
    )

    def __init__(self, lifetime: int = LIFETIME):
        self.lifetime = lifetime

    def start(self):
        return {"past": [], "pushes": [0, 0], "zones": []}

    @staticmethod
    def zone_row(z, retired) -> tuple:
        return ("zone", *z[:5], len(z[FRAMES]), z[HOLDS], z[THROUGH], z[FLIPS], retired, *[None] * 9)

    @staticmethod
    def touch_row(z, at, kind: str) -> tuple:
        x = z[TOUCH]
        return ("touch", z[PRICE], z[TOL], z[KNOWN], None, None, x[SEEN], None, None, None, None, x[BAR], at, kind, x[SIDE], x[DEPTH], x[PRIOR], x[FLIPPED], x[IS_RETEST], x[APPROACH])

    def run(self, state, rows, ahead):
        past, pushes, zones = state["past"], state["pushes"], state["zones"]
        out: list[tuple] = []
        for i, step, o, h, l, c, a, price, tol, frame in zip(*(rows[n].tolist() for n in ROWS), strict=True):
            if step:
                self.level(zones, int(i), price, tol, frame)
                continue
            gone = False
            for z in zones:
                if z[TOUCH] is None and not self.opens(z, past, pushes, i, h, l, a):
                    gone = gone or z[EXPIRES] < i
                    continue
                gone = self.settle(z, int(i), h, l, c, out) or gone
            if gone:
                zones[:] = [z for z in zones if not self.leaves(z, int(i), out)]
            past.append(c)
            del past[: max(0, len(past) - LOOK_BACK + 1)]
            big = abs(c - o) >= IMPULSE_BODY * a > 0
            push = 1 if big and c > o and c >= h - IMPULSE_OUTER * (h - l) else -1 if big and c < o and c <= l + IMPULSE_OUTER * (h - l) else 0
            pushes[:] = [push, pushes[0]]
        return state, out

    def level(self, zones: list, i: int, price: float, tol: float, frame: str) -> None:
        best = None
        for z in zones:
            off = abs(z[PRICE] - price)
            if z[EXPIRES] >= i and z[THROUGH] < RETIRE and off <= max(tol, z[TOL]):
                best = min(best, (off, z[PRICE], id(z), z)) if best else (off, z[PRICE], id(z), z)
        if best:
            z = best[3]
            z[MEMBERS] += 1
            z[EXPIRES] = max(z[EXPIRES], i + self.lifetime)
            z[FRAMES] = sorted({*z[FRAMES], frame})
        else:
            zones.append([price, tol, i, i + self.lifetime, 1, [frame], 0, 0, 0, False, 0, None])

    @staticmethod
    def opens(z, past, pushes, i, h, l, a) -> bool:
        if not (z[FREE] <= i < z[EXPIRES] and z[THROUGH] < RETIRE and l <= z[PRICE] + z[TOL] and h >= z[PRICE] - z[TOL] and a > 0):
            return False
        side = next((1 if x > z[PRICE] else -1 for x in reversed(past) if abs(x - z[PRICE]) > z[TOL]), 0)
        if side:
            # an impulse candle towards the zone in the two bars before, or a long way to it in three
            pushed = -side in pushes or len(past) >= 4 and side * (past[-4] - past[-1]) >= PUSH * a
            z[TOUCH] = [int(i), side, a, 0.0, z[HOLDS], z[FLIPS] > 0, z[RETEST], "impulse" if pushed else "drift", len(z[FRAMES])]
        return side != 0

    def settle(self, z, i: int, h, l, c, out: list) -> bool:
        """Whether the zone may leave after this bar of its touch."""
        x = z[TOUCH]
        side = x[SIDE]
        x[DEPTH] = max(x[DEPTH], side * (z[PRICE] - (l if side > 0 else h)))
        if side * (c - z[PRICE]) < -z[TOL]:
            out.append(self.touch_row(z, i, "retest_fail" if z[RETEST] else "break"))
            z[THROUGH], z[RETEST], z[FREE], z[TOUCH] = z[THROUGH] + 1, True, i + 1, None
        elif i > x[BAR] and side * ((h if side > 0 else l) - z[PRICE]) >= AWAY * x[RANGE]:
            out.append(self.touch_row(z, i, "retest_hold" if z[RETEST] else "sweep" if x[DEPTH] >= z[TOL] else "rejection"))
            z[FLIPS] += z[RETEST]
            z[HOLDS], z[RETEST], z[FREE], z[TOUCH] = z[HOLDS] + 1, False, i + 1, None
        elif i >= x[BAR] + RESOLVE:
            out.append(self.touch_row(z, None, "stall"))
            z[FREE], z[TOUCH] = i + 1, None
        return z[TOUCH] is None and (z[THROUGH] >= RETIRE or z[EXPIRES] < i)

    def leaves(self, z, i: int, out: list) -> bool:
        if z[TOUCH] is not None or z[THROUGH] < RETIRE and z[EXPIRES] >= i:
            return False
        out.append(self.zone_row(z, i if z[THROUGH] >= RETIRE else None))
        return True

    def rest(self, state) -> list[tuple]:
        """What is left as the data end: open touches and living zones."""
        return [r for z in state["zones"] for r in ([self.touch_row(z, None, "in_progress")] if z[TOUCH] else []) + [self.zone_row(z, None)]]


ROWS = ("i", "step", "o", "h", "l", "c", "a", "price", "tol", "frame")


def machine_rows(bars_with_atr: DataFrame, levels: DataFrame) -> DataFrame:
    """Bars (symbol, i, step 0, and as a the average range up to the bar before) and levels (symbol, price, tol, known_i;
    frame is the timeframe that formed it, if there is such a column) as the machine reads them."""
    own = by_symbol()
    none = F.lit(None)
    rows = bars_with_atr.withColumns({"i": F.row_number().over(own) - 1, "a": F.coalesce(F.lag("atr").over(own), F.lit(0.0))})
    bars = rows.select("symbol", "i", F.lit(0).alias("step"), "o", "h", "l", "c", "a", none.cast("double").alias("price"), none.cast("double").alias("tol"), none.cast("string").alias("frame"))
    frame = F.col("frame").cast("string") if "frame" in levels.columns else F.lit("")
    points = levels.select("symbol", F.col("known_i").cast("int").alias("i"), F.lit(1).alias("step"), *(none.cast("double").alias(n) for n in "ohlca"), F.col("price").cast("double").alias("price"), F.col("tol").cast("double").alias("tol"), frame.alias("frame"))
    return bars.unionByName(points.where("price is not null and tol is not null"))


def zone_history(bars_with_atr: DataFrame, levels: DataFrame, lifetime: int = LIFETIME, range_rows: int = RANGE_ROWS, warm_rows: int = WARM_ROWS) -> tuple[DataFrame, DataFrame]:
    """(zones, touches) of each symbol's levels (symbol, price, tol, known_i) and bars, by one pass of ZoneMachine over
    ranges of bars. A zone: zone (its number, in order of known_i and price), price, tol, members, frames, known_i,
    expires_i, retired_i (the bar whose close retired it), holds, through, flips. A touch: zone, i (its first bar),
    resolved_i, kind, side it comes from, depth beyond the price, prior_holds, flipped, is_retest, approach, frames, and
    follow: the farthest move in favour of what it came to within FOLLOW bars after it, null if no bar follows.

    Levels and bars that are null where they count never touch or join; repeated levels join their zone; no bars give no touches."""
    machine = ZoneMachine(lifetime)
    found, ends = pass_over(machine_rows(bars_with_atr, levels), machine, order=("i", "step", "price"), range_rows=range_rows, warm_rows=warm_rows)
    names = [x.split()[0] for x in machine.out.split(", ")]

    def rest(frames):
        for f in frames:
            rows = [(s, *r) for s, state in zip(f["symbol"], f["state"], strict=True) for r in machine.rest(json.loads(state))]
            yield pd.DataFrame(rows, columns=["symbol", *names], dtype=object)

    every = found.unionByName(ends.mapInPandas(rest, f"symbol string, {machine.out}"))
    zones = every.where("what = 'zone'").withColumn("zone", F.row_number().over(Window.partitionBy("symbol").orderBy("known_i", "price")) - 1)
    number = zones.select("symbol", "known_i", "price", "zone")
    own = by_symbol()
    after = own.rowsBetween(1, FOLLOW)
    moves = bars_with_atr.select("symbol", (F.row_number().over(own) - 1).alias("from_"), F.max("h").over(after).alias("top_"), F.min("l").over(after).alias("low_"))
    held = F.col("kind").isin("rejection", "sweep", "retest_hold")
    up = (F.col("side") > 0) == held
    touches = every.where("what = 'touch'").join(number, ["symbol", "known_i", "price"]).withColumn("from_", F.when(held, F.col("i")).when(F.col("kind").isin("break", "retest_fail"), F.col("resolved_i")))
    touches = touches.join(moves, ["symbol", "from_"], "left").withColumn("follow", F.when(up, F.col("top_") - F.col("price")).otherwise(F.col("price") - F.col("low_")))
    return (
        zones.select("symbol", "zone", "price", "tol", "members", "frames", "known_i", "expires_i", "retired_i", "holds", "through", "flips"),
        touches.select("symbol", "zone", "price", "i", "resolved_i", "kind", "side", "depth", "prior_holds", "flipped", "is_retest", "approach", "frames", "follow"),
    )


def zones(bars_with_atr: DataFrame, levels: DataFrame, lifetime: int = LIFETIME) -> DataFrame:
    return zone_history(bars_with_atr, levels, lifetime)[0]


def zone_reactions(bars_with_atr: DataFrame, levels: DataFrame, lifetime: int = LIFETIME) -> DataFrame:
    return zone_history(bars_with_atr, levels, lifetime)[1]


def lives(zones: DataFrame) -> DataFrame:
    """(symbol, price, born_i, dead_i): from when and before when a zone counts, its retirement counted."""
    dead = F.least("expires_i", F.col("retired_i") + 1)
    return zones.select("symbol", "price", F.col("known_i").alias("born_i"), dead.alias("dead_i"))
