"""Market structure: alternating swings with breaks and sweeps, boxes, candlestick patterns, zones and retests."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import body_swings, by_symbol
from .ranges import RANGE_ROWS, WARM_ROWS, Joining, Machine, pass_over

def swings_in_turn(bars: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """Body swings in alternation as they were confirmed: symbol, kind (H or L), level_i, level, label, known_i.

    A swing of the last kind counts only if it is more extreme than those of its kind since the kind changed; its label
    compares it with the extreme of the run of its kind before. All by window frames over the confirmed swings alone."""
    rows = body_swings(bars, left, right)
    part = lambda flag, price, kind: rows.where(flag).select("symbol", F.lit(kind).alias("kind"), F.col("i").alias("level_i"), F.col(price).alias("level"), F.col("confirmed").alias("known_i"))
    raw = part("body_high", "top", "H").unionByName(part("body_low", "bottom", "L"))
    turn = Window.partitionBy("symbol").orderBy("level_i", "kind")
    sign = F.when(F.col("kind") == "H", 1.0).otherwise(-1.0)
    raw = raw.withColumns({"new_": F.coalesce((F.lag("kind").over(turn) != F.col("kind")).cast("int"), F.lit(1)), "reach_": sign * F.col("level")})
    raw = raw.withColumn("run_", F.sum("new_").over(turn))
    own = Window.partitionBy("symbol", "run_")
    before = F.max("reach_").over(own.orderBy("level_i").rowsBetween(Window.unboundedPreceding, -1))
    raw = raw.withColumns({"best_": before, "last_": F.max("reach_").over(own)})
    earlier = Window.partitionBy("symbol", "kind").orderBy("run_").rangeBetween(Window.unboundedPreceding, -1)
    raw = raw.withColumn("was_", sign * F.last("last_").over(earlier)).where("best_ is null or reach_ > best_")
    word = F.when(F.col("level") > F.col("was_"), "H").when(F.col("level") < F.col("was_"), "L").when(F.col("was_").isNotNull(), "EQ")
    return raw.select("symbol", "kind", "level_i", "level", F.concat(word, "kind").alias("label"), "known_i")


def run_structure(bars: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """One row for each swing as it is confirmed (kind H or L), each break or sweep (event) and each bar's trend.

    A bar sees the swings confirmed before it as levels: a close beyond breaks one for good, a wick alone sweeps it until
    then. Its trend counts those that it confirms itself, so no row depends on later bars. Window frames over bars and
    swings together; nothing leaves the engine."""
    numbered = bars.withColumn("i", F.row_number().over(by_symbol()) - 1).select("symbol", "ts", "i", "h", "l", "c")
    swings = swings_in_turn(bars, left, right)
    known = F.struct("level", "level_i", "label")
    side = lambda k: F.when(F.col("kind") == k, known).alias(f"at_{k}")
    none = F.lit(None).cast("struct<level:double,level_i:int,label:string>")
    empty = F.lit(None)
    # at one bar: its own row, then the swings it confirms, then its trend
    both = numbered.select("symbol", "i", F.explode(F.array(F.lit(0), F.lit(2))).alias("step"), "ts", "h", "l", "c", none.alias("at_H"), none.alias("at_L")).unionByName(
        swings.select("symbol", F.col("known_i").alias("i"), F.lit(1).alias("step"), empty.cast("timestamp").alias("ts"), *(empty.cast("double").alias(x) for x in "hlc"), side("H"), side("L"))
    )
    so_far = Window.partitionBy("symbol").orderBy("i", "step").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumns({k: F.last(k, ignorenulls=True).over(so_far) for k in ("at_H", "at_L")}).where("step <> 1")
    label = lambda k: F.col(f"at_{k}.label")
    trend = F.when((label("H") == "HH") & (label("L") == "HL"), "up").when((label("H") == "LH") & (label("L") == "LL"), "down").otherwise("range")
    columns = ["symbol", "ts", "i", "kind", "event", "level", "level_i", "label", "trend"]
    text = empty.cast("string")
    trends = rows.where("step = 2").select("symbol", "ts", "i", text.alias("kind"), text.alias("event"), empty.cast("double").alias("level"), empty.cast("int").alias("level_i"), text.alias("label"), trend.alias("trend"))
    tested = rows.where("step = 0").select("symbol", "ts", "i", "c", F.explode(F.array(
        F.struct(F.lit("H").alias("side"), F.col("at_H").alias("at"), F.col("h").alias("reach"), F.lit(1).alias("d")),
        F.struct(F.lit("L").alias("side"), F.col("at_L").alias("at"), F.col("l").alias("reach"), F.lit(-1).alias("d")),
    )).alias("x")).select("symbol", "ts", "i", "c", "x.*").where("at is not null")
    tested = tested.withColumn("closed", F.col("d") * (F.col("c") - F.col("at.level")) > 0)
    earlier = Window.partitionBy("symbol", "side", "at.level_i").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    tested = tested.withColumn("open", ~F.coalesce(F.max("closed").over(earlier), F.lit(False)))
    event = F.when(F.col("closed"), F.when(F.col("d") > 0, "bos_up").otherwise("bos_down")).when(F.col("d") * (F.col("reach") - F.col("at.level")) > 0, F.when(F.col("d") > 0, "sweep_high").otherwise("sweep_low"))
    events = tested.where("open").select("symbol", "ts", "i", text.alias("kind"), event.alias("event"), F.col("at.level").alias("level"), F.col("at.level_i").alias("level_i"), F.col("at.label").alias("label"), text.alias("trend")).where("event is not null")
    at = numbered.select("symbol", "i", "ts")
    confirmed = swings.withColumn("i", F.col("known_i")).join(at, ["symbol", "i"]).select("symbol", "ts", "i", "kind", text.alias("event"), "level", "level_i", "label", text.alias("trend"))
    return confirmed.unionByName(events).unionByName(trends).select(*columns)


def boxes(bars: DataFrame, least_inside: int = 2, most_back: int = 30) -> DataFrame:
    """For each bar the earliest of the `most_back` bars before it whose body holds every close since: mother (its
    number), low, high and inside (closes held); null where there is none."""
    rows = bars.withColumns({"i": F.row_number().over(by_symbol()) - 1, "top": F.greatest("o", "c"), "bottom": F.least("o", "c")})
    back = by_symbol().rowsBetween(-most_back, -1)
    rows = rows.withColumns({"past_": F.collect_list(F.struct("i", "top", "bottom", "c")).over(back)})
    # the closes from the bar after a candidate to this one: its later neighbours in the array, and this bar's own
    n = F.size("past_")
    inside = lambda x, k: (F.col("c") >= x["bottom"]) & (F.col("c") <= x["top"]) & F.forall(F.slice("past_", k + 2, n), lambda y: (y["c"] >= x["bottom"]) & (y["c"] <= x["top"]))
    fits = F.filter("past_", lambda x, k: (F.col("i") - x["i"] >= least_inside) & inside(x, k))
    rows = rows.withColumn("mother_", F.try_element_at(fits, F.lit(1)))
    return rows.withColumns({"mother": F.col("mother_.i"), "box_low": F.col("mother_.bottom"), "box_high": F.col("mother_.top"), "inside": F.col("i") - F.col("mother_.i")}).drop("past_", "mother_", "top", "bottom")


def candlesticks(bars_with_atr: DataFrame) -> DataFrame:
    """Signed flags (1 bullish, -1 bearish, 0 none) of two- and three-bar patterns, in units of the last bar's average
    range; null inputs give 0."""
    lag = lambda x, k=1: F.lag(x, k).over(by_symbol())
    rows = bars_with_atr.withColumns({"a": F.when(lag("atr") > 0, lag("atr")), "body_": F.col("c") - F.col("o"), "range_": F.col("h") - F.col("l"), "i_": F.row_number().over(by_symbol())})
    rows = rows.withColumns({"b1": lag("body_"), "b2": lag("body_", 2), "o1": lag("o"), "c1": lag("c"), "h1": lag("h"), "l1": lag("l"), "o2": lag("o", 2), "c2": lag("c", 2), "h2": lag("h", 2), "l2": lag("l", 2)})
    o, h, l, c, a, b, b1, b2 = (F.col(k) for k in ("o", "h", "l", "c", "a", "body_", "b1", "b2"))
    o1, c1, h1, l1, o2, c2 = (F.col(k) for k in ("o1", "c1", "h1", "l1", "o2", "c2"))
    spread = F.col("range_")
    sign = lambda up, down: F.when(F.coalesce(up, F.lit(False)), 1).when(F.coalesce(down, F.lit(False)), -1).otherwise(0)
    two = lambda d: (d * b > 0) & (d * b1 < 0)
    engulf = lambda d: two(d) & (d * (c1 - o) >= 0) & (d * (c - o1) >= 0) & (F.abs(b) >= 0.3 * a) & (F.abs(b) > F.abs(b1))
    big = spread >= 0.75 * a
    hammer = big & (F.least(o, c) - l >= spread * 2 / 3)
    shooting = big & (h - F.greatest(o, c) >= spread * 2 / 3)
    held = (h <= h1) & (l >= l1) & (spread > 0)
    rows = rows.withColumn("held_", F.coalesce(held, F.lit(False)))
    was = F.coalesce(lag("held_"), F.lit(False))
    outside = (h > h1) & (l < l1)
    small = F.abs(b1) <= 0.25 * a
    star = lambda d: (d * b2 < 0) & (F.abs(b2) >= 0.5 * a) & small & (d * b > 0) & (d * (c - (o2 + c2) / 2) > 0)
    rows = rows.withColumn("firm_", F.when(F.abs(b) >= 0.3 * a, F.signum(b)).otherwise(0.0))
    three = lambda d: (F.col("firm_") == d) & (lag("firm_") == d) & (lag("firm_", 2) == d) & (d * (c - c1) > 0) & (d * (c1 - c2) > 0) & (d * (o - o1) >= 0) & (d * (c1 - o) >= 0) & (d * (o1 - o2) >= 0) & (d * (c2 - o1) >= 0)
    ten = by_symbol().rowsBetween(-9, 0)
    known = F.col("i_") >= 10
    bottoms = two(1) & (F.abs(l - l1) <= 0.1 * a) & known & (F.least(l, l1) <= F.min("l").over(ten))
    tops = two(-1) & (F.abs(h - h1) <= 0.1 * a) & known & (F.greatest(h, h1) >= F.max("h").over(ten))
    flags = {
        "engulfing": sign(engulf(1), engulf(-1)),
        "pin": sign(hammer, shooting),
        "inside_bar": F.col("held_").cast("int"),
        "inside_break": sign(was & (c > F.col("h2")), was & (c < F.col("l2"))),
        "outside_bar": sign(outside & (b > 0), outside & (b < 0)),
        "star": sign(star(1), star(-1)),
        "three": sign(three(1), three(-1)),
        "tweezer": sign(bottoms, tops),
    }
    return rows.withColumns(flags).select(*bars_with_atr.columns, *flags)


def doji_at_zone(rows: DataFrame) -> DataFrame:
    """Adds doji to bars with atr and the nearest zones (below, above): 1 at support, -1 at resistance, for a body of at
    most a tenth of a range that is no less than half the last bar's average range, within half a range of the zone; the
    nearer one counts, support where both are as near."""
    unit = F.when(F.col("atr") > 0, F.col("atr"))
    prior = F.lag("atr").over(by_symbol())
    spread = F.col("h") - F.col("l")
    small = (F.abs(F.col("c") - F.col("o")) <= 0.1 * spread) & (spread >= 0.5 * F.when(prior > 0, prior))
    rows = rows.withColumns({"d_": F.coalesce(small, F.lit(False)), "s_": (F.col("c") - F.col("below")) / unit, "r_": (F.col("above") - F.col("c")) / unit})
    support = F.col("d_") & F.coalesce(F.col("s_") <= 0.5, F.lit(False)) & ~F.coalesce(F.col("r_") < F.col("s_"), F.lit(False))
    resistance = F.col("d_") & F.coalesce(F.col("r_") <= 0.5, F.lit(False))
    return rows.withColumn("doji", F.when(support, 1).when(resistance, -1).otherwise(0)).drop("d_", "s_", "r_")


def _spanned(spans: list[list[float]], low: float, high: float) -> list[list[float]]:
    """Disjoint spans in order, with one more taken in."""
    apart = [x for x in spans if x[1] < low or x[0] > high]
    met = [x for x in spans if not (x[1] < low or x[0] > high)]
    return sorted([*apart, [min([low, *(x[0] for x in met)]), max([high, *(x[1] for x in met)])]])


class RetestMachine(Joining):
    """Bars (step 0) and levels (step 1). State: the unbroken levels of either kind in order of price, and the spans of
    prices that closes passed over, which tell what becomes of levels that came before."""

    out = "level_id long, price double, break_i long, touch_i long, fill_i long, rejected boolean"

    def __init__(self, tolerance: float, max_wait: int):
        self.tolerance, self.max_wait = tolerance, max_wait

    def start(self):
        return {"H": [], "L": [], "passed": {"H": [], "L": []}}

    @staticmethod
    def between(side: list, kind: str, low: float, high: float) -> tuple[int, int]:
        """Where levels lie that a close passes: a high is passed from at or below it, a low from at or above it."""
        if kind == "H":
            return bisect.bisect_left(side, [low]), bisect.bisect_left(side, [high])
        return bisect.bisect_right(side, [low, float("inf")]), bisect.bisect_right(side, [high, float("inf")])

    def join(self, before, own):
        out = self.start()
        for kind in "HL":
            left = list(before[kind])
            for low, high in own["passed"][kind]:
                first, last = self.between(left, kind, low, high)
                del left[first:last]
            out[kind] = sorted(left + own[kind])
        return out

    def run(self, state, rows, ahead):
        bars = pd.concat([rows, ahead])
        bars = bars[bars["step"] == 0]
        h, l, c, first = bars["h"].to_numpy(float), bars["l"].to_numpy(float), bars["c"].to_numpy(float), int(bars["i"].iloc[0]) if len(bars) else 0
        out = []
        for i, step, close, was, price, level, kind in zip(*(rows[n].tolist() for n in ("i", "step", "c", "was", "price", "level_id", "kind")), strict=True):
            if step:
                bisect.insort(state[kind], [price, int(level)])
                continue
            k = i - first
            if not (close != was and was == was):
                continue
            kind, d = ("H", 1) if close > was else ("L", -1)
            low, high = sorted((was, close))
            state["passed"][kind] = _spanned(state["passed"][kind], low, high)
            a, b = self.between(state[kind], kind, low, high)
            for price, level in state[kind][a:b]:
                near = (l - price if d > 0 else price - h)[k + 1 : k + 1 + self.max_wait]
                touch, fill = np.flatnonzero(near <= self.tolerance)[:1] + k + 1, np.flatnonzero(near <= min(0.0, self.tolerance))[:1] + k + 1
                rejected = bool(len(touch) and d * (c[touch[0]] - price) > 0)
                out.append((level, price, i, int(touch[0]) + first if len(touch) else None, int(fill[0]) + first if len(fill) else None, rejected))
            del state[kind][a:b]
        return state, out


def retests(bars: DataFrame, levels: DataFrame, tolerance: float, max_wait: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """For each level (symbol, level_id, price, kind H or L, known_i): the first bar after known_i whose close crosses it
    from the other side (break_i), then within max_wait bars the first that comes back within the tolerance (touch_i)
    and to the level itself (fill_i), and whether the touching bar closed on the broken side (rejected).

    A pass over ranges of a symbol's bars with the unbroken levels in order of price: a bar takes those that its close
    passes over, so levels and bars are never paired. Levels that nothing breaks give no row."""
    none = F.lit(None)
    rows = bars.withColumns({"i": F.row_number().over(by_symbol()) - 1, "was": F.lag("c").over(by_symbol())})
    rows = rows.select("symbol", "i", F.lit(0).alias("step"), "h", "l", "c", "was", none.cast("double").alias("price"), none.cast("long").alias("level_id"), none.cast("string").alias("kind"))
    points = levels.where("price is not null and kind in ('H', 'L')").select("symbol", F.col("known_i").cast("int").alias("i"), F.lit(1).alias("step"), *(none.cast("double").alias(n) for n in ("h", "l", "c", "was")), F.col("price").cast("double").alias("price"), F.col("level_id").cast("long").alias("level_id"), "kind")
    return pass_over(rows.unionByName(points), RetestMachine(tolerance, max_wait), order=("i", "step", "price", "level_id"), ahead=max_wait, range_rows=range_rows)[0]


def cluster_levels(points: DataFrame, by: str, price: str, tol: Column) -> DataFrame:
    """Greedy one-dimensional clusters: in order of price, a point joins while it is within tol of the cluster's first.
    (by, low, high, mean, n). An ordered fold over each key's prices."""
    start = F.struct(F.array().cast("array<struct<low:double,high:double,total:double,n:int>>").alias("done"))
    one = lambda x: F.struct(x.alias("low"), x.alias("high"), x.alias("total"), F.lit(1).alias("n"))

    def step(state, x):
        done = state["done"]
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce(x - last["low"] <= F.col("tol_"), F.lit(False))
        grown = F.struct(last["low"].alias("low"), x.alias("high"), (last["total"] + x).alias("total"), (last["n"] + 1).alias("n"))
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.struct(F.when(joins, F.concat(head, F.array(grown))).otherwise(F.concat(done, F.array(one(x)))).alias("done"))

    rows = points.groupBy(by).agg(F.array_sort(F.collect_list(price)).alias("p_"), F.max(tol).alias("tol_"))
    rows = rows.select(by, F.explode(F.aggregate("p_", start, step)["done"]).alias("k"))
    return rows.select(by, F.col("k.low").alias("low"), F.col("k.high").alias("high"), (F.col("k.total") / F.col("k.n")).alias("mean"), F.col("k.n").alias("n"))


#: An impulse, in average ranges: how far, and how far a bar.
IMPULSE_MOVE, IMPULSE_SPEED = 2.5, 0.5


def _impulse(a: list, b: list) -> int:
    """Direction of the leg between two swings (kind, bar, price, average range) if it is an impulse by the range at its start."""
    bars, move, unit = b[1] - a[1], b[2] - a[2], a[3]
    strong = bars > 0 and unit is not None and unit > 0 and abs(move) >= unit * max(IMPULSE_MOVE, IMPULSE_SPEED * bars)
    return int(np.sign(move)) if strong else 0


class BoxMachine(Machine):
    """Bars (step 0) and the swings that they confirm (step 1). A bar is told of once its swings are in. State: the last
    swings, the box, the one that the swings offer, how the closes stand to it, and the last impulse before it."""

    out = "i int, micros long, top double, bottom double, start_i int, status string, begun int, lead int"
    TURNS = 12

    def __init__(self, break_tol: float, life: int, least_height: float):
        self.break_tol, self.life, self.least_height = break_tol, life, least_height

    def start(self):
        return {"turns": [], "box": None, "offer": None, "status": "none", "since": 0, "begun": -1, "lead": 0}

    def offer(self, turns: list, unit: float) -> list | None:
        """[top, bottom, first bar] that the last swings span: four, or three where the first starts an impulse. None
        while highs and lows move the same way, and for one too low."""
        own = turns[-4:]
        if len(own) >= 3 and _impulse(own[0], own[1]):
            own = own[1:]
        if len(own) < 3 or not np.isfinite(unit):
            return None
        sides = {k: [s[2] for s in own if s[0] == k] for k in "HL"}
        if len(own) == 4 and (sides["H"][1] - sides["H"][0]) * (sides["L"][1] - sides["L"][0]) > 0:
            return None
        top, bottom = max(sides["H"]), min(sides["L"])
        return [top, bottom, own[0][1]] if top - bottom >= self.least_height * unit else None

    def bar(self, s: dict, t: int, c: float, before: float) -> None:
        tol = self.break_tol * before if np.isfinite(before) else 0.0
        if s["offer"] and s["status"] in ("none", "inside"):
            if s["status"] == "none":
                s["begun"] = t
            s["box"], s["status"] = s["offer"], "inside"
        box = s["box"]
        if box:
            place = "up" if c > box[0] + tol else "down" if c < box[1] - tol else "inside"
            if place != s["status"]:
                s["status"], s["since"] = place, t
            elif place != "inside" and t - s["since"] >= self.life:
                s["box"], s["status"], s["begun"] = None, "none", -1

    def told(self, s: dict, t: int, micros: int, atr: float, changed: bool) -> tuple:
        s["offer"] = offer = self.offer(s["turns"], atr)
        if changed or offer:
            recent = s["turns"][-9:]
            ended = [(a, b) for a, b in zip(recent, recent[1:], strict=False) if not offer or b[1] <= offer[2]]
            s["lead"] = next((d for a, b in reversed(ended) if (d := _impulse(a, b))), 0)
        return (t, micros, *(s["box"] or (None, None, None)), s["status"], s["begun"], s["lead"])

    def run(self, state, rows, ahead):
        out: list[tuple] = []
        open_: tuple | None = None
        changed = False
        for i, step, micros, c, atr, before, kind, level_i, level in zip(*(rows[n].tolist() for n in ("i", "step", "micros", "c", "atr", "before", "kind", "level_i", "level")), strict=True):
            if step:
                turns, changed = state["turns"], True
                if turns and turns[-1][0] == kind:
                    turns.pop()
                turns.append([kind, int(level_i), level, atr if np.isfinite(atr) else None])
                del turns[: max(0, len(turns) - self.TURNS)]
                continue
            if open_:
                out.append(self.told(state, *open_, changed))
            self.bar(state, int(i), c, before)
            open_, changed = (int(i), int(micros), atr), False
        if open_:
            out.append(self.told(state, *open_, changed))
        return state, out


def box_states(bars_with_atr: DataFrame, left: int = 2, right: int = 2, break_tol: float = 0.1, life: int = 24, least_height: float = 0.75, range_rows: int = RANGE_ROWS, warm_rows: int = WARM_ROWS) -> DataFrame:
    """Per bar the range that the last alternating swings span, and whether closes hold it (inside), have left it (up or
    down) or there is none. A bar sees only swings confirmed before it. While closes stay inside, the box follows the
    swings; closes outside that last `life` bars end it. episode numbers a box's life, lead is the last impulse's
    direction before the box that the swings offer.

    Swings come from window frames, the state that passes from bar to bar from a pass over ranges of a symbol's bars."""
    numbered = bars_with_atr.withColumns({"i": F.row_number().over(by_symbol()) - 1, "before": F.lag("atr").over(by_symbol()), "micros": F.unix_micros(F.col("ts").cast("timestamp"))})
    none = F.lit(None)
    bars = numbered.select("symbol", "i", F.lit(0).alias("step"), "micros", "c", "atr", "before", none.cast("string").alias("kind"), none.cast("int").alias("level_i"), none.cast("double").alias("level"))
    swings = swings_in_turn(bars_with_atr, left, right).join(numbered.select("symbol", F.col("i").alias("level_i"), "atr"), ["symbol", "level_i"])
    swings = swings.select("symbol", F.col("known_i").cast("int").alias("i"), F.lit(1).alias("step"), none.cast("long").alias("micros"), none.cast("double").alias("c"), "atr", none.cast("double").alias("before"), "kind", "level_i", "level")
    out, _ = pass_over(bars.unionByName(swings), BoxMachine(break_tol, life, least_height), order=("i", "step", "level_i", "kind"), range_rows=range_rows, warm_rows=warm_rows)
    begun = out.where("begun >= 0").select("symbol", "begun").distinct().withColumn("episode", F.row_number().over(Window.partitionBy("symbol").orderBy("begun")) - 1)
    out = out.join(begun, ["symbol", "begun"], "left")
    ts = F.timestamp_micros("micros").cast(dict(bars_with_atr.dtypes)["ts"])
    return out.select("symbol", ts.alias("ts"), "i", "top", "bottom", "start_i", "status", F.coalesce("episode", F.lit(-1)).alias("episode"), "lead")


def box_breaks(states: DataFrame, bars_with_atr: DataFrame) -> DataFrame:
    """Closes that leave a box: symbol, i, side, top, bottom, start_i, edge, episode, attempt (of its side in the
    episode), lead (last impulse before the box), body_atr, back_i (the bar that closes inside again or on the other side;
    null if none does while the box lives)."""
    own, life = by_symbol(), Window.partitionBy("symbol", "episode").orderBy("i")
    rows = states.withColumns({"was_": F.coalesce(F.lag("status").over(own), F.lit("none")), "before_": F.coalesce(F.lag("lead").over(own), F.lit(0))})
    rows = rows.withColumn("lead", F.first("before_").over(life.rowsBetween(Window.unboundedPreceding, 0)))
    change = rows.where("status <> was_")
    after = Window.partitionBy("symbol").orderBy("i")
    back = F.when(F.lead("status").over(after) != "none", F.lead("i").over(after))
    change = change.withColumn("back_i", back).where("status in ('up', 'down')").withColumn("side", F.when(F.col("status") == "up", 1).otherwise(-1))
    change = change.withColumns({"attempt": F.row_number().over(Window.partitionBy("symbol", "episode", "side").orderBy("i")), "edge": F.when(F.col("side") > 0, F.col("top")).otherwise(F.col("bottom"))})
    unit = F.lag("atr").over(own)
    bodies = bars_with_atr.select("symbol", "ts", F.when(unit > 0, F.abs(F.col("c") - F.col("o")) / unit).alias("body_atr"))
    return change.join(bodies, ["symbol", "ts"]).select("symbol", "i", "side", "top", "bottom", "start_i", "edge", "episode", "attempt", "lead", "body_atr", "back_i")
