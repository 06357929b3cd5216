"""Chart patterns of confirmed swings, and their life from forming over confirmed to dropped, in frames and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_symbol
from .structure import IMPULSE_MOVE, IMPULSE_SPEED, swings_in_turn

#: Fixed values, in average ranges and bars.
EQUAL, SHOULDER, HEAD, DEPTH, FLAT, SLOPED, BREAK = 0.5, 1.0, 0.5, 1.5, 0.3, 0.5, 0.1
MOST_AGE, KEPT, POLE_AGE, RETRACED = 120, 40, 40, 0.5
FAMILIES = ("double", "triple", "hs", "triangle", "wedge", "flag", "pennant")
LEGS = 8

_LINE = "struct<p:double,i:int,slope:double>"


def _line(p: Column, i: Column, slope: Column | float = 0.0) -> Column:
    slope = slope if isinstance(slope, Column) else F.lit(slope)
    return F.struct(p.cast("double").alias("p"), i.cast("int").alias("i"), slope.cast("double").alias("slope"))


def _shape(family: str, holds: Column, direction: Column, line: Column, other: Column | None = None, beyond: Column | None = None, side: Column | None = None, edge: Column | None = None) -> Column:
    """What a pattern is: its direction, its trigger line, a second one if it breaks either way, the level on whose `side`
    a close drops it, or the line that does."""
    none = F.lit(None)
    return F.when(
        F.coalesce(holds, F.lit(False)),
        F.struct(
            F.lit(family).alias("family"), direction.cast("int").alias("dir"), line.alias("line"), (other if other is not None else none.cast(_LINE)).alias("other"),
            (beyond if beyond is not None else none).cast("double").alias("beyond"), (side if side is not None else none).cast("int").alias("side"), (edge if edge is not None else none.cast(_LINE)).alias("edge"),
        ),
    )


def _recent_swings(bars_with_atr: DataFrame) -> DataFrame:
    """(symbol, i, a, alt): for each bar that confirms swings the alternating ones known then, the last nine from old to
    new, each run of a kind by its extreme so far; a is the bar's average range."""
    at = bars_with_atr.withColumn("i", F.row_number().over(by_symbol()) - 1).select("symbol", "i", F.col("atr").alias("u"))
    turn = Window.partitionBy("symbol").orderBy("level_i", "kind")
    rows = swings_in_turn(bars_with_atr).join(at.withColumnRenamed("i", "level_i"), ["symbol", "level_i"])
    rows = rows.withColumn("new_", F.coalesce((F.lag("kind").over(turn) != F.col("kind")).cast("int"), F.lit(1))).withColumn("run", F.sum("new_").over(turn))
    rows = rows.withColumn("x", F.struct("kind", F.col("level_i").alias("i"), F.col("level").alias("p"), "u"))
    ends = rows.groupBy("symbol", "run").agg(F.max_by("x", "level_i").alias("x"))
    ends = ends.select("symbol", "run", F.collect_list("x").over(Window.partitionBy("symbol").orderBy("run").rowsBetween(-LEGS, -1)).alias("before"))
    last = Window.partitionBy("symbol", "known_i").orderBy(F.desc("level_i"), F.desc("kind"))
    rows = rows.withColumn("n_", F.row_number().over(last)).where("n_ = 1").join(ends, ["symbol", "run"])
    rows = rows.select("symbol", F.col("known_i").alias("i"), F.concat("before", F.array("x")).alias("alt"))
    return rows.join(at.withColumnRenamed("u", "a"), ["symbol", "i"])


def detected(recent: DataFrame) -> DataFrame:
    """(symbol, i, family, dir, line, other, beyond, side, edge): the patterns that swings form (symbol, i: the bar that
    confirms the last of them, a: its average range, alt: up to nine alternating ones, struct<kind,i,p,u> from old to new,
    u the average range at the swing). All from that array; a swing that isn't there makes a condition false."""
    rows = recent.where((F.col("a") > 0) & (F.size("alt") >= 3))
    # in steps, each of which names what the next one uses more than once
    rows = rows.withColumns({f"x{k}": F.try_element_at("alt", F.lit(-k)) for k in range(1, 6)})
    x = [None, *(F.col(f"x{k}") for k in range(1, 6))]
    a, t, s = F.col("a"), F.col("i"), F.col("s")
    is_top = x[1]["kind"] == "H"
    # the last two highs and lows, of which the newest swing is one
    ends = {n: F.when(is_top, x[p]).otherwise(x[o]) for n, p, o in (("h1", 1, 2), ("h0", 3, 4), ("l1", 2, 1), ("l0", 4, 3))}
    rows = rows.withColumns(ends | {"s": F.when(is_top, 1).otherwise(-1), "pole": _pole()})  # turned by s, what holds for tops holds for bottoms
    h1, h0, l1, l0 = (F.col(k) for k in ends)
    slope = lambda new, old: (new["p"] - old["p"]) / F.greatest(new["i"] - old["i"], F.lit(1))
    rows = rows.withColumns({f"q{k}": s * x[k]["p"] for k in range(1, 6)} | {"dh": h1["p"] - h0["p"], "dl": l1["p"] - l0["p"], "sh": slope(h1, h0), "sl": slope(l1, l0)} | _since_pole())
    q = [None, *(F.col(f"q{k}") for k in range(1, 6))]
    dh, dl, sh, sl = (F.col(k) for k in ("dh", "dl", "sh", "sl"))
    least = F.least(q[1], q[3])
    double = (F.abs(q[1] - q[3]) <= EQUAL * a) & (least - q[2] >= DEPTH * a) & F.coalesce(q[4] < q[2], F.lit(True))
    five = x[5].isNotNull()
    tops, low3, neck = F.greatest(q[1], q[3], q[5]), F.least(q[1], q[3], q[5]), F.least(q[2], q[4])
    triple = five & (tops - low3 <= 1.5 * EQUAL * a) & (low3 - neck >= DEPTH * a)
    head = five & (q[3] - F.greatest(q[1], q[5]) >= HEAD * a) & (F.abs(q[1] - q[5]) <= SHOULDER * a)
    flat_h, flat_l, up_h, up_l, down_h, down_l = F.abs(dh) <= FLAT * a, F.abs(dl) <= FLAT * a, dh >= SLOPED * a, dl >= SLOPED * a, dh <= -SLOPED * a, dl <= -SLOPED * a
    upper, lower = _line(h1["p"], h1["i"], sh), _line(l1["p"], l1["i"], sl)
    one = F.lit(1)
    # flat and sloped exclude each other, so at most one of these holds
    triangles = [
        _shape("triangle", flat_h & up_l, one, _line(F.greatest(h0["p"], h1["p"]), h1["i"]), beyond=l1["p"] - EQUAL * a, side=-one),
        _shape("triangle", flat_l & down_h, -one, _line(F.least(l0["p"], l1["p"]), l1["i"]), beyond=h1["p"] + EQUAL * a, side=one),
        _shape("triangle", down_h & up_l, F.lit(0), upper, lower),
    ]
    wedges = [_shape("wedge", up_h & up_l & (sl > sh), -one, lower, side=one, edge=upper), _shape("wedge", down_h & down_l & (sh < sl), one, upper, side=-one, edge=lower)]
    found = [
        _shape("double", double, -s, _line(x[2]["p"], x[2]["i"]), beyond=s * (F.greatest(q[1], q[3]) + EQUAL * a), side=s),
        _shape("triple", triple, -s, _line(s * neck, x[2]["i"]), beyond=s * (tops + EQUAL * a), side=s),
        _shape("hs", head, -s, _line(x[2]["p"], x[2]["i"], slope(x[2], x[4])), beyond=x[3]["p"], side=s),
        *triangles,
        *wedges,
        *_after_a_pole(a, t),
    ]
    return rows.select("symbol", "i", F.explode(F.array_compact(F.array(*found))).alias("s")).select("symbol", "i", "s.*")


def _pole() -> Column:
    """The newest impulse leg: the place of its first swing, from 1, its direction, end and length."""
    alt = F.col("alt")

    def leg(k: Column) -> Column:
        x, y = F.element_at(alt, k), F.element_at(alt, k + 1)
        bars, move = y["i"] - x["i"], y["p"] - x["p"]
        strong = (bars > 0) & (x["u"] > 0) & (F.abs(move) >= IMPULSE_MOVE * x["u"]) & (F.abs(move) / bars >= IMPULSE_SPEED * x["u"])
        return F.when(strong, F.struct(k.alias("k"), F.signum(move).cast("int").alias("d"), y["p"].alias("p"), y["i"].alias("i"), F.abs(move).alias("long")))

    return F.array_max(F.filter(F.transform(F.sequence(F.lit(1), F.size(alt) - 1), leg), lambda x: x.isNotNull()))


def _since_pole() -> dict[str, Column]:
    """Swings after the pole, those against it and those along it."""
    d, after = F.col("pole.d"), F.slice("alt", F.col("pole.k") + 2, F.size("alt"))
    return {"against": F.filter(after, lambda x: (x["kind"] == "H") == (d < 0)), "along": F.filter(after, lambda x: (x["kind"] == "H") == (d > 0))}


def _after_a_pole(a: Column, t: Column) -> tuple[Column, Column]:
    """Flag and pennant: swings after the newest impulse leg that take back at most half of it."""
    d, end, last, long, against, along = (F.col(k) for k in ("pole.d", "pole.p", "pole.i", "pole.long", "against", "along"))
    back = (d * end - F.array_min(F.transform(against, lambda x: d * x["p"]))) / long
    beyond = F.exists(along, lambda x: d * (x["p"] - end) > EQUAL * a)
    ok = (t - last > 0) & (t - last <= POLE_AGE) & (F.size(against) > 0) & (back > 0) & (back <= RETRACED) & ~beyond
    w = F.try_element_at(along, F.lit(-1))
    newest, oldest = F.try_element_at(against, F.lit(-1)), F.try_element_at(against, F.lit(1))
    narrows = F.coalesce((F.size(against) >= 2) & (d * (newest["p"] - oldest["p"]) >= FLAT * a) & (d * (end - w["p"]) >= FLAT * a), F.lit(False))
    bound, side = end - d * RETRACED * long, -d
    pennant = _line(w["p"], w["i"], (w["p"] - end) / F.greatest(w["i"] - last, F.lit(1)))
    flag = _line(F.coalesce(w["p"], end), F.coalesce(w["i"], last))
    return _shape("flag", ok & ~narrows, d, flag, beyond=bound, side=side), _shape("pennant", ok & narrows, d, pennant, beyond=bound, side=side)


def chart_patterns(bars_with_atr: DataFrame) -> DataFrame:
    """Each bar's living patterns (symbol, i, family, started, dir, state, age, line): state 1 while forming, 2 from the bar
    whose close passes the trigger line by BREAK average ranges; line is the trigger's price at the bar.

    A pattern lives until the next of its family starts, a close drops it while it forms, it gets older than MOST_AGE, or
    KEPT bars after it is confirmed; that of two lines has no direction until a close breaks one. So a family has at most
    one pattern a bar, and the bars of all lives are a join by equality that grows with the bars. No row depends on later bars.
    Bars without an average range break and drop by the line itself; no bars give no rows."""
    own = Window.partitionBy("symbol", "family").orderBy("i")
    lives = detected(_recent_swings(bars_with_atr)).withColumn("until", F.lead("i").over(own)).withColumnRenamed("i", "started")
    last = F.least(F.col("until") - 1, F.col("started") + MOST_AGE + KEPT)
    lives = lives.withColumn("i", F.explode(F.sequence("started", last)))
    bars = bars_with_atr.select("symbol", (F.row_number().over(by_symbol()) - 1).alias("i"), "c", F.coalesce(BREAK * F.col("atr"), F.lit(0.0)).alias("tol"))
    rows = lives.join(bars, ["symbol", "i"])
    price = lambda line: F.col(f"{line}.p") + F.col(f"{line}.slope") * (F.col("i") - F.col(f"{line}.i"))
    c, tol, d = F.col("c"), F.col("tol"), F.col("dir")
    rows = rows.withColumns({"at_": price("line"), "low_": price("other"), "edge_": price("edge"), "age": F.col("i") - F.col("started")})
    up, low = F.col("at_"), F.col("low_")
    two = F.when(c - up > tol, 1).when(low - c > tol, -1)
    rows = rows.withColumn("breaks_", F.when(F.col("age") <= MOST_AGE, F.when(d == 0, two).when((d * (c - up) > tol) & (F.col("age") > 0), d)))
    drops = (F.col("age") > MOST_AGE) | F.coalesce(F.col("side") * (c - F.col("beyond")) > 0, F.lit(False)) | F.coalesce(F.col("side") * (c - F.col("edge_")) > tol, F.lit(False))
    so_far = Window.partitionBy("symbol", "family", "started").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"dropped_": F.min(F.when(drops, F.col("i"))).over(so_far), "broke_": F.min(F.when(F.col("breaks_").isNotNull(), F.struct("i", "breaks_"))).over(so_far)})
    at = F.col("broke_.i")
    confirmed = at.isNotNull() & F.coalesce(at <= F.col("dropped_"), F.lit(True))
    rows = rows.where((confirmed & (F.col("i") <= at + KEPT)) | (~confirmed & F.col("dropped_").isNull()))
    went = F.when(confirmed, F.col("broke_.breaks_")).otherwise(d)
    nearer = F.when(F.abs(low - c) < F.abs(up - c), low).otherwise(up)
    line = F.when(d != 0, up).when(~confirmed, nearer).when(went < 0, low).otherwise(up)
    return rows.select("symbol", "i", "family", "started", went.alias("dir"), F.when(confirmed, 2).otherwise(1).alias("state"), "age", line.alias("line"))


def pattern_columns(bars_with_atr: DataFrame) -> DataFrame:
    """Five columns a family for each bar (symbol, ts, i): active, dir, state (0 where there is none), age, and dist_atr,
    what is still to go to the trigger line in average ranges, negative beyond it."""
    bars = bars_with_atr.select("symbol", "ts", (F.row_number().over(by_symbol()) - 1).alias("i"), "c", F.when(F.col("atr") > 0, F.col("atr")).alias("unit"))
    alive = bars.join(chart_patterns(bars_with_atr), ["symbol", "i"], "left")
    d, off = F.col("dir"), F.col("line") - F.col("c")
    alive = alive.withColumn("dist", F.when(d != 0, d * off).otherwise(F.abs(off)) / F.col("unit"))
    of = lambda f, x: F.max(F.when(F.col("family") == f, F.col(x)))
    cols = []
    for f in FAMILIES:
        cols += [F.coalesce(of(f, "state") * 0 + 1, F.lit(0)).alias(f"{f}_active"), *(F.coalesce(of(f, x), F.lit(0)).alias(f"{f}_{x}") for x in ("dir", "state")), of(f, "age").alias(f"{f}_age"), of(f, "dist").alias(f"{f}_dist_atr")]
    return alive.groupBy("symbol", "ts", "i").agg(*cols)
