"""Queries over market structure, boxes, zones and the trades and odds that follow from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import choices, indicators, models, patterns, reactions, signals, structure
from ..operators import zones as zone_rules
from ..session import checkpointed, shared_folder
from ..streaming import live
from .common import HOURLY, hourly, r6, shown
from .market import ATR, LEVELS, _levels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Hourly bars numbered from 0 with their average range, and the swings in alternation.
BASE = f"""{HOURLY}, {ATR}, z AS (SELECT symbol, ts, o, h, l, c, atr, i - 1 AS i FROM a), {LEVELS},
sa AS (SELECT symbol, kind, level_id // 2 AS li, price AS p, known_i, CASE kind WHEN 'H' THEN price ELSE -price END AS q FROM lv),
sb AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY symbol ORDER BY li, kind) = kind THEN 0 ELSE 1 END AS fresh FROM sa),
sc AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY li, kind) AS run FROM sb),
sd AS (SELECT *, max(q) OVER (PARTITION BY symbol, run ORDER BY li ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM sc),
ex AS (SELECT symbol, run, CASE any_value(kind) WHEN 'H' THEN max(q) ELSE -max(q) END AS p FROM sc GROUP BY 1, 2),
sw AS (SELECT s.symbol, s.kind, s.li, s.p, s.known_i, s.run, z.atr, CASE WHEN ex.p IS NULL THEN NULL WHEN s.p > ex.p THEN 'H' WHEN s.p < ex.p THEN 'L' ELSE 'EQ' END || s.kind AS label,
  row_number() OVER (PARTITION BY s.symbol ORDER BY s.li, s.kind) AS ord FROM sd s LEFT JOIN ex ON ex.symbol = s.symbol AND ex.run = s.run - 2 JOIN z ON z.symbol = s.symbol AND z.i = s.li WHERE best IS NULL OR q > best)"""
EVENTS = """sn AS (SELECT *, lead(known_i) OVER (PARTITION BY symbol, kind ORDER BY li) AS until FROM sw),
et AS (SELECT n.symbol, n.kind AS side, n.li, n.p, n.label, z.i, z.ts, CASE n.kind WHEN 'H' THEN z.c > n.p ELSE z.c < n.p END AS closed, CASE n.kind WHEN 'H' THEN z.h > n.p ELSE z.l < n.p END AS reached FROM sn n JOIN z ON z.symbol = n.symbol AND z.i > n.known_i AND z.i <= coalesce(n.until, 1000000000)),
eb AS (SELECT symbol, side, li, min(i) AS bi FROM et WHERE closed GROUP BY 1, 2, 3),
ev AS (SELECT et.symbol, et.ts, et.i, CASE WHEN et.i = eb.bi THEN CASE et.side WHEN 'H' THEN 'bos_up' ELSE 'bos_down' END WHEN et.reached THEN CASE et.side WHEN 'H' THEN 'sweep_high' ELSE 'sweep_low' END END AS event, et.p AS level, et.li AS level_i, et.label
  FROM et LEFT JOIN eb ON eb.symbol = et.symbol AND eb.side = et.side AND eb.li = et.li WHERE eb.bi IS NULL OR et.i <= eb.bi)"""


@query(
    f"""WITH RECURSIVE {BASE}, {EVENTS} SELECT symbol, ts, i::INTEGER AS i, NULL::VARCHAR AS kind, event, round(level, 6) AS level, level_i::INTEGER AS level_i, label FROM ev WHERE event IS NOT NULL
    UNION ALL SELECT sw.symbol, z.ts, z.i::INTEGER, sw.kind, NULL, round(sw.p, 6), sw.li::INTEGER, sw.label FROM sw JOIN z ON z.symbol = sw.symbol AND z.i = sw.known_i"""
)
def structure_events(spark, d):
    return shown(structure.run_structure(hourly(spark, d)).where("event is not null or kind is not null").drop("trend"))


@query(
    f"""WITH RECURSIVE {BASE}, hi AS (SELECT symbol, known_i, label FROM sw WHERE kind = 'H'), lo AS (SELECT symbol, known_i, label FROM sw WHERE kind = 'L'),
    t AS (SELECT z.symbol, z.ts, z.i, hi.label AS x FROM z ASOF LEFT JOIN hi ON hi.symbol = z.symbol AND z.i >= hi.known_i), u AS (SELECT z.symbol, z.i, lo.label AS y FROM z ASOF LEFT JOIN lo ON lo.symbol = z.symbol AND z.i >= lo.known_i)
    SELECT t.symbol, t.ts, t.i::INTEGER AS i, CASE WHEN x = 'HH' AND y = 'HL' THEN 'up' WHEN x = 'LH' AND y = 'LL' THEN 'down' ELSE 'range' END AS trend FROM t JOIN u ON t.symbol = u.symbol AND t.i = u.i"""
)
def structure_trend(spark, d):
    return shown(structure.run_structure(hourly(spark, d)).where("trend is not null"), "symbol", "ts", "i", "trend")


def _confirmed(spark, d):
    """Swings in alternation with the average range at their bar."""
    bars = indicators.atr(hourly(spark, d))
    at = bars.withColumn("level_i", F.row_number().over(indicators.by_symbol()) - 1).select("symbol", "level_i", "atr")
    s = structure.swings_in_turn(bars).join(at, ["symbol", "level_i"])
    return s.select("symbol", F.col("level_i").alias("swing_i"), "kind", F.col("level").alias("price"), "atr", "known_i")


LEG = "leg AS (SELECT symbol, li AS swing_i, p, atr, lead(li) OVER w AS to_i, lead(p) OVER w AS q FROM sw WINDOW w AS (PARTITION BY symbol ORDER BY li, kind))"


@query(
    f"""WITH RECURSIVE {BASE}, {LEG} SELECT symbol, swing_i::INTEGER AS swing_i, to_i::INTEGER AS to_i, (to_i - swing_i)::INTEGER AS bars, round(q - p, 6) AS move, sign(q - p)::DOUBLE AS direction,
    coalesce(abs(q - p) >= 2.5 * atr AND abs(q - p) / nullif(to_i - swing_i, 0) >= 0.5 * atr, false) AS impulse FROM leg WHERE to_i IS NOT NULL"""
)
def legs(spark, d):
    return shown(reactions.legs(_confirmed(spark, d)))


_TURN = "CASE kind WHEN 'H' THEN 1 ELSE -1 END"


@query(
    f"""WITH RECURSIVE {BASE}, g AS (SELECT symbol, li AS swing_i, kind, atr AS a, {_TURN} AS s, p AS p0, li AS x0, {', '.join(f'lag(p, {k}) OVER w AS p{k}, lag(li, {k}) OVER w AS x{k}' for k in range(1, 5))} FROM sw WINDOW w AS (PARTITION BY symbol ORDER BY li, kind)),
    q AS (SELECT *, {', '.join(f's * p{k} AS q{k}' for k in range(5))}, CASE kind WHEN 'H' THEN p0 - p2 ELSE p1 - p3 END AS dh, CASE kind WHEN 'H' THEN p1 - p3 ELSE p0 - p2 END AS dl, CASE kind WHEN 'H' THEN x0 - x2 ELSE x1 - x3 END AS nh, CASE kind WHEN 'H' THEN x1 - x3 ELSE x0 - x2 END AS nl FROM g)
    SELECT symbol, swing_i::INTEGER AS swing_i, kind, CASE WHEN abs(q0 - q2) <= 0.5 * a AND least(q0, q2) - q1 >= 1.5 * a AND coalesce(q3 < q1, true) THEN -s END AS double,
    CASE WHEN p4 IS NOT NULL AND greatest(q0, q2, q4) - least(q0, q2, q4) <= 0.75 * a AND least(q0, q2, q4) - least(q1, q3) >= 1.5 * a THEN -s END AS triple,
    CASE WHEN p4 IS NOT NULL AND q2 - greatest(q0, q4) >= 0.5 * a AND abs(q0 - q4) <= a THEN -s END AS head_shoulders,
    CASE WHEN p3 IS NULL THEN NULL WHEN abs(dh) <= 0.3 * a AND dl >= 0.5 * a THEN 1 WHEN abs(dl) <= 0.3 * a AND dh <= -0.5 * a THEN -1 WHEN dh <= -0.5 * a AND dl >= 0.5 * a THEN 0 END AS triangle,
    CASE WHEN p3 IS NULL THEN NULL WHEN dh >= 0.5 * a AND dl >= 0.5 * a AND dl / nl > dh / nh THEN -1 WHEN dh <= -0.5 * a AND dl <= -0.5 * a AND dh / nh < dl / nl THEN 1 END AS wedge FROM q"""
)
def swing_shapes(spark, d):
    return shown(reactions.swing_shapes(_confirmed(spark, d)))


# ---- chart patterns: shapes of the last swings as lists, and what bars make of them ------------------------------------
def _fam(family: str, when: str, d: str, line: str, other: str = "NULL", beyond: str = "NULL", side: str = "NULL", edge: str = "NULL") -> str:
    line, other, edge = (f"{x}::STRUCT(p DOUBLE, i BIGINT, s DOUBLE)" for x in (line, other, edge))
    return f"SELECT symbol, t, '{family}' AS family, ({d})::INTEGER AS d, {line} AS ln, {other} AS ot, ({beyond})::DOUBLE AS bey, ({side})::INTEGER AS sid, {edge} AS ed FROM ch WHERE {when}"


def _ln(p: str, i: str, s: str = "0") -> str:
    return f"{{'p': {p}, 'i': {i}, 's': {s}}}"


_UPPER, _LOWER = _ln("h1.p", "h1.i", "sh"), _ln("l1.p", "l1.i", "sl")
_POLE = "po IS NOT NULL AND t - po.i BETWEEN 1 AND 40 AND len(ag) > 0 AND back > 0 AND back <= 0.5 AND len(list_filter(al, lambda x: po.d * (x.p - po.p) > 0.5 * a)) = 0"
_NARROW = "(len(ag) >= 2 AND len(al) > 0 AND po.d * (ag[-1].p - ag[1].p) >= 0.3 * a AND po.d * (po.p - al[-1].p) >= 0.3 * a)"
_SHAPES = f"""fin AS (SELECT symbol, run, arg_max({{'k': kind, 'i': li, 'p': p, 'u': atr}}, li) AS x FROM sw GROUP BY 1, 2),
bef AS (SELECT symbol, run, list(x) OVER (PARTITION BY symbol ORDER BY run ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS b FROM fin),
ca AS (SELECT sw.symbol, sw.known_i AS t, list_concat(coalesce(b, []), [{{'k': kind, 'i': li, 'p': p, 'u': atr}}]) AS alt, row_number() OVER (PARTITION BY sw.symbol, sw.known_i ORDER BY li DESC, kind DESC) AS n FROM sw JOIN bef ON bef.symbol = sw.symbol AND bef.run = sw.run),
cb AS (SELECT ca.symbol, t, alt, z.atr AS a, CASE alt[-1].k WHEN 'H' THEN 1 ELSE -1 END AS s, alt[-1] AS x1, alt[-2] AS x2, alt[-3] AS x3, alt[-4] AS x4, alt[-5] AS x5,
  list_last(list_filter(list_transform(range(1, len(alt)), lambda k: {{'k': k, 'd': sign(alt[k + 1].p - alt[k].p)::INTEGER, 'p': alt[k + 1].p, 'i': alt[k + 1].i, 'len': abs(alt[k + 1].p - alt[k].p), 'n': alt[k + 1].i - alt[k].i, 'u': alt[k].u}}), lambda y: y.n > 0 AND y.u > 0 AND y.len >= 2.5 * y.u AND y.len / y.n >= 0.5 * y.u)) AS po
  FROM ca JOIN z ON z.symbol = ca.symbol AND z.i = ca.t WHERE n = 1 AND z.atr > 0 AND len(alt) >= 3),
cc AS (SELECT *, s * x1.p AS q1, s * x2.p AS q2, s * x3.p AS q3, s * x4.p AS q4, s * x5.p AS q5, CASE WHEN s > 0 THEN x1 ELSE x2 END AS h1, CASE WHEN s > 0 THEN x3 ELSE x4 END AS h0, CASE WHEN s > 0 THEN x2 ELSE x1 END AS l1, CASE WHEN s > 0 THEN x4 ELSE x3 END AS l0,
  alt[po.k + 2:] AS af FROM cb),
cd AS (SELECT *, h1.p - h0.p AS dh, l1.p - l0.p AS dl, (h1.p - h0.p) / greatest(h1.i - h0.i, 1) AS sh, (l1.p - l0.p) / greatest(l1.i - l0.i, 1) AS sl, list_filter(af, lambda x: (x.k = 'H') = (po.d < 0)) AS ag, list_filter(af, lambda x: (x.k = 'H') = (po.d > 0)) AS al FROM cc),
ch AS (SELECT *, (po.d * po.p - list_min(list_transform(ag, lambda x: po.d * x.p))) / po.len AS back FROM cd),
sp AS ({_fam('double', "abs(q1 - q3) <= 0.5 * a AND least(q1, q3) - q2 >= 1.5 * a AND coalesce(q4 < q2, true)", '-s', _ln('x2.p', 'x2.i'), beyond='s * (greatest(q1, q3) + 0.5 * a)', side='s')}
UNION ALL {_fam('triple', "x5 IS NOT NULL AND greatest(q1, q3, q5) - least(q1, q3, q5) <= 0.75 * a AND least(q1, q3, q5) - least(q2, q4) >= 1.5 * a", '-s', _ln('s * least(q2, q4)', 'x2.i'), beyond='s * (greatest(q1, q3, q5) + 0.5 * a)', side='s')}
UNION ALL {_fam('hs', "x5 IS NOT NULL AND q3 - greatest(q1, q5) >= 0.5 * a AND abs(q1 - q5) <= a", '-s', _ln('x2.p', 'x2.i', '(x2.p - x4.p) / greatest(x2.i - x4.i, 1)'), beyond='x3.p', side='s')}
UNION ALL {_fam('triangle', "abs(dh) <= 0.3 * a AND dl >= 0.5 * a", '1', _ln('greatest(h0.p, h1.p)', 'h1.i'), beyond='l1.p - 0.5 * a', side='-1')}
UNION ALL {_fam('triangle', "abs(dl) <= 0.3 * a AND dh <= -0.5 * a", '-1', _ln('least(l0.p, l1.p)', 'l1.i'), beyond='h1.p + 0.5 * a', side='1')}
UNION ALL {_fam('triangle', "dh <= -0.5 * a AND dl >= 0.5 * a", '0', _UPPER, other=_LOWER)}
UNION ALL {_fam('wedge', "dh >= 0.5 * a AND dl >= 0.5 * a AND sl > sh", '-1', _LOWER, side='1', edge=_UPPER)}
UNION ALL {_fam('wedge', "dh <= -0.5 * a AND dl <= -0.5 * a AND sh < sl", '1', _UPPER, side='-1', edge=_LOWER)}
UNION ALL {_fam('flag', f'{_POLE} AND NOT {_NARROW}', 'po.d', _ln('coalesce(al[-1].p, po.p)', 'coalesce(al[-1].i, po.i)'), beyond='po.p - po.d * 0.5 * po.len', side='-po.d')}
UNION ALL {_fam('pennant', f'{_POLE} AND {_NARROW}', 'po.d', _ln('al[-1].p', 'al[-1].i', '(al[-1].p - po.p) / greatest(al[-1].i - po.i, 1)'), beyond='po.p - po.d * 0.5 * po.len', side='-po.d')}),
li AS (SELECT *, lead(t) OVER (PARTITION BY symbol, family ORDER BY t) AS til FROM sp),
lb AS (SELECT li.*, z.i, z.i - t AS age, z.c, coalesce(0.1 * z.atr, 0) AS tol, ln.p + ln.s * (z.i - ln.i) AS up, ot.p + ot.s * (z.i - ot.i) AS low, ed.p + ed.s * (z.i - ed.i) AS edp FROM li JOIN z ON z.symbol = li.symbol AND z.i >= t AND z.i < coalesce(til, 1000000000) AND z.i <= t + 160),
lc AS (SELECT *, CASE WHEN age > 120 THEN NULL WHEN d = 0 THEN CASE WHEN c - up > tol THEN 1 WHEN low - c > tol THEN -1 END WHEN age > 0 AND d * (c - up) > tol THEN d END AS br, age > 120 OR coalesce(sid * (c - bey) > 0, false) OR coalesce(sid * (c - edp) > tol, false) AS dr FROM lb),
ld AS (SELECT symbol, family, t, min(i) FILTER (WHERE br IS NOT NULL) AS bi, arg_min(br, i) FILTER (WHERE br IS NOT NULL) AS bd, min(i) FILTER (WHERE dr) AS di FROM lc GROUP BY 1, 2, 3),
le AS (SELECT lc.*, CASE WHEN bi <= coalesce(di, bi) THEN bi END AS conf, bd, di FROM lc JOIN ld ON ld.symbol = lc.symbol AND ld.family = lc.family AND ld.t = lc.t),
lf AS (SELECT *, coalesce(i >= conf, false) AS done FROM le WHERE CASE WHEN conf IS NULL THEN i < coalesce(di, 1000000000) ELSE i <= conf + 40 END),
pat AS (SELECT symbol, i, family, t, CASE WHEN done THEN bd ELSE d END AS d, CASE WHEN done THEN 2 ELSE 1 END AS state, age, CASE WHEN d <> 0 THEN up WHEN NOT done THEN CASE WHEN abs(low - c) < abs(up - c) THEN low ELSE up END WHEN bd < 0 THEN low ELSE up END AS line, c FROM lf)"""


@query(f"WITH RECURSIVE {BASE}, {_SHAPES} SELECT symbol, i::INTEGER AS i, family, t::INTEGER AS started, d AS dir, state, age::INTEGER AS age, round(line, 6) AS line FROM pat")
def chart_patterns(spark, d):
    return shown(patterns.chart_patterns(indicators.atr(hourly(spark, d))))


_PC = ", ".join(
    f"coalesce(max(state) FILTER (WHERE family = '{f}') * 0 + 1, 0) AS {f}_active, coalesce(max(d) FILTER (WHERE family = '{f}'), 0) AS {f}_dir, coalesce(max(state) FILTER (WHERE family = '{f}'), 0) AS {f}_state, max(age) FILTER (WHERE family = '{f}')::INTEGER AS {f}_age, round(max(CASE WHEN d <> 0 THEN d * (line - z.c) ELSE abs(line - z.c) END / nullif(z.atr, 0)) FILTER (WHERE family = '{f}'), 6) AS {f}_dist_atr"
    for f in patterns.FAMILIES
)


@query(f"WITH RECURSIVE {BASE}, {_SHAPES} SELECT z.symbol, z.ts, z.i::INTEGER AS i, {_PC} FROM z LEFT JOIN pat ON pat.symbol = z.symbol AND pat.i = z.i GROUP BY 1, 2, 3")
def pattern_columns(spark, d):
    return shown(patterns.pattern_columns(indicators.atr(hourly(spark, d))))


# ---- zones: one step for each bar, over the list of all zones there have been -------------------------------------------
_Z = "p DOUBLE, t DOUBLE, b BIGINT, e BIGINT, m INTEGER, ho INTEGER, th INTEGER, fl INTEGER, rt BOOLEAN, fr BIGINT, re BIGINT, ti BIGINT, sd INTEGER, ta DOUBLE, dp DOUBLE, pr INTEGER, fd BOOLEAN, ir BOOLEAN, ap VARCHAR"
_T = "p DOUBLE, b BIGINT, i BIGINT, rz BIGINT, kind VARCHAR, sd INTEGER, dp DOUBLE, pr INTEGER, fd BOOLEAN, ir BOOLEAN, ap VARCHAR"


def _zone(x: str, **new: str) -> str:
    """A zone as SQL, with some fields changed."""
    return "{" + ", ".join(f"'{k}': {new.get(k) or f'{x}.{k}'}" for k in (f.split()[0] for f in _Z.split(", "))) + "}"


def _leveled(zs: str, k: int) -> str:
    """The zones after the k-th level of a bar."""
    lv = f"lv[{k}]"
    near = f"list_min(list_transform(list_filter(list_transform({zs}, lambda x, n: {{'d': abs(x.p - {lv}.p), 'p': x.p, 'n': n, 'ok': x.e >= i AND x.th < 4 AND abs(x.p - {lv}.p) <= greatest({lv}.t, x.t)}}), lambda y: y.ok), lambda y: {{'d': y.d, 'p': y.p, 'n': y.n}}))"
    fresh = _zone("x", p=f"{lv}.p", t=f"{lv}.t", b="i", e="i + 200", m="1", ho="0", th="0", fl="0", rt="false", fr="0", re="NULL", ti="NULL", sd="NULL", ta="NULL", dp="NULL", pr="NULL", fd="NULL", ir="NULL", ap="NULL")
    return f"CASE WHEN {lv} IS NULL THEN {zs} WHEN {near} IS NULL THEN list_append({zs}, {fresh}::STRUCT({_Z})) ELSE list_transform({zs}, lambda x, n: CASE WHEN n = {near}.n THEN {_zone('x', m='x.m + 1', e='greatest(x.e, i + 200)')}::STRUCT({_Z}) ELSE x END) END"


_ALIVE = "x.ti IS NOT NULL OR (x.th < 4 AND x.e >= i)"
_KIND = "CASE y.r WHEN 's' THEN 'stall' WHEN 'b' THEN CASE WHEN y.x.rt THEN 'retest_fail' ELSE 'break' END ELSE CASE WHEN y.x.rt THEN 'retest_hold' WHEN y.d >= y.x.t THEN 'sweep' ELSE 'rejection' END END"
#: From zin (symbol, price, tol, known_i; at most two a bar) and z: zo, the zones, and zt, their touches.
_ZONES = f"""zb0 AS (SELECT *, lag(atr) OVER w AS pa, lag(c, 4) OVER w - lag(c) OVER w AS travel, list(c) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING) AS past, greatest(h - l, 0) AS sp FROM z WINDOW w AS (PARTITION BY symbol ORDER BY i)),
zb1 AS (SELECT *, coalesce(abs(c - o) >= 1.5 * pa AND c > o AND c >= h - 0.25 * sp, false) AS iu, coalesce(abs(c - o) >= 1.5 * pa AND c < o AND c <= l + 0.25 * sp, false) AS dn FROM zb0),
zb AS (SELECT *, coalesce(lag(dn) OVER w, false) OR coalesce(lag(dn, 2) OVER w, false) AS fell, coalesce(lag(iu) OVER w, false) OR coalesce(lag(iu, 2) OVER w, false) AS rose FROM zb1 WINDOW w AS (PARTITION BY symbol ORDER BY i)),
zv AS (SELECT symbol, known_i AS i, list({{'p': price, 't': tol}} ORDER BY price) AS lv FROM zin GROUP BY 1, 2),
zi AS MATERIALIZED (SELECT zb.*, zv.lv FROM zb LEFT JOIN zv ON zv.symbol = zb.symbol AND zv.i = zb.i),
zr(symbol, i, zs, done, gone) AS (SELECT DISTINCT symbol, -1::BIGINT, []::STRUCT({_Z})[], []::STRUCT({_T})[], []::STRUCT({_Z})[] FROM z
  UNION ALL SELECT symbol, i, list_filter(l2, lambda x: {_ALIVE}), done, list_filter(l2, lambda x: NOT ({_ALIVE})) FROM (SELECT symbol, i, {_leveled('l1', 2)} AS l2, done FROM (SELECT *, {_leveled('s4', 1)} AS l1 FROM (
    SELECT *, list_transform(list_filter(s3, lambda y: y.r IS NOT NULL), lambda y: {{'p': y.x.p, 'b': y.x.b, 'i': y.x.ti, 'rz': CASE WHEN y.r <> 's' THEN i END, 'kind': {_KIND}, 'sd': y.x.sd, 'dp': y.d, 'pr': y.x.pr, 'fd': y.x.fd, 'ir': y.x.ir, 'ap': y.x.ap}}::STRUCT({_T})) AS done,
      list_transform(s3, lambda y: {_zone('y.x', ho="y.x.ho + coalesce(y.r = 'h', false)::INTEGER", th="y.x.th + coalesce(y.r = 'b', false)::INTEGER", fl="y.x.fl + coalesce(y.r = 'h' AND y.x.rt, false)::INTEGER", rt="CASE y.r WHEN 'b' THEN true WHEN 'h' THEN false ELSE y.x.rt END", fr='CASE WHEN y.r IS NULL THEN y.x.fr ELSE i + 1 END', re="CASE WHEN y.r = 'b' AND y.x.th >= 3 THEN i ELSE y.x.re END", ti='CASE WHEN y.r IS NULL THEN y.x.ti END', dp='y.d')}::STRUCT({_Z})) AS s4
    FROM (SELECT *, list_transform(s2, lambda x: {{'x': x, 'd': greatest(x.dp, x.sd * (x.p - CASE WHEN x.sd > 0 THEN l ELSE h END)),
        'r': CASE WHEN x.ti IS NULL THEN NULL WHEN x.sd * (c - x.p) < -x.t THEN 'b' WHEN i > x.ti AND x.sd * (CASE WHEN x.sd > 0 THEN h ELSE l END - x.p) >= x.ta THEN 'h' WHEN i >= x.ti + 16 THEN 's' END}}) AS s3
      FROM (SELECT *, list_transform(s1, lambda y: CASE WHEN y.s IS NULL THEN y.x ELSE {_zone('y.x', ti='i', sd='y.s', ta='pa', dp='0', pr='y.x.ho', fd='y.x.fl > 0', ir='y.x.rt', ap="CASE WHEN CASE WHEN y.s > 0 THEN fell ELSE rose END OR coalesce(y.s * travel >= 2 * pa, false) THEN 'impulse' ELSE 'drift' END")}::STRUCT({_Z}) END) AS s2
        FROM (SELECT zi.*, list_transform(zr.zs, lambda x: {{'x': x, 's': CASE WHEN x.ti IS NULL AND zi.i >= x.fr AND zi.i < x.e AND x.th < 4 AND zi.l <= x.p + x.t AND zi.h >= x.p - x.t AND zi.pa > 0 THEN list_last(list_transform(list_filter(zi.past, lambda v: abs(v - x.p) > x.t), lambda v: CASE WHEN v > x.p THEN 1 ELSE -1 END)) END}}) AS s1
          FROM zr JOIN zi ON zi.symbol = zr.symbol AND zi.i = zr.i + 1))))))),
zf AS (SELECT symbol, unnest(gone, recursive := true) FROM zr UNION ALL SELECT symbol, unnest(zs, recursive := true) FROM (SELECT symbol, arg_max(zs, i) AS zs FROM zr GROUP BY symbol)),
zo AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY b, p) - 1 AS zone FROM zf),
zu AS (SELECT symbol, unnest(done, recursive := true) FROM zr UNION ALL SELECT symbol, p, b, ti, NULL, 'in_progress', sd, dp, pr, fd, ir, ap FROM zf WHERE ti IS NOT NULL),
zt AS (SELECT zu.*, zo.zone FROM zu JOIN zo ON zo.symbol = zu.symbol AND zo.b = zu.b AND zo.p = zu.p)"""


@query(
    f"""WITH RECURSIVE {BASE}, zin AS (SELECT symbol, price, 8.0::DOUBLE AS tol, known_i FROM lv), {_ZONES}
    SELECT symbol, zone::INTEGER AS zone, round(p, 6) AS price, t AS tol, m AS members, b::INTEGER AS known_i, e::INTEGER AS expires_i, re::INTEGER AS retired_i, ho AS holds, th AS through, fl AS flips FROM zo"""
)
def zones(spark, d):
    b = hourly(spark, d)
    lv = _levels(b).select("symbol", "price", F.lit(8.0).alias("tol"), "known_i")
    return shown(zone_rules.zones(indicators.atr(b), lv).drop("frames"))


_AFTER = "zm AS (SELECT symbol, i, max(h) OVER w AS top, min(l) OVER w AS low FROM z WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 16 FOLLOWING))"


@query(
    f"""WITH RECURSIVE {BASE}, zin AS (SELECT symbol, p AS price, atr * 0.25 AS tol, known_i FROM sw WHERE atr IS NOT NULL), {_ZONES}, {_AFTER},
    zx AS (SELECT zt.*, CASE WHEN kind IN ('rejection', 'sweep', 'retest_hold') THEN i WHEN kind IN ('break', 'retest_fail') THEN rz END AS f, (sd > 0) = (kind IN ('rejection', 'sweep', 'retest_hold')) AS up FROM zt)
    SELECT zx.symbol, zone::INTEGER AS zone, zx.i::INTEGER AS i, rz::INTEGER AS resolved_i, kind, sd AS side, round(dp, 6) AS depth, pr AS prior_holds, fd AS flipped, ir AS is_retest, ap AS approach, round(CASE WHEN up THEN top - p ELSE p - low END, 6) AS follow
    FROM zx LEFT JOIN zm ON zm.symbol = zx.symbol AND zm.i = zx.f"""
)
def zone_reactions(spark, d):
    return shown(_touches(spark, d), "symbol", "zone", "i", "resolved_i", "kind", "side", "depth", "prior_holds", "flipped", "is_retest", "approach", "follow")


@query(
    f"""WITH RECURSIVE {BASE}, zin AS (SELECT symbol, p AS price, atr * 0.25 AS tol, known_i FROM sw WHERE atr IS NOT NULL), {_ZONES}
    SELECT symbol, b::INTEGER AS known_i, round(p, 6) AS price, i::INTEGER AS i, rz::INTEGER AS resolved_i, kind, sd AS side, round(dp, 6) AS depth, pr AS prior_holds, ap AS approach FROM zt WHERE kind <> 'in_progress'"""
)
def stream_zone_touches(spark, d):
    """The same touches from a stream of bars and levels in four batches, by a state for each zone."""
    lv = _confirmed(spark, d).where("atr is not null").select("symbol", "price", (F.col("atr") * 0.25).alias("tol"), "known_i")
    rows = checkpointed(zone_rules.machine_rows(indicators.atr(hourly(spark, d)), lv))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    width = (rows.agg(F.max("i")).first()[0] or 0) // 4 + 1
    for k in range(4):
        rows.where(F.floor(F.col("i") / width) == k).coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        touched = live.zone_touches(live.stream_table(spark, f"{folder}/rows", rows.schema))
        q = touched.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    out = spark.read.parquet(f"{folder}/out").where("what = 'touch'")
    return shown(out, "symbol", "known_i", "price", "i", "resolved_i", "kind", "side", "depth", "prior_holds", "approach")


def _touches(spark, d):
    lv = _confirmed(spark, d).where("atr is not null").select("symbol", "price", (F.col("atr") * 0.25).alias("tol"), "known_i")
    return zone_rules.zone_reactions(indicators.atr(hourly(spark, d)), lv)


_HELD = "kind IN ('rejection', 'sweep', 'retest_hold')"
_MET = f"""zin AS (SELECT symbol, p AS price, atr * 0.25 AS tol, known_i FROM sw WHERE atr IS NOT NULL), {_ZONES}, {_AFTER},
zx AS (SELECT zt.*, CASE WHEN {_HELD} THEN zt.i WHEN kind IN ('break', 'retest_fail') THEN rz END AS f, {_HELD} AS held, (sd > 0) = ({_HELD}) AS up FROM zt),
zy AS (SELECT zx.*, CASE WHEN up THEN top - p ELSE p - low END AS follow, CASE WHEN pr < 3 THEN pr::VARCHAR ELSE '3+' END AS prior FROM zx LEFT JOIN zm ON zm.symbol = zx.symbol AND zm.i = zx.f WHERE kind NOT IN ('stall', 'in_progress'))"""


@query(
    f"""WITH RECURSIVE {BASE}, {_MET}, b AS (SELECT 'overall' AS dimension, 'all' AS bucket, held, follow FROM zy UNION ALL SELECT 'prior', prior, held, follow FROM zy UNION ALL SELECT 'approach', ap, held, follow FROM zy UNION ALL SELECT 'flipped', fd::VARCHAR, held, follow FROM zy),
    g AS (SELECT dimension, bucket, count(*) AS n, count(*) FILTER (WHERE held) / count(*) AS p, quantile_cont(follow, 0.5) FILTER (WHERE held) AS mh, quantile_cont(follow, 0.5) FILTER (WHERE NOT held) AS mb FROM b GROUP BY 1, 2), k AS (SELECT *, 1.959964 AS k FROM g),
    v AS (SELECT *, (p + k * k / (2 * n) - k * sqrt(p * (1 - p) / n + k * k / (4 * n * n))) / (1 + k * k / n) AS lo, (p + k * k / (2 * n) + k * sqrt(p * (1 - p) / n + k * k / (4 * n * n))) / (1 + k * k / n) AS hi FROM k)
    SELECT dimension, bucket, n, {r6('p AS p_hold', '1 - p AS p_break', 'lo AS ci_low', 'hi AS ci_high', 'mh AS median_hold', 'mb AS median_break')}, n < 30 AS unreliable, n >= 30 AND (lo > 0.5 OR hi < 0.5) AS clear_of_half FROM v"""
)
def zone_statistics(spark, d):
    """How often touches hold, in all and by what was known as they began."""
    return shown(choices.bucket_stats(_touches(spark, d), {"prior": choices.touches_bucket(F.col("prior_holds")), "approach": F.col("approach"), "flipped": F.col("flipped")}))


@query(
    f"""WITH RECURSIVE {BASE}, zin AS (SELECT symbol, p AS price, atr * 0.25 AS tol, known_i FROM sw WHERE atr IS NOT NULL), {_ZONES}, zn AS (SELECT symbol, max(i) AS n FROM z GROUP BY 1)
    SELECT zo.symbol, zone::INTEGER AS zone, round(least(ho, 5) + 1.5 * least(fl, 3) + 1 + round(2 * exp(-greatest((n - b) / 24, 0) / 3), 2) - 0.75 * th, 2) AS score FROM zo JOIN zn ON zn.symbol = zo.symbol"""
)
def zone_scores(spark, d):
    """Scores of all zones as the data end, a day being 24 bars."""
    bars = indicators.atr(hourly(spark, d))
    lv = _confirmed(spark, d).where("atr is not null").select("symbol", "price", (F.col("atr") * 0.25).alias("tol"), "known_i")
    last = bars.groupBy("symbol").agg((F.count("*") - 1).alias("last_i"))
    found = zone_rules.zones(bars, lv).join(last, "symbol")
    score = choices.zone_score(F.col("holds"), F.col("flips"), F.col("frames"), (F.col("last_i") - F.col("known_i")) / 24, F.col("through"))
    return found.select("symbol", "zone", score.alias("score"))


SEEDS = (1, 2)
_WORLDS = f"""{HOURLY.replace("bars AS", "bars0 AS", 1)}, wa AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars0),
wb AS (SELECT symbol AS own, symbol || '#' || k AS symbol, k, ts, hour(ts) AS hr, ln(o / pc) AS lo, ln(h / pc) AS lh, ln(l / pc) AS ll, ln(c / pc) AS lc, v FROM wa, (VALUES {", ".join(f"({k})" for k in SEEDS)}) q(k) WHERE pc IS NOT NULL),
wc AS (SELECT own, symbol, ts, hr, row_number() OVER (PARTITION BY symbol, hr ORDER BY ts) AS n FROM wb), wd AS (SELECT symbol, hr, lo, lh, ll, lc, v, row_number() OVER (PARTITION BY symbol, hr ORDER BY sha256(k || ':' || epoch_us(ts)), ts) AS n FROM wb),
we AS (SELECT wc.own, wc.symbol, ts, lo, lh, ll, lc, v, sum(lc) OVER (PARTITION BY wc.symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ends FROM wc JOIN wd ON wd.symbol = wc.symbol AND wd.hr = wc.hr AND wd.n = wc.n),
wf AS (SELECT symbol, arg_min(c, ts) AS c0 FROM bars0 GROUP BY 1), wg AS (SELECT we.*, c0 * exp(ends - lc) AS base FROM we JOIN wf ON wf.symbol = we.own),
bars AS (SELECT symbol, ts, o, h, l, c, v FROM bars0 UNION ALL SELECT symbol, ts, base * exp(lo), base * exp(lh), base * exp(ll), base * exp(lc), v FROM wg)"""


@query(
    f"""WITH RECURSIVE {BASE.replace(HOURLY, _WORLDS, 1)}, {_MET}, b AS (SELECT contains(symbol, '#') AS nil, 'overall' AS dimension, 'all' AS bucket, held FROM zy UNION ALL SELECT contains(symbol, '#'), 'prior', prior, held FROM zy UNION ALL SELECT contains(symbol, '#'), 'approach', ap, held FROM zy),
    g AS (SELECT dimension, bucket, count(*) FILTER (WHERE NOT nil) AS n, count(*) FILTER (WHERE NOT nil AND held) AS wins, count(*) FILTER (WHERE nil) AS n0, count(*) FILTER (WHERE nil AND held) AS wins0 FROM b GROUP BY 1, 2), j AS (SELECT *, (wins + wins0) / (n + n0) AS p FROM g WHERE n > 0 AND n0 > 0),
    q AS (SELECT *, (wins / n - wins0 / n0) / nullif(sqrt(p * (1 - p) * (1 / n + 1 / n0)), 0) AS z FROM j) SELECT dimension, bucket, n, wins, n0, wins0, round(z, 6) AS z, coalesce(least(n, n0) >= 30 AND abs(z) > 2.58, false) AS edge FROM q"""
)
def edges_against_null(spark, d):
    """Where zones of the real bars hold more or less often than those that the same rules find in shuffled ones: real bars
    and all worlds pass through the rules at once, and the worlds' touches are pooled."""
    real = hourly(spark, d)
    bars = checkpointed(indicators.atr(real.unionByName(models.shuffled_worlds(real, list(SEEDS)).select(*real.columns))))
    at = bars.withColumn("level_i", F.row_number().over(indicators.by_symbol()) - 1).select("symbol", "level_i", "atr")
    lv = structure.swings_in_turn(bars).join(at, ["symbol", "level_i"]).where("atr is not null").select("symbol", F.col("level").alias("price"), (F.col("atr") * 0.25).alias("tol"), "known_i")
    decided = zone_rules.zone_reactions(bars, lv).where(F.col("kind").isin(*choices.HOLDS, *choices.BREAKS)).withColumn("r", F.when(F.col("kind").isin(*choices.HOLDS), 1.0).otherwise(-1.0))
    sides = {"overall": F.lit("all"), "prior": choices.touches_bucket(F.col("prior_holds")), "approach": F.col("approach")}
    null = F.contains("symbol", F.lit("#"))
    decided = checkpointed(decided)
    return shown(reactions.edges(reactions.breakdown(decided.where(~null), sides), reactions.breakdown(decided.where(null), sides)))


# ---- boxes: swings as a list after each one, what they offer, and the state from bar to bar -----------------------------
def _leg(a: str, b: str) -> str:
    return f"(CASE WHEN {b}.i > {a}.i AND {a}.u > 0 AND abs({b}.p - {a}.p) >= {a}.u * greatest(2.5, 0.5 * ({b}.i - {a}.i)) THEN sign({b}.p - {a}.p) ELSE 0 END)"


BOXES = f"""la AS (SELECT e.symbol, e.ord, e.known_i, s.run AS r, arg_max({{'k': s.kind, 'i': s.li, 'p': s.p, 'u': s.atr}}, s.ord) AS x FROM sw e JOIN sw s ON s.symbol = e.symbol AND s.ord <= e.ord AND s.run > e.run - 9 GROUP BY ALL),
lb AS (SELECT symbol, ord, known_i, list(x ORDER BY r) AS xs FROM la GROUP BY ALL), lc AS (SELECT symbol, known_i, arg_max(xs, ord) AS xs FROM lb GROUP BY ALL),
ba AS (SELECT z.symbol, z.ts, z.i, z.o, z.h, z.l, z.c, z.atr, lc.xs, lc.known_i = z.i AS changed FROM z ASOF LEFT JOIN lc ON lc.symbol = z.symbol AND z.i >= lc.known_i),
bb AS (SELECT *, CASE WHEN len(xs) >= 3 AND {_leg('xs[greatest(len(xs) - 3, 1)]', 'xs[greatest(len(xs) - 3, 1) + 1]')} <> 0 THEN xs[greatest(len(xs) - 3, 1) + 1:] ELSE xs[greatest(len(xs) - 3, 1):] END AS own FROM ba),
bc AS (SELECT *, list_transform(list_filter(own, lambda x: x.k = 'H'), lambda x: x.p) AS hs, list_transform(list_filter(own, lambda x: x.k = 'L'), lambda x: x.p) AS ls FROM bb),
bd AS (SELECT *, coalesce(len(own) >= 3 AND atr IS NOT NULL AND NOT coalesce(len(own) = 4 AND (hs[2] - hs[1]) * (ls[2] - ls[1]) > 0, false) AND list_max(hs) - list_min(ls) >= 0.75 * atr, false) AS offers FROM bc),
be AS (SELECT *, CASE WHEN changed OR offers THEN coalesce(list_last(list_filter(list_transform(range(1, len(xs)), lambda k: CASE WHEN offers AND xs[k + 1].i > own[1].i THEN 0 ELSE {_leg('xs[k]', 'xs[k + 1]')} END), lambda v: v <> 0)), 0) END AS lead_new FROM bd),
bf AS (SELECT symbol, ts, i, o, h, l, c, atr, coalesce(last_value(lead_new IGNORE NULLS) OVER w, 0) AS lead, coalesce(lag(offers) OVER w, false) AS off, lag(list_max(hs)) OVER w AS ot, lag(list_min(ls)) OVER w AS ob, lag(own[1].i) OVER w AS os, coalesce(0.1 * lag(atr) OVER w, 0) AS tol FROM be WINDOW w AS (PARTITION BY symbol ORDER BY i)),
bx(symbol, i, top, bottom, start_i, status, since, episode, cnt) AS (SELECT symbol, 0, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, 'none', 0, -1, 0 FROM bf WHERE i = 0
  UNION ALL SELECT symbol, i, CASE WHEN gone THEN NULL ELSE t1 END, CASE WHEN gone THEN NULL ELSE b1 END, CASE WHEN gone THEN NULL ELSE s1 END, CASE WHEN gone THEN 'none' WHEN t1 IS NULL THEN st1 ELSE place END, CASE WHEN place <> st1 THEN i ELSE since END, CASE WHEN gone THEN -1 ELSE ep1 END, cnt1
  FROM (SELECT *, coalesce(place = st1 AND st1 <> 'inside' AND i - since >= 24, false) AS gone FROM (SELECT *, CASE WHEN t1 IS NULL THEN NULL WHEN c > t1 + tol THEN 'up' WHEN c < b1 - tol THEN 'down' ELSE 'inside' END AS place
    FROM (SELECT symbol, i, c, tol, since, CASE WHEN took THEN ot ELSE top END AS t1, CASE WHEN took THEN ob ELSE bottom END AS b1, CASE WHEN took THEN os ELSE start_i END AS s1, CASE WHEN took THEN 'inside' ELSE status END AS st1, CASE WHEN took AND status = 'none' THEN cnt ELSE episode END AS ep1, CASE WHEN took AND status = 'none' THEN cnt + 1 ELSE cnt END AS cnt1
      FROM (SELECT bf.symbol, bf.i, bf.c, bf.tol, bf.ot, bf.ob, bf.os, bx.top, bx.bottom, bx.start_i, bx.status, bx.since, bx.episode, bx.cnt, bf.off AND bx.status IN ('none', 'inside') AS took FROM bx JOIN bf ON bf.symbol = bx.symbol AND bf.i = bx.i + 1))))),
st AS (SELECT bf.*, bx.top, bx.bottom, bx.start_i, bx.status, bx.episode FROM bf JOIN bx ON bx.symbol = bf.symbol AND bx.i = bf.i)"""


def _states(spark, d):
    bars = indicators.atr(hourly(spark, d))
    return structure.box_states(bars), bars


@query(f"WITH RECURSIVE {BASE}, {BOXES} SELECT symbol, ts, i::INTEGER AS i, {r6('top AS top', 'bottom AS bottom')}, start_i::INTEGER AS start_i, status, episode::INTEGER AS episode, lead::INTEGER AS lead FROM st")
def box_states(spark, d):
    return shown(_states(spark, d)[0])


BREAKS = """ka AS (SELECT *, lag(status, 1, 'none') OVER w AS was, lag(lead, 1, 0) OVER w AS lead_before, lag(atr) OVER w AS pa FROM st WINDOW w AS (PARTITION BY symbol ORDER BY i)),
kb AS (SELECT *, first_value(lead_before) OVER (PARTITION BY symbol, episode ORDER BY i) AS lead0 FROM ka), kc AS (SELECT *, lead(status) OVER w AS then_, lead(i) OVER w AS then_i FROM kb WHERE status <> was WINDOW w AS (PARTITION BY symbol ORDER BY i)),
br AS (SELECT symbol, i, CASE status WHEN 'up' THEN 1 ELSE -1 END AS side, top, bottom, start_i, CASE status WHEN 'up' THEN top ELSE bottom END AS edge, episode, row_number() OVER (PARTITION BY symbol, episode, status ORDER BY i) AS attempt, lead0 AS lead, CASE WHEN pa > 0 THEN abs(c - o) / pa END AS body_atr, CASE WHEN then_ <> 'none' THEN then_i END AS back_i FROM kc WHERE status IN ('up', 'down'))"""


@query(f"WITH RECURSIVE {BASE}, {BOXES}, {BREAKS} SELECT symbol, i::INTEGER AS i, side, {r6('top AS top', 'bottom AS bottom', 'edge AS edge', 'body_atr AS body_atr')}, start_i::INTEGER AS start_i, episode::INTEGER AS episode, attempt::INTEGER AS attempt, lead::INTEGER AS lead, back_i::INTEGER AS back_i FROM br")
def box_breaks(spark, d):
    return shown(structure.box_breaks(*_states(spark, d)))


def _first_in(name: str, cond: str, start: str, span: str) -> str:
    return f"(SELECT min(y.i) FROM z y WHERE y.symbol = x.symbol AND y.i > {start} AND y.i <= {start} + {span} AND {cond}) AS {name}"


_BOXEV = f"""xa AS (SELECT st.symbol, st.i, st.h, st.l, st.c, lag(st.top) OVER w AS top, lag(st.bottom) OVER w AS bottom, lag(st.status) OVER w AS ps, lag(st.atr) OVER w AS a, lag(st.h) OVER w AS ph, lag(st.l) OVER w AS pl FROM st WINDOW w AS (PARTITION BY symbol ORDER BY i)),
xb AS (SELECT *, unnest([1, -1]) AS s FROM xa WHERE i >= 2 AND ps = 'inside' AND a > 0),
xx AS (SELECT symbol, i, s, a, s * c AS cl, CASE s WHEN 1 THEN h ELSE -l END AS reach, CASE s WHEN 1 THEN ph ELSE -pl END AS was, CASE s WHEN 1 THEN top ELSE -bottom END AS edge, CASE s WHEN 1 THEN bottom ELSE -top END AS opp, s * (top + bottom) / 2 AS mid, 0.1 * a AS tol, least(0.25 * a, 0.3 * (top - bottom)) AS width FROM xb),
xf AS (SELECT *, {_first_in('t_p', 'CASE x.s WHEN 1 THEN y.h ELSE -y.l END >= x.cl + 30', 'x.i', '48')}, {_first_in('t_a', 'CASE x.s WHEN 1 THEN y.h ELSE -y.l END >= x.cl + x.a', 'x.i', '48')}, {_first_in('t_back', 'x.s * y.c - x.edge <= 0', 'x.i', '48')},
  {_first_in('t_mid', 'CASE x.s WHEN 1 THEN y.l ELSE -y.h END - x.mid <= 0', 'x.i', '48')}, {_first_in('t_opp', 'CASE x.s WHEN 1 THEN y.l ELSE -y.h END - x.opp <= 0', 'x.i', '48')}, {_first_in('t_wick', 'x.s * y.c - x.reach > 0', 'x.i', '48')}, {_first_in('t_edge', 'x.s * y.c - x.edge > x.tol', 'x.i', '48')} FROM xx x),
xe AS (SELECT symbol, i, s AS side, 'break_continues_target' AS kind, CASE WHEN t_p IS NOT NULL AND (t_back IS NULL OR t_p <= t_back) THEN 1 WHEN t_back IS NOT NULL THEN 0 END AS outcome FROM xf WHERE cl - edge > tol
  UNION ALL SELECT symbol, i, s, 'break_continues_1atr', CASE WHEN t_a IS NOT NULL AND (t_back IS NULL OR t_a <= t_back) THEN 1 WHEN t_back IS NOT NULL THEN 0 END FROM xf WHERE cl - edge > tol
  UNION ALL SELECT symbol, i, s, 'sweep_to_mid', CASE WHEN t_mid IS NOT NULL AND (t_wick IS NULL OR t_mid < t_wick) THEN 1 WHEN t_wick IS NOT NULL THEN 0 END FROM xf WHERE cl - edge <= tol AND reach - edge > tol
  UNION ALL SELECT symbol, i, s, 'sweep_to_opposite_edge', CASE WHEN t_opp IS NOT NULL AND (t_wick IS NULL OR t_opp < t_wick) THEN 1 WHEN t_wick IS NOT NULL THEN 0 END FROM xf WHERE cl - edge <= tol AND reach - edge > tol
  UNION ALL SELECT symbol, i, s, 'edge_fade_to_mid', CASE WHEN t_mid IS NOT NULL AND (t_edge IS NULL OR t_mid < t_edge) THEN 1 WHEN t_edge IS NOT NULL THEN 0 END FROM xf WHERE cl - edge <= tol AND reach >= edge - width AND NOT was >= edge - width)"""


@query(f"WITH RECURSIVE {BASE}, {BOXES}, {_BOXEV} SELECT symbol, i::INTEGER AS i, side, kind, outcome FROM xe WHERE outcome IS NOT NULL")
def box_events(spark, d):
    return signals.box_events(*_states(spark, d), 30.0)


_FOLLOW = f"""nn AS (SELECT symbol, count(*) AS n FROM z GROUP BY 1), fa AS (SELECT br.*, nn.n, zi.atr AS u, zb.atr AS ub, br.side AS s, br.side * br.edge AS e, CASE br.side WHEN 1 THEN br.bottom ELSE -br.top END AS opp, br.side * (br.top + br.bottom) / 2 AS mid
  FROM br JOIN nn ON nn.symbol = br.symbol JOIN z zi ON zi.symbol = br.symbol AND zi.i = br.i LEFT JOIN z zb ON zb.symbol = br.symbol AND zb.i = br.back_i),
xx AS (SELECT *, CASE WHEN i + 3 < n THEN coalesce(back_i - i <= 3, false) END AS fakeout, 0.1 * coalesce(ub, 0) AS tb, 0.1 * coalesce(u, 0) AS tu FROM fa),
fb AS (SELECT *, {_first_in('j_other', 'x.s * y.c - x.opp < -x.tb', 'x.back_i - 1', '49')}, {_first_in('j_same', 'x.s * y.c - x.e > x.tb', 'x.back_i', '48')}, {_first_in('j_mid', 'CASE x.s WHEN 1 THEN y.l ELSE -y.h END - x.mid <= 0', 'x.back_i - 1', '49')}, {_first_in('j_opp', 'CASE x.s WHEN 1 THEN y.l ELSE -y.h END - x.opp <= 0', 'x.back_i - 1', '49')},
  (SELECT max(greatest(x.e - CASE x.s WHEN 1 THEN y.l ELSE -y.h END, 0)) FROM z y WHERE y.symbol = x.symbol AND y.i > x.i AND y.i <= least(x.i + 24, coalesce(x.back_i - 1, x.i + 24)) AND CASE x.s WHEN 1 THEN y.l ELSE -y.h END - x.e <= x.tu) AS depth FROM xx x),
fc AS (SELECT *, coalesce(least(j_other, j_same), back_i + 48) AS j_end FROM fb),
fk AS (SELECT symbol, i, side, lead, attempt, body_atr, fakeout, CASE WHEN fakeout THEN coalesce(j_mid <= j_end, false) END AS reached_mid, CASE WHEN fakeout THEN coalesce(j_opp <= j_end, false) END AS reached_opposite_edge, CASE WHEN fakeout THEN j_other IS NOT NULL AND (j_same IS NULL OR j_other <= j_same) END AS broke_opposite_side,
  CASE WHEN fakeout THEN j_same IS NOT NULL AND (j_other IS NULL OR j_same < j_other) END AS broke_same_side, CASE WHEN fakeout THEN back_i + 48 < n END AS complete, CASE WHEN NOT fakeout AND i + 24 < n THEN depth IS NOT NULL END AS retested, CASE WHEN NOT fakeout AND i + 24 < n THEN depth END AS retest_depth FROM fc)"""


def _followed(spark, d):
    states, bars = _states(spark, d)
    return signals.fakeouts(structure.box_breaks(states, bars), bars)


@query(f"WITH RECURSIVE {BASE}, {BOXES}, {BREAKS}, {_FOLLOW} SELECT symbol, i::INTEGER AS i, fakeout, reached_mid, reached_opposite_edge, broke_opposite_side, broke_same_side, complete, retested, round(retest_depth, 6) AS retest_depth FROM fk")
def fakeouts(spark, d):
    return shown(_followed(spark, d), "symbol", "i", "fakeout", "reached_mid", "reached_opposite_edge", "broke_opposite_side", "broke_same_side", "complete", "retested", "retest_depth")


@query(
    f"""WITH RECURSIVE {BASE}, {BOXES}, {BREAKS}, {_FOLLOW}, oe AS (SELECT 'break_is_fakeout' AS kind, fakeout::INTEGER AS outcome FROM fk UNION ALL SELECT 'break_is_fakeout|lead_in=' || CASE WHEN lead = 0 THEN 'no_impulse' WHEN lead = side THEN 'with_impulse' ELSE 'against_impulse' END, fakeout::INTEGER FROM fk
      UNION ALL SELECT 'break_is_fakeout|attempt=' || CASE WHEN attempt = 1 THEN 'first' ELSE 'later' END, fakeout::INTEGER FROM fk UNION ALL SELECT 'break_is_fakeout|body=' || CASE WHEN body_atr >= 1 THEN '>=1 ATR' ELSE '<1 ATR' END, fakeout::INTEGER FROM fk WHERE body_atr IS NOT NULL
      UNION ALL SELECT 'fakeout_reaches_opposite_edge', reached_opposite_edge::INTEGER FROM fk WHERE complete OR reached_opposite_edge UNION ALL SELECT 'fakeout_then_breaks_opposite_side', broke_opposite_side::INTEGER FROM fk WHERE complete OR broke_opposite_side UNION ALL SELECT 'real_break_retests_edge', retested::INTEGER FROM fk)
    SELECT kind, count(*) AS n, sum(outcome)::BIGINT AS wins, round(sum(outcome) / count(*), 6) AS rate FROM oe WHERE outcome IS NOT NULL GROUP BY 1"""
)
def box_odds(spark, d):
    return shown(signals.odds(signals.break_events(_followed(spark, d))), "kind", "n", "wins", "rate")


@query(
    f"""WITH RECURSIVE {BASE}, {BOXES}, lastbox AS (SELECT symbol, arg_max(top, i) AS top, arg_max(bottom, i) AS bottom, arg_max(start_i, i) AS start_i, max(i) AS mi FROM st GROUP BY 1),
    cur AS (SELECT st.symbol, st.top, st.bottom, st.start_i FROM st JOIN lastbox l ON l.symbol = st.symbol AND l.mi = st.i WHERE st.top IS NOT NULL),
    v AS (SELECT z.symbol, z.ts, z.h, z.l, z.c, z.i, coalesce(lag(z.atr) OVER (PARTITION BY z.symbol ORDER BY z.i), z.atr) AS u FROM z), wv AS (SELECT v.*, cur.top, cur.bottom FROM v JOIN cur ON cur.symbol = v.symbol AND v.i >= cur.start_i),
    f AS (SELECT symbol, ts, 'high' AS side, top AS level, h - top AS beyond FROM wv WHERE h - top >= 0.25 * u AND c <= top + 0.1 * u UNION ALL SELECT symbol, ts, 'low', bottom, bottom - l FROM wv WHERE bottom - l >= 0.25 * u AND c >= bottom - 0.1 * u)
    SELECT symbol, ts, side, {r6('level AS level', 'beyond AS beyond')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY beyond DESC, ts, side) AS n FROM f) WHERE n <= 6"""
)
def box_sweeps(spark, d):
    return shown(signals.box_sweeps(*_states(spark, d)))


# ---- signals and trades ----------------------------------------------------------------------------------------------
BOXAT = """pz AS (SELECT a.symbol, a.i, b.i AS m, least(b.o, b.c) AS lo, greatest(b.o, b.c) AS hi FROM z a JOIN z b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 30 AND a.i - 2),
kz AS (SELECT pz.symbol, pz.i, pz.m, pz.lo, pz.hi FROM pz JOIN z x ON x.symbol = pz.symbol AND x.i > pz.m AND x.i <= pz.i GROUP BY ALL HAVING min(x.c) >= pz.lo AND max(x.c) <= pz.hi),
fz AS (SELECT symbol, i, min(m) AS m, arg_min(lo, m) AS lo, arg_min(hi, m) AS hi FROM kz GROUP BY 1, 2),
gz AS (SELECT z.symbol, z.i, z.c, fz.lo, fz.hi, fz.m IS NOT NULL AS b, z.i - fz.m AS n FROM z LEFT JOIN fz ON fz.symbol = z.symbol AND fz.i = z.i),
hz AS (SELECT *, """ + ", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for c in ("b", "lo", "hi", "c", "n") for k in (1, 2, 3)) + """ FROM gz WINDOW w AS (PARTITION BY symbol ORDER BY i)),
sg AS (SELECT symbol, i, CASE event WHEN 'bos_up' THEN 1 ELSE -1 END AS dir, event AS type, level, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM ev WHERE event LIKE 'bos%'
  UNION ALL SELECT symbol, i, CASE WHEN c > hi1 THEN 1 ELSE -1 END, CASE WHEN c > hi1 THEN 'box_breakout_up' ELSE 'box_breakout_down' END, CASE WHEN c > hi1 THEN hi1 ELSE lo1 END, lo1, hi1 FROM hz WHERE i >= 2 AND b1 AND (c > hi1 OR c < lo1)
  UNION ALL SELECT symbol, i, CASE WHEN c1 > hi2 THEN -1 ELSE 1 END, 'failed_breakout', CASE WHEN c1 > hi2 THEN hi2 ELSE lo2 END, lo2, hi2 FROM hz WHERE NOT b AND NOT b1 AND b2 AND c BETWEEN lo2 AND hi2
  UNION ALL SELECT symbol, i, CASE WHEN c2 > hi3 THEN -1 ELSE 1 END, 'failed_breakout', CASE WHEN c2 > hi3 THEN hi3 ELSE lo3 END, lo3, hi3 FROM hz WHERE NOT b AND NOT b1 AND NOT b2 AND b3 AND c BETWEEN lo3 AND hi3 AND NOT c1 BETWEEN lo3 AND hi3),
sm AS (SELECT symbol, i, dir, string_agg(type, ',' ORDER BY type) AS types, arg_min(level, type) AS level, arg_min(lo, type) FILTER (WHERE lo IS NOT NULL) AS lo, arg_min(hi, type) FILTER (WHERE hi IS NOT NULL) AS hi FROM sg GROUP BY 1, 2, 3)"""


@query(f"WITH RECURSIVE {BASE}, {EVENTS}, {BOXAT} SELECT symbol, i::INTEGER AS i, dir, types, {r6('level AS level', 'lo AS box_low', 'hi AS box_high')} FROM sm")
def structure_signals(spark, d):
    out = signals.structure_signals(hourly(spark, d))
    return shown(out.select("symbol", "i", "dir", F.array_join("types", ",").alias("types"), "level", F.col("box.low").alias("box_low"), F.col("box.high").alias("box_high")))


_TRADES = """ta AS (SELECT sm.*, z.c AS entry, z.atr AS a, z.ts FROM sm JOIN z ON z.symbol = sm.symbol AND z.i = sm.i WHERE z.atr > 0),
tb AS (SELECT ta.symbol, ta.i, ta.dir, arg_max(sw.p, sw.ord) AS prot FROM ta JOIN sw ON sw.symbol = ta.symbol AND sw.known_i <= ta.i AND CASE ta.dir WHEN 1 THEN sw.kind = 'L' AND sw.p < ta.entry ELSE sw.kind = 'H' AND sw.p > ta.entry END GROUP BY 1, 2, 3),
tc AS (SELECT ta.*, prot - ta.dir * 0.2 * a AS stop, (entry - (prot - ta.dir * 0.2 * a)) * ta.dir AS risk FROM ta JOIN tb ON tb.symbol = ta.symbol AND tb.i = ta.i AND tb.dir = ta.dir),
td AS (SELECT tc.*, (SELECT count(*) FROM z y WHERE y.symbol = tc.symbol AND y.i > tc.i AND y.i <= tc.i + 24) AS nb, (SELECT min(y.i) FROM z y WHERE y.symbol = tc.symbol AND y.i > tc.i AND y.i <= tc.i + 24 AND CASE tc.dir WHEN 1 THEN y.l <= tc.stop ELSE y.h >= tc.stop END) AS js,
  (SELECT min(y.i) FROM z y WHERE y.symbol = tc.symbol AND y.i > tc.i AND y.i <= tc.i + 24 AND CASE tc.dir WHEN 1 THEN y.h >= tc.entry + tc.risk ELSE y.l <= tc.entry - tc.risk END) AS jt, (SELECT y.c FROM z y WHERE y.symbol = tc.symbol AND y.i = tc.i + 24) AS ce FROM tc WHERE risk > 0 AND risk <= 10 * a),
te AS (SELECT *, CASE WHEN js IS NOT NULL AND (jt IS NULL OR js <= jt) THEN 'loss' WHEN jt IS NOT NULL THEN 'win' WHEN nb = 24 THEN 'timeout' END AS outcome FROM td),
tr AS (SELECT *, CASE outcome WHEN 'loss' THEN -1 WHEN 'win' THEN 1 ELSE (ce - entry) * dir / risk END AS r, CASE outcome WHEN 'loss' THEN js - i WHEN 'win' THEN jt - i ELSE 24 END AS held, (hi - lo) / a AS width FROM te WHERE outcome IS NOT NULL)"""


def _structure_trades(spark, d):
    return signals.structure_trades(indicators.atr(hourly(spark, d)))


@query(f"WITH RECURSIVE {BASE}, {EVENTS}, {BOXAT}, {_TRADES} SELECT symbol, ts, dir, types, {r6('entry AS entry', 'stop AS stop', 'risk AS risk', 'r AS r', 'r - 0.05 AS r_net', 'width AS box_width_atr')}, outcome, held::INTEGER AS bars_held FROM tr")
def structure_trades(spark, d):
    out = _structure_trades(spark, d)
    return shown(out.withColumn("types", F.array_join("types", ",")), "symbol", "ts", "dir", "types", "entry", "stop", "risk", "r", "r_net", "box_width_atr", "outcome", "bars_held")


@query(
    f"""WITH RECURSIVE {BASE}, {EVENTS}, {BOXAT}, {_TRADES}, dm AS (SELECT 'type' AS dimension, unnest(string_split(types, ',')) AS bucket, r FROM tr UNION ALL SELECT 'width', CASE WHEN width IS NULL THEN 'no box' WHEN width < 0.5 THEN '<0.5 ATR' WHEN width < 1 THEN '0.5-1 ATR' WHEN width < 2 THEN '1-2 ATR' ELSE '>=2 ATR' END, r FROM tr UNION ALL SELECT 'direction', CASE dir WHEN 1 THEN 'long' ELSE 'short' END, r FROM tr)
    SELECT dimension, bucket, count(*) AS n, count(*) FILTER (WHERE r > 0) AS wins, round(avg(r), 6) AS mean FROM dm GROUP BY 1, 2"""
)
def structure_breakdown(spark, d):
    t = _structure_trades(spark, d)
    out = reactions.breakdown(t, {"type": F.col("types"), "width": signals.width_bucket(F.col("box_width_atr")), "direction": F.when(F.col("dir") > 0, "long").otherwise("short")})
    return shown(out, "dimension", "bucket", "n", "wins", "mean")


@query(f"WITH RECURSIVE {BASE}, {EVENTS} SELECT z.symbol, z.ts, count(*) FILTER (WHERE event = 'sweep_high') AS sweep_high, count(*) FILTER (WHERE event = 'sweep_low') AS sweep_low FROM z LEFT JOIN ev ON ev.symbol = z.symbol AND ev.i BETWEEN z.i - 5 AND z.i GROUP BY 1, 2")
def sweep_counts(spark, d):
    return shown(signals.sweep_counts(hourly(spark, d)))


_RETESTS = """zz AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY i) AS pc FROM z),
rb AS (SELECT lv.symbol, level_id, price, kind, min(zz.i) AS break_i FROM lv JOIN zz ON zz.symbol = lv.symbol AND zz.i > known_i AND CASE WHEN kind = 'H' THEN zz.c > price AND zz.pc <= price ELSE zz.c < price AND zz.pc >= price END GROUP BY ALL),
rt AS (SELECT rb.symbol, level_id, price, rb.kind, z.i, CASE WHEN kind = 'H' THEN l - price ELSE price - h END AS near, CASE WHEN kind = 'H' THEN c > price ELSE c < price END AS good FROM rb JOIN z ON z.symbol = rb.symbol AND z.i > break_i AND z.i <= break_i + 48),
rg AS (SELECT symbol, level_id, price, CASE kind WHEN 'H' THEN 1 ELSE -1 END AS dir, min(i) AS touch_i, min(i) FILTER (WHERE near <= 0) AS fill_i, arg_min(good, i) AS rejected FROM rt WHERE near <= 5 GROUP BY ALL),
rw AS (SELECT symbol, level_id, dir, price, touch_i, 'touch' AS entry_kind, fill_i AS s, 1 AS skip FROM rg WHERE fill_i IS NOT NULL UNION ALL SELECT symbol, level_id, dir, price, touch_i, k, touch_i + 1, 0 FROM rg, (SELECT unnest(['reject_close', 'next_open']) AS k) WHERE rejected),
ro AS (SELECT *, row_number() OVER (PARTITION BY symbol, entry_kind, s, dir ORDER BY touch_i, level_id) AS n FROM rw),
rx AS (SELECT ro.*, CASE entry_kind WHEN 'touch' THEN price WHEN 'reject_close' THEN zz.pc ELSE zz.o END AS entry FROM ro JOIN zz ON zz.symbol = ro.symbol AND zz.i = ro.s WHERE n = 1)"""


def _retest_sim(stop: str, target: str) -> str:
    return f"""(SELECT rx.*, g.stop, g.target, (SELECT count(*) FROM z y WHERE y.symbol = rx.symbol AND y.i >= rx.s AND y.i < rx.s + 24) AS nb, (SELECT min(y.i) FROM z y WHERE y.symbol = rx.symbol AND y.i >= rx.s AND y.i < rx.s + 24 AND CASE rx.dir WHEN 1 THEN y.l <= rx.entry - {stop} ELSE y.h >= rx.entry + {stop} END) AS js,
    (SELECT min(y.i) FROM z y WHERE y.symbol = rx.symbol AND y.i >= rx.s + rx.skip AND y.i < rx.s + 24 AND CASE rx.dir WHEN 1 THEN y.h >= rx.entry + {target} ELSE y.l <= rx.entry - {target} END) AS jt, (SELECT y.c FROM z y WHERE y.symbol = rx.symbol AND y.i = rx.s + 23) AS ce FROM rx, grid g)"""


_RTR = f"""rs AS {_retest_sim('g.stop', 'g.target')}, rz AS (SELECT *, CASE WHEN js IS NOT NULL AND (jt IS NULL OR js <= jt) THEN 'loss' WHEN jt IS NOT NULL THEN 'win' WHEN nb = 24 THEN 'timeout' END AS outcome FROM rs),
rr AS (SELECT symbol, entry_kind, s, dir, entry, stop, target, outcome, CASE outcome WHEN 'loss' THEN -stop WHEN 'win' THEN target ELSE (ce - entry) * dir END - 2 AS move FROM rz WHERE outcome IS NOT NULL)"""


def _retested(spark, d):
    b = hourly(spark, d)
    lv = _levels(b)
    kinds = lv.select("symbol", "level_id", F.when(F.col("kind") == "H", 1).otherwise(-1).alias("dir"))
    return b, structure.retests(b, lv, 5.0, 48).join(kinds, ["symbol", "level_id"])


@query(f"WITH RECURSIVE {BASE}, grid AS (SELECT 60.0::DOUBLE AS stop, 120.0::DOUBLE AS target), {_RETESTS}, {_RTR} SELECT symbol, entry_kind, s::INTEGER AS start_i, dir, {r6('entry AS entry', 'move AS move')}, outcome FROM rr")
def retest_trades(spark, d):
    b, found = _retested(spark, d)
    return shown(signals.retest_trades(b, found, 60.0, 120.0, 2.0, 24), "symbol", "entry_kind", "start_i", "dir", "entry", "move", "outcome")


@query(
    f"""WITH RECURSIVE {BASE}, grid AS (SELECT 60.0::DOUBLE AS stop, 120.0::DOUBLE AS target), {_RETESTS}, {_RTR}, g AS (SELECT symbol, entry_kind, count(*) AS n, count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'loss') AS losses, avg(move) AS e, sum(move) AS total, sum(move) FILTER (WHERE move > 0) / sum(-move) FILTER (WHERE move < 0) AS pf FROM rr GROUP BY 1, 2),
    wv AS (SELECT *, wins / n AS p, 1.959964 AS k FROM g), v AS (SELECT *, (p + k * k / (2 * n) - k * sqrt(p * (1 - p) / n + k * k / (4 * n * n))) / (1 + k * k / n) AS low FROM wv)
    SELECT symbol, entry_kind, n, wins, losses, {r6('p AS win_rate', 'greatest(low, 0) AS ci_low', '62.0::DOUBLE / 180 AS breakeven', 'e AS expectancy', 'e / 60 AS expectancy_r', 'pf AS profit_factor', 'total AS total')}, CASE WHEN n < 100 THEN 'insufficient data' WHEN low > 62.0 / 180 AND e > 0 THEN 'edge' ELSE 'no proven edge' END AS verdict FROM v"""
)
def retest_summary(spark, d):
    b, found = _retested(spark, d)
    out = signals.summarize_moves(signals.retest_trades(b, found, 60.0, 120.0, 2.0, 24), ["symbol", "entry_kind"], 60.0, 120.0, 2.0)
    return shown(out, "symbol", "entry_kind", "n", "wins", "losses", "win_rate", "ci_low", "breakeven", "expectancy", "expectancy_r", "profit_factor", "total", "verdict")


@query(
    f"""WITH RECURSIVE {BASE}, grid AS (SELECT unnest([40.0::DOUBLE, 80.0, 160.0]) AS stop, target FROM (SELECT unnest([80.0::DOUBLE, 160.0]) AS target)), {_RETESTS}, {_RTR}, c AS (SELECT stop, target, count(*) AS n, avg(move) AS expectancy FROM rr WHERE entry_kind = 'reject_close' GROUP BY 1, 2 HAVING count(*) >= 50)
    SELECT stop, target, n, round(expectancy, 6) AS expectancy FROM c ORDER BY expectancy DESC, stop, target LIMIT 1"""
)
def best_grid_cell(spark, d):
    b, found = _retested(spark, d)
    trades = signals.retest_grid(b, found, [40.0, 80.0, 160.0], [80.0, 160.0], 2.0, 24).where("entry_kind = 'reject_close'")
    cells = trades.groupBy(F.lit(0).alias("all"), "stop", "target").agg(F.count("*").alias("n"), F.avg("move").alias("expectancy"))
    return shown(signals.best_cell(cells, ["all"]).drop("all"))
