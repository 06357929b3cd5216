"""Queries over carried state, labels, chosen series, hybrid recall, exports and schedule pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import asof, bars, choices, indicators, matrix, retrieval, structure
from ..operators import zones as zone_rules
from ..session import shared_folder, table
from ..sources import candles, documents, events, exports
from ..streaming import live
from .common import DAILY, HOURLY, daily, event_ticks, hourly, r6, shown
from .decisions import VEC, _bm25, _queries, _texts
from .market import ATR, LEVELS, OHLC, SEL, _levels
from .structures import BASE, BOXES, BREAKS, LEG, _ZONES, _confirmed, _states

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    f"""WITH RECURSIVE {BASE}, {BOXES}, {BREAKS}, sv AS (SELECT *, lag(top) OVER w AS pt, lag(bottom) OVER w AS pb, lag(status) OVER w = 'inside' AS pin FROM st WINDOW w AS (PARTITION BY symbol ORDER BY i)),
    fl AS (SELECT sv.*, coalesce(pin AND h > pt + tol AND sv.c <= pt + tol, false)::INTEGER AS ua, coalesce(pin AND l < pb - tol AND sv.c >= pb - tol, false)::INTEGER AS ub, (SELECT count(*) FROM br WHERE br.symbol = sv.symbol AND br.back_i = sv.i AND br.back_i - br.i <= 3 AND br.side = 1) AS fa, (SELECT count(*) FROM br WHERE br.symbol = sv.symbol AND br.back_i = sv.i AND br.back_i - br.i <= 3 AND br.side = -1) AS fb FROM sv)
    SELECT symbol, ts, {', '.join(f'CASE WHEN episode >= 0 THEN sum({a}) OVER e ELSE 0 END::BIGINT AS {b}' for a, b in (('ua', 'sweeps_above'), ('ub', 'sweeps_below'), ('fa', 'fakeouts_above'), ('fb', 'fakeouts_below')))} FROM fl WINDOW e AS (PARTITION BY symbol, episode ORDER BY i ROWS UNBOUNDED PRECEDING)"""
)
def episode_counts(spark, d):
    states, b = _states(spark, d)
    return shown(matrix.episode_counts(states, structure.box_breaks(states, b), b).drop("i"))


@query(f"WITH RECURSIVE {BASE}, {BOXES}, {BREAKS} SELECT z.symbol, z.ts, coalesce(br.side, 0) AS brk_dir, (z.i - br.i)::INTEGER AS brk_age, round(br.edge, 6) AS brk_edge FROM z ASOF LEFT JOIN br ON br.symbol = z.symbol AND z.i >= br.i")
def break_carry(spark, d):
    states, b = _states(spark, d)
    return shown(matrix.break_carry(b, structure.box_breaks(states, b)))


_AHEAD = "FROM z y WHERE y.symbol = hx.symbol AND y.i > hx.i AND y.i <= hx.i + 48"


@query(
    f"""WITH RECURSIVE {BASE}, {BOXES}, {BREAKS}, nz AS (SELECT symbol, count(*) AS nn FROM z GROUP BY 1), he AS (SELECT br.symbol, br.i AS break_i, br.side, br.side * br.edge AS e, br.back_i, unnest(range(br.i, least(br.i + 3, coalesce(br.back_i - 1, br.i + 3)) + 1)) AS i FROM br),
    hx AS (SELECT he.*, nz.nn, 0.1 * coalesce(z.atr, 0) AS tol FROM he JOIN nz ON nz.symbol = he.symbol JOIN z ON z.symbol = he.symbol AND z.i = he.i),
    hy AS (SELECT hx.*, (SELECT min(y.i) {_AHEAD} AND hx.side * y.c - hx.e <= 0) AS jc, (SELECT min(y.i) {_AHEAD} AND CASE hx.side WHEN 1 THEN y.l ELSE -y.h END - hx.e <= hx.tol) AS jt, (SELECT list(y.i) {_AHEAD} AND CASE hx.side WHEN 1 THEN y.h ELSE -y.l END - hx.e >= 30) AS runs FROM hx)
    SELECT symbol, i::INTEGER AS i, break_i::INTEGER AS break_i, CASE WHEN i = break_i THEN CASE WHEN back_i - break_i <= 3 THEN 1 WHEN break_i + 3 < nn THEN 0 END END AS fakeout, CASE WHEN i + 48 < nn THEN coalesce(len(list_filter(runs, lambda k: k > jt AND (jc IS NULL OR k < jc))) > 0, false)::INTEGER END AS retest_then_continue FROM hy"""
)
def break_labels(spark, d):
    states, b = _states(spark, d)
    return matrix.break_labels(b, structure.box_breaks(states, b), 30.0)


@query(
    f"""WITH RECURSIVE {BASE}, {LEG}, im AS (SELECT *, q - p AS move FROM leg WHERE to_i IS NOT NULL AND abs(q - p) >= 2.5 * atr AND abs(q - p) / nullif(to_i - swing_i, 0) >= 0.5 * atr), li AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY swing_i DESC) AS n FROM im) WHERE n = 1),
    bo AS (SELECT li.symbol, max(z.i) AS s, arg_max(CASE WHEN move > 0 THEN least(z.o, z.c) ELSE greatest(z.o, z.c) END, z.i) AS b FROM li JOIN z ON z.symbol = li.symbol AND z.i > swing_i AND z.i < to_i AND abs(CASE WHEN move > 0 THEN least(z.o, z.c) ELSE greatest(z.o, z.c) END - p) <= 0.5 * li.atr GROUP BY 1)
    SELECT li.symbol, CASE WHEN move > 0 THEN 'up' ELSE 'down' END AS direction, coalesce(s, swing_i)::INTEGER AS start_i, to_i::INTEGER AS end_i, {r6('coalesce(b, p) AS from_price', 'q AS to_price', 'abs(q - coalesce(b, p)) / atr AS size_atr')}, greatest(to_i - coalesce(s, swing_i), 1)::INTEGER AS bars FROM li LEFT JOIN bo ON bo.symbol = li.symbol"""
)
def last_impulse(spark, d):
    return shown(matrix.last_impulse(hourly(spark, d), _confirmed(spark, d)))


@query(f"WITH {HOURLY}, k AS (SELECT symbol, time_bucket(INTERVAL 4 hours, ts, TIMESTAMP '1970-01-01') + INTERVAL 4 hours AS ts, arg_max(c, ts) AS value FROM bars GROUP BY 1, 2), f AS (SELECT b.symbol, b.ts, k.value FROM bars b ASOF LEFT JOIN k ON k.symbol = b.symbol AND b.ts >= k.ts) SELECT symbol, ts, round(lag(value) OVER (PARTITION BY symbol ORDER BY ts), 6) AS related FROM f")
def related_lagged(spark, d):
    b = hourly(spark, d)
    other = bars.resample(b, "4h").select("symbol", (F.col("ts") + F.expr("interval 4 hours")).alias("ts"), F.col("c").alias("value"))
    return shown(matrix.related_lagged(b.select("symbol", "ts"), other, ["symbol"], "related"))


@query(
    f"""WITH {HOURLY}, m AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) * 1.01 AS o, max(value) * 1.01 AS h, min(value) * 1.01 AS l, arg_max(value, (ts, event_id)) * 1.01 AS c FROM events WHERE day(ts) % 3 = 0 GROUP BY 1, 2)
    SELECT b.symbol, b.ts, {r6('coalesce(m.o, b.o) AS o', 'coalesce(m.h, b.h) AS h', 'coalesce(m.l, b.l) AS l', 'coalesce(m.c, b.c) AS c', 'b.v AS v')}, m.c IS NOT NULL AS covered FROM bars b LEFT JOIN m ON m.symbol = b.symbol AND m.ts = b.ts"""
)
def spot_overlay(spark, d):
    t = event_ticks(spark, d)
    minutes = bars.from_ticks(t.where("day(ts) % 3 = 0").withColumn("price", F.col("price") * 1.01), "1min")
    return shown(matrix.overlay(hourly(spark, d), minutes, "1h"))


@query("WITH t AS (SELECT event_type AS symbol, user_id % 3 AS rank, ts, event_id, value FROM events WHERE NOT (event_type = 'click' AND user_id % 3 = 0)), n AS (SELECT symbol, rank, count(*) AS k FROM t GROUP BY 1, 2 HAVING count(*) >= 20), f AS (SELECT symbol, min(rank) AS rank FROM n GROUP BY 1) SELECT t.symbol, t.rank::BIGINT AS rank, event_id FROM t JOIN f ON f.symbol = t.symbol AND f.rank = t.rank")
def first_source(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("symbol"), (F.col("user_id") % 3).cast("long").alias("rank"), "event_id").where("not (symbol = 'click' and rank = 0)")
    return matrix.first_source(rows, 20).select("symbol", "rank", "event_id")


@query(
    f"""WITH {_bm25('item_id % 100 = 0')}, {VEC}, lx AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm), sx AS (SELECT query_id, doc_id, rank FROM vt WHERE score >= 0.2 AND rank <= 100), fx AS (SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.doc_id, l.doc_id) AS doc_id, coalesce(1 / (60 + s.rank), 0) + coalesce(1 / (60 + l.rank), 0) AS rrf FROM sx s FULL JOIN (SELECT * FROM lx WHERE rank <= 100) l ON s.query_id = l.query_id AND s.doc_id = l.doc_id),
    hx AS (SELECT query_id, fx.doc_id, rrf * (0.9 + 0.2 * pow(0.5, (fx.doc_id % 200) / 90.0)) * (0.9 + 0.2 * (fx.doc_id % 11) / 10) AS score FROM fx JOIN documents USING (doc_id)), rx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM hx)
    SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM rx WHERE rank <= 10"""
)
def hybrid_recall(spark, d):
    v, docs = table(spark, d, "embeddings"), _texts(spark, d)
    lexical = retrieval.top(retrieval.bm25(docs, _queries(spark, d)).withColumn("score", F.round("score", 9)), 100)
    semantic = retrieval.vector_top(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 100).withColumn("score", F.round("score", 9))
    k = F.col("doc_id")
    weight = retrieval.memory_score(F.lit(1.0), k % 200, k % 11 / 10, F.lit(1), F.lit(False))
    return shown(matrix.recall(lexical, semantic, docs.select("doc_id"), weight, 10, 0.2))


@query(f"WITH {DAILY}, r AS (SELECT *, ln(c / lag(c) OVER w) AS ret_1, ln(lead(c, 5) OVER w / c) AS target FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, {r6('ret_1 AS ret_1', 'target AS target')}, CASE WHEN target > 0.1 THEN 'buy' WHEN target < -0.1 THEN 'sell' WHEN target IS NOT NULL THEN 'hold' END AS best FROM r")
def matrix_export(spark, d):
    rows = indicators.returns(daily(spark, d))
    best = F.when(F.col("target") > 0.1, 0).when(F.col("target") < -0.1, 1).when(F.col("target").isNotNull(), 2)
    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}"
    exports.write_matrix(rows.withColumn("best", best), path, "ts", ["ret_1", "target"], ["symbol"], "best")
    return exports.read_matrix(spark, path, ["symbol"], ["ret_1", "target"], "best", {0: "buy", 1: "sell", 2: "hold"})


_DAY = "SELECT DISTINCT event_type AS name, ts::DATE AS day FROM events"


@query(f"SELECT name, day + INTERVAL '13 hours 30 minutes' AS ts FROM ({_DAY})")
def schedule_pages(spark, d):
    days = table(spark, d, "events").select(F.col("event_type").alias("name"), F.to_date("ts").alias("day")).distinct()
    line = F.concat(F.lit("<li>\n <b>"), F.date_format("day", "MMMM d, yyyy"), F.lit("</b>: "), "name", F.lit(" release</li>"))
    pages = days.groupBy(F.concat(F.lit("https://example.org/schedule/"), F.date_format("day", "yyyy-MM")).alias("url")).agg(F.array_join(F.collect_list(line), "\n").alias("html"))
    return shown(events.parse_schedule(pages, r"<b>(\w+ \d{1,2}, \d{4})</b>:\s*(\w+) release", "MMMM d, yyyy", 510, "America/New_York").select("name", "ts"))


_RISK = "t AS (SELECT l_orderkey, l_linenumber, l_quantity AS stop, l_tax * 1000 AS atr, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount * 2000 - 100 END AS news, 50 + l_quantity AS px, 60 + l_linenumber * 10 AS top, 55.0::DOUBLE AS bottom, ['break_retest', 'range', 'stand_aside'][l_orderkey % 3 + 1] AS mode, CASE WHEN l_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS way, l_linenumber % 3 - 1 AS higher, l_orderkey % 4 AS fk FROM lineitem)"


@query(
    f"""WITH {_RISK}, p AS (SELECT *, CASE WHEN top > bottom THEN (px - bottom) / (top - bottom) * 100 ELSE 50 END AS pct FROM t), w AS (SELECT *, CASE WHEN pct > 100 THEN 'above' WHEN pct < 0 THEN 'below' WHEN pct >= 75 THEN 'near_top' WHEN pct <= 25 THEN 'near_bottom' ELSE 'mid_box' END AS place FROM p),
    e AS (SELECT *, CASE mode WHEN 'break_retest' THEN CASE way WHEN 'long' THEN 1 ELSE -1 END WHEN 'range' THEN CASE place WHEN 'near_top' THEN -1 WHEN 'near_bottom' THEN 1 ELSE 0 END ELSE 0 END AS entry FROM w),
    n AS (SELECT *, (coalesce(atr > 0 AND stop < 0.5 * atr, false)::INTEGER + coalesce(abs(news) <= 60, false)::INTEGER + (place = 'mid_box')::INTEGER + (entry <> 0 AND higher <> 0 AND entry <> higher)::INTEGER + (fk >= 2)::INTEGER + (l_orderkey % 5 = 0)::INTEGER + (l_linenumber = 7)::INTEGER) AS k FROM e)
    SELECT l_orderkey, l_linenumber, place, entry, CASE WHEN k >= 3 THEN 'high' WHEN k >= 1 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM n GROUP BY ALL"""
)
def entry_risk(spark, d):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    place = choices.place_in_box(50 + F.col("l_quantity"), 60 + line * 10, F.lit(55.0))
    mode = F.element_at(F.array(*map(F.lit, ("break_retest", "range", "stand_aside"))), (key % 3 + 1).cast("int"))
    rows = table(spark, d, "lineitem").withColumn("place", place)
    rows = rows.withColumn("entry", choices.entry_direction(mode, F.when(key % 2 == 0, "long").otherwise("short"), F.col("place"), F.lit(0)))
    sessions = F.when(key % 5 != 0, F.array(F.lit("London"))).otherwise(F.array(F.lit("Sydney")))
    f = choices.risk_factors(F.col("l_quantity"), F.col("l_tax") * 1000, F.when(line != 1, F.col("l_discount") * 2000 - 100), F.col("place"), F.col("entry"), line % 3 - 1, key % 4, sessions, F.lit(False), line != 7, F.lit(1))
    names = "stop_inside_noise news_near mid_box against_higher_timeframe fakeouts_on_box thin_session closed_or_stale".split()
    out = rows.withColumn("f", f).withColumn("level", choices.risk_level(F.col("f"), names))
    return out.groupBy("l_orderkey", "l_linenumber", "place", "entry", "level").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {BASE}, zin AS (SELECT symbol, price, 8.0::DOUBLE AS tol, known_i FROM lv), {_ZONES}
    SELECT z.symbol, z.ts, round(max(zo.p) FILTER (WHERE zo.p <= z.c), 6) AS below, round(min(zo.p) FILTER (WHERE zo.p > z.c), 6) AS above FROM z LEFT JOIN zo ON zo.symbol = z.symbol AND z.i >= b AND z.i < least(e, re + 1) GROUP BY 1, 2"""
)
def nearest_zones(spark, d):
    b = hourly(spark, d)
    lv = _levels(b).select("symbol", "price", F.lit(8.0).alias("tol"), "known_i")
    zones = zone_rules.lives(zone_rules.zones(indicators.atr(b), lv))
    numbered = b.withColumn("i", F.row_number().over(indicators.by_symbol()) - 1).select("symbol", "ts", "i", "c")
    return shown(choices.nearest_zones(numbered, zones), "symbol", "ts", "below", "above")


@query("SELECT page_id, sha256(unhex(printf('%02x%02x%02x', strlen(a) % 256, strlen(a) // 256 % 256, strlen(a) // 65536) || '0000000000') || encode(a) || unhex(printf('%02x', strlen(b)) || '00000000000000') || encode(b)) AS key FROM (SELECT page_id, url AS a, 'v' || page_id % 5 AS b FROM pages)")
def cache_keys(spark, d):
    return table(spark, d, "pages").select("page_id", documents.cache_key(F.col("url"), F.concat(F.lit("v"), (F.col("page_id") % 5).cast("string"))).alias("key"))


@query("SELECT item_id, 'item-' || item_id AS name, 'Item ' || item_id AS title, trim(text) AS body FROM benchmark")
def parsed_notes(spark, d):
    k = F.col("item_id").cast("string")
    value = F.concat(F.lit("---\nname: Item "), k, F.lit("\ndescription: one\n---\n\n"), F.trim("text"), F.lit("\n"))
    rows = table(spark, d, "benchmark").select(value.alias("value"), F.concat(F.lit("/notes/"), k, F.lit(".md")).alias("path"))
    out = documents.parse_notes(rows)
    return out.select(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long").alias("item_id"), "name", "title", "body")


@query("SELECT DISTINCT ts, upper(event_type) AS currency, 'E' || user_id AS title, 'high' AS impact FROM (SELECT date_trunc('second', ts) AS ts, event_type, user_id FROM events)")
def parsed_feed(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.select(F.concat(F.lit(" E"), F.col("user_id").cast("string")).alias("title"), F.col("event_type").alias("country"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.lit("High").alias("impact"), F.lit("").alias("forecast"), F.lit("").alias("previous"))
    rows = rows.unionByName(rows.limit(3)).unionByName(rows.limit(1).withColumn("date", F.lit("soon")))
    return shown(events.parse_feed(rows), "ts", "currency", "title", "impact")


@query(
    """WITH o AS (SELECT DISTINCT event_type AS type, ts::DATE AS day FROM events WHERE user_id % 2 = 0), r AS (SELECT DISTINCT event_type AS type, ts::DATE AS day FROM events) SELECT type, day, false AS approximate FROM o UNION ALL SELECT type, day, true FROM r WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.type = r.type AND o.day = r.day)"""
)
def events_with_fallback(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("type"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"), F.lit("USD").alias("currency"), "user_id")
    official = e.where("user_id % 2 = 0").select("ts", "currency", "type").distinct()
    rules = e.select("ts", "currency", "type", F.lit(True).alias("approximate")).distinct()
    return events.with_fallback(official, rules).select("type", F.to_date("ts").alias("day"), "approximate")


@query(f"WITH {HOURLY} SELECT {SEL} FROM bars WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' AND symbol <> 'view'")
def store_range(spark, d):
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    b = hourly(spark, d)
    candles.write_store(spark, b, path)
    symbols = [r["symbol"] for r in b.select("symbol").distinct().where("symbol <> 'view'").collect()]
    return shown(candles.read_store(spark, path, symbols, "2024-01-10 12:00:00"), *OHLC)


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, (user_id % 10)::INTEGER AS bin, count(*) FILTER (WHERE value > 100) AS wins, count(*) FILTER (WHERE NOT value > 100) AS losses FROM events GROUP BY 1, 2")
def stream_ledger(spark, d):
    source = table(spark, d, "events")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(source.schema).parquet(f"{d}/events*.parquet")
    rows = rows.select(F.col("event_id").alias("decision_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("user_id") % 10).cast("int").alias("bin"), (F.col("value") > 100).alias("won"))
    write = live.upsert_last(f"{folder}/out", ["side", "bin"], "seen")
    counts = live.running_ledger(rows).withColumn("seen", F.col("wins") + F.col("losses"))
    q = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    newest = q.lastProgress["batchId"] if q.lastProgress else 0
    return spark.read.parquet(f"{folder}/out/{newest}").select("side", "bin", "wins", "losses")


@query(f"WITH {HOURLY}, a AS (SELECT symbol, ts, c, list(h) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS hs FROM bars) SELECT symbol, ts, nullif(list_position(list_transform(hs, lambda x: x >= c + 100), true), 0)::BIGINT AS bars FROM a")
def first_hits(spark, d):
    at = F.array_position(F.transform("ahead_", lambda x: x["h"] >= F.col("c") + 100), F.lit(True))
    return shown(asof.first_hit(hourly(spark, d), 24, F.when(at > 0, at), "bars"), "symbol", "ts", "bars")


@query(
    f"""WITH RECURSIVE {BASE}, zin AS (SELECT symbol, price, 8.0::DOUBLE AS tol, known_i FROM lv), {_ZONES},
    ns AS (SELECT z.symbol, z.ts, max(zo.p) FILTER (WHERE zo.p <= z.c) AS below, min(zo.p) FILTER (WHERE zo.p > z.c) AS above FROM z LEFT JOIN zo ON zo.symbol = z.symbol AND z.i >= b AND z.i < least(zo.e, zo.re + 1) GROUP BY 1, 2), dz AS (SELECT z.*, below, above, lag(z.atr) OVER (PARTITION BY z.symbol ORDER BY z.ts) AS pa FROM z JOIN ns ON ns.symbol = z.symbol AND ns.ts = z.ts),
    dd AS (SELECT *, coalesce(abs(c - o) <= 0.1 * (h - l) AND h - l >= 0.5 * pa AND pa > 0, false) AS d, (c - below) / nullif(atr, 0) AS sd, (above - c) / nullif(atr, 0) AS rd FROM dz)
    SELECT symbol, ts, CASE WHEN d AND coalesce(sd <= 0.5, false) AND NOT coalesce(rd < sd, false) THEN 1 WHEN d AND coalesce(rd <= 0.5, false) THEN -1 ELSE 0 END AS doji FROM dd"""
)
def doji_at_zone(spark, d):
    b = indicators.atr(hourly(spark, d))
    zones = zone_rules.lives(zone_rules.zones(b, _levels(hourly(spark, d)).select("symbol", "price", F.lit(8.0).alias("tol"), "known_i")))
    rows = choices.nearest_zones(b.withColumn("i", F.row_number().over(indicators.by_symbol()) - 1), zones)
    return shown(structure.doji_at_zone(rows), "symbol", "ts", "doji")
