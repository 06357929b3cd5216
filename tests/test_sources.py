"""Files in, files out: round trips, damaged rows, clocks, the minute store, notes; streams over files."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.sources import candles, documents, events
from tidewater.streaming import live


def test_semicolon_files_and_their_clock(spark, tmp_path):
    path = tmp_path / "DAT_ASCII_EURUSD_M1.csv"
    path.write_text("20240705 100000;1.0;1.2;0.9;1.1;0\nbroken\n20240705 100100;1.1;1.2;1.0;1.15;3\n")
    out = candles.read_semicolon(spark, str(path), "America/New_York").orderBy("ts").collect()
    assert [(r["symbol"], r["ts"], r["c"]) for r in out] == [("EURUSD", dt.datetime(2024, 7, 5, 14), 1.1), ("EURUSD", dt.datetime(2024, 7, 5, 14, 1), 1.15)]
    for hour, zone in ((16, "America/New_York"), (15, "-05:00"), (3, None)):
        stamps = [(dt.datetime(2024, 7, d, h, m),) for d in range(1, 5) for h in range(24) for m in (0, 30) if h != hour + 1]
        assert candles.detect_zone(spark.createDataFrame(stamps, "ts timestamp")).first()["zone"] == zone


def test_clock_changes_drop_and_shift(spark):
    rows = spark.createDataFrame([("2024-11-03 01:30:00",), ("2024-03-10 02:30:00",), ("2024-11-03 03:00:00",)], "t string").select(candles.local_to_utc(F.col("t").cast("timestamp"), "America/New_York").alias("u"))
    got = [r["u"] for r in rows.collect()]
    assert got[0] is None and got[1] == dt.datetime(2024, 3, 10, 7, 30) and got[2] == dt.datetime(2024, 11, 3, 8)


def test_terminal_exports(spark, tmp_path):
    (tmp_path / "GBPUSD1.csv").write_text("2024.01.02,00:01,1.1,1.2,1.0,1.15,7\n")
    (tmp_path / "USDJPY_M1.csv").write_text("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\n2024.01.02\t00:01:00\t140\t141\t139\t140.5\t9\n")
    out = {r["symbol"]: (r["ts"], r["c"], r["v"]) for r in candles.read_terminal(spark, str(tmp_path), "UTC").collect()}
    assert out == {"GBPUSD": (dt.datetime(2024, 1, 2, 0, 1), 1.15, 7.0), "USDJPY": (dt.datetime(2024, 1, 2, 0, 1), 140.5, 9.0)}


def test_day_files_round_trip(spark, tmp_path):
    rows = np.zeros(3, candles.DAY_RECORD)
    rows["sec"], rows["o"], rows["h"], rows["l"], rows["c"], rows["v"] = [0, 60, 120], 1000, 1200, 900, 1100, [1, 0, 2]
    (tmp_path / "EURUSD").mkdir()
    (tmp_path / "EURUSD" / "2024-01-02.bi5").write_bytes(candles.encode_day(rows))
    (tmp_path / "EURUSD" / "2024-01-03.bi5").write_bytes(b"")
    out = candles.read_days(spark, f"{tmp_path}/*/*.bi5", 1000.0).orderBy("ts").collect()
    assert [(r["ts"], r["h"], r["v"]) for r in out] == [(dt.datetime(2024, 1, 2), 1.2, 1.0), (dt.datetime(2024, 1, 2, 0, 2), 1.2, 2.0)]


def test_nested_candles(spark, tmp_path):
    body = {"instrument": "EUR_USD", "granularity": "H1", "candles": [{"complete": True, "volume": 5, "time": "2024-01-02T00:00:00.000000000Z", "mid": {"o": "1.1", "h": "1.2", "l": "1.0", "c": "1.15"}}, {"complete": False, "volume": 1, "time": "2024-01-02T01:00:00Z", "mid": {"c": "x"}}]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    out = candles.read_nested_json(spark, str(tmp_path)).collect()
    assert [(r["symbol"], r["c"], r["complete"]) for r in out] == [("EURUSD", 1.15, True)]


def test_store_merges_by_year(spark, tmp_path):
    make = lambda c, days: spark.createDataFrame([("A", dt.datetime(2023, 12, 31) + dt.timedelta(days=d), c, c, c, c, 1.0) for d in days], "symbol string, ts timestamp, o double, h double, l double, c double, v double")
    path = f"{tmp_path}/store"
    candles.write_store(spark, make(1.0, [0, 1, 2]), path)
    candles.write_store(spark, make(2.0, [2, 3]), path)
    assert [r["c"] for r in candles.read_store(spark, path).orderBy("ts").collect()] == [1, 1, 1, 2]
    candles.write_store(spark, make(3.0, [2]), path, replace=True)
    assert [r["c"] for r in candles.read_store(spark, path, ["A"], "2024-01-01").orderBy("ts").collect()] == [1, 3, 2]
    assert candles.fingerprint(spark, path).count() >= 2


def test_events_rules_and_sessions(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"title": " CPI ", "country": "usd", "date": "2024-01-11T08:30:00-05:00", "impact": "High"}, {"title": "CPI", "country": "USD", "date": "2024-01-11T13:30:00Z", "impact": "High"}, {"title": "bad", "country": "USD", "date": "tbd"}]))
    feed = events.read_feed(spark, str(tmp_path))
    assert [(r["ts"], r["title"]) for r in feed.collect()] == [(dt.datetime(2024, 1, 11, 13, 30), "CPI")]
    near = events.upcoming(feed, F.lit("2024-01-11 13:00:00").cast("timestamp"), 1, 2, ["USD"], ["high"]).first()
    assert (near["minutes_until"], near["status"]) == (30.0, "ahead")
    rules = events.rule_events(spark, "2024-01-01", "2024-01-12").orderBy("ts").collect()
    assert [(r["type"], r["ts"]) for r in rules] == [("claims", dt.datetime(2024, 1, 4, 13, 30)), ("payrolls", dt.datetime(2024, 1, 5, 13, 30)), ("claims", dt.datetime(2024, 1, 11, 13, 30))]
    at = spark.sql("select timestamp'2024-07-03 12:30:00' t").select(events.active_sessions(F.col("t")).alias("s")).first()["s"]
    assert at == ["london", "newyork"]
    bars = spark.createDataFrame([("A", dt.datetime(2024, 7, 3, 12, m), 1.0 + m, 2.0 + m, 0.5 + m, 1.5 + m, 1.0) for m in (0, 30)], "symbol string, ts timestamp, o double, h double, l double, c double, v double")
    stats = {r["session"]: r["direction"] for r in events.session_stats(bars, events.session_blocks(spark, "2024-07-01", "2024-07-05")).collect()}
    assert stats == {"london": "up", "newyork": "up"}


def test_notes_logs_and_keys(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "My Note.md").write_text("---\nname: A  Title!\ndescription: 'says it'\n---\nbody\n")
    (tmp_path / "n" / "plain.md").write_text("only body")
    out = {r["name"]: (r["description"], r["body"]) for r in documents.read_notes(spark, f"{tmp_path}/n").collect()}
    assert out == {"a-title": ("says it", "body"), "plain": (None, "only body")}
    documents.append_log(spark.createDataFrame([(1, "x")], "id int, t string"), f"{tmp_path}/log")
    (tmp_path / "log" / "part-bad.json").write_text('{"id": 2\n{"id": 3, "t": "y"}\n')
    assert sorted(r["id"] for r in documents.read_log(spark, f"{tmp_path}/log", "id int, t string").collect()) == [1, 3]
    a, b = spark.range(1).select(documents.cache_key(F.lit("ab"), F.lit("c")).alias("a"), documents.cache_key(F.lit("a"), F.lit("bc")).alias("b")).first()
    import hashlib

    assert a == hashlib.sha256((2).to_bytes(8, "little") + b"ab" + (1).to_bytes(8, "little") + b"c").hexdigest() != b


@pytest.fixture
def tick_files(spark, tmp_path):
    """Files in time order; the last holds a tick too late and one that only moves the watermark."""
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    parts = [[("a", at(0, 5), 1.0, 1), ("a", at(0, 50), 3.0, 2)], [("a", at(1, 30), 2.0, 3), ("b", at(2, 30), 9.0, 4)], [("c", at(4, 0), 1.0, 7)], [("a", at(0, 10), 99.0, 5), ("b", at(9, 0), 1.0, 6)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "symbol string, ts timestamp, price double, seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
    return f"{tmp_path}/ticks"


def run_stream(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


TICK = "symbol string, ts timestamp, price double, seq long"


def test_closed_bars_only_and_late_ticks_drop(spark, tick_files):
    out = run_stream(spark, live.closed_bars(live.stream_table(spark, tick_files, TICK)), "bars_stream")
    got = sorted((r["symbol"], r["ts"].hour, r["o"], r["h"], r["c"]) for r in out)
    assert ("a", 1, 2.0, 2.0, 2.0) in got and ("b", 2, 9.0, 9.0, 9.0) in got and all(h != 9 for _, h, *_ in got)
    assert all(x[3] < 99 for x in got)


def test_once_only_and_sessions_and_ledger(spark, tick_files, tmp_path):
    ticks = live.stream_table(spark, tick_files, TICK)
    ids = run_stream(spark, live.once_only(ticks.withColumn("id", F.col("symbol"))), "once_stream")
    assert sorted(r["id"] for r in ids) == ["a", "b", "c"]
    runs = run_stream(spark, live.activity_sessions(ticks, "symbol", "50 minutes"), "session_stream")
    assert ("a", 3) in {(r["symbol"], r["n"]) for r in runs}
    decided = ticks.select(F.lit("buy").alias("side"), F.lit(1).alias("bin"), (F.col("price") > 2).alias("won"), F.col("seq").alias("decision_id"), "ts")
    last = run_stream(spark, live.running_ledger(decided), "ledger_stream", "update")[-1]
    assert last["wins"] + last["losses"] >= 5
    q = ticks.writeStream.foreachBatch(live.upsert_last(f"{tmp_path}/last", ["symbol"], "seq")).trigger(availableNow=True).start()
    q.awaitTermination()
    newest = max(int(p.name) for p in (tmp_path / "last").iterdir() if p.name.isdigit())
    assert {r["symbol"]: r["seq"] for r in spark.read.parquet(f"{tmp_path}/last/{newest}").collect()} == {"a": 5, "b": 6, "c": 7}


def test_text_functions_and_sql(spark):
    text.register(spark)
    a, b, c = (text.hash_embed(t) for t in ("the market rose today", "the market rose again today", "zebra crossing"))
    assert np.linalg.norm(a) == pytest.approx(1) and a @ b > a @ c and len(a) == 768
    h = 0xCBF29CE484222325
    for byte in b"foobar":
        h = (h ^ byte) * 0x100000001B3 % (1 << 64)
    assert int(text.fnv1a([b"foobar", b""])[0]) == h
    page = "<nav>menu</nav><article><h2>T</h2><p>one &amp; two</p><ul><li>x</ul><script>no</script></article><footer>f</footer>"
    assert spark.createDataFrame([(page,)], "p string").selectExpr("html_to_text(p) t").first()["t"] == "## T\n\none & two\n\n- x"
    assert text.extract_json('so {"a": 1} and {"b": [2, {"c": 3}]} end') == '{"b": [2, {"c": 3}]}'
    # objects alone count, in fences as in texts, however many braces they hold
    assert text.extract_json("```json\n[1, 2]\n```") is None and text.extract_json("none") is None
    assert text.extract_json('a\n```json\n{"a": 1}\n```\n```\nno\n``` {') == '{"a": 1}'
    deep = '{"list": [' + ", ".join(f'{{"k": {i}}}' for i in range(250)) + "]}"
    assert text.extract_json("so it is: " + deep + " and } more {") == deep
    long = "\n\n".join([f"filler words number {i} of nothing much" for i in range(80)] + ["the budget of 2024 was $5 million"])
    short = text.compress_text(long, "budget million", 120)
    assert "budget of 2024" in short and len(short) < len(long) / 3 and "[...]" in short


def test_hash_embed_is_the_fixed_feature_set():
    def plain(t):
        words = [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split() if w not in text.STOP_WORDS]
        weight = {}
        for w in words:
            pad = f"<{w}>"
            parts = [(b"w" + w.encode(), 1.0)] + [(b"c" + pad[i : i + n].encode(), 0.5 / (len(pad) - n + 1) ** 0.5) for n in (3, 4, 5) for i in range(len(pad) - n + 1)]
            for k, x in parts:
                weight[k] = weight.get(k, 0.0) + x
        for a, b in zip(words, words[1:], strict=False):
            weight[f"b{a} {b}".encode()] = weight.get(f"b{a} {b}".encode(), 0.0) + 0.7
        out = [0.0] * 768
        for k, x in weight.items():
            h = 0xCBF29CE484222325
            for byte in k:
                h = (h ^ byte) * 0x100000001B3 % (1 << 64)
            out[h % 768] += (-1 if h >> 63 else 1) * float(np.log(1 + x))
        size = sum(v * v for v in out) ** 0.5
        return [v / size if size else 0.0 for v in out]

    for t in ("The Fed's rate_cut of 25bp, again and again", "", "is was", "Éire über 東京 x"):
        assert text.hash_embed(t) == pytest.approx(plain(t))
