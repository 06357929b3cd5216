"""Structured Streaming forms: closed bars with a watermark, once-only signals, activity sessions, running counts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.zones import KNOWN, LIFETIME, PRICE, ZoneMachine


def stream_table(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def closed_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of (symbol, ts, price, seq): in append mode a bar comes out once the watermark has passed its
    end, so only closed bars are seen; later ticks are dropped, forming bars stay in state. State is one row a bar."""
    order = F.struct("ts", "seq")
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.count("*").cast("double").alias("v")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "o", "h", "l", "c", "v")


def sliding_means(ticks: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, step).alias("w")).agg(F.avg("price").alias("mean"), F.count("*").alias("n"))
    return out.select("symbol", F.col("w.end").alias("ts"), "mean", "n")


def activity_sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events less than `gap` apart."""
    out = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def once_only(signals: DataFrame, key: str = "id", within: str = "1 day") -> DataFrame:
    """Each signal id once within the watermark: what a watcher that remembers what it sent would send."""
    return signals.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def running_ledger(decisions: DataFrame) -> DataFrame:
    """Wins and losses of each (side, bin) after every batch, each decision_id counted once within the watermark."""
    once = decisions.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["decision_id"])

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        wins, losses = state.get if state.exists else (0, 0)
        for f in frames:
            won = int(f["won"].sum())
            wins, losses = wins + won, losses + len(f) - won
        state.update((wins, losses))
        yield pd.DataFrame({"side": [key[0]], "bin": [key[1]], "wins": [wins], "losses": [losses]})

    out, kept = "side string, bin int, wins long, losses long", "wins long, losses long"
    return once.groupBy("side", "bin").applyInPandasWithState(update, out, kept, "update", "NoTimeout")


class ZoneProcessor(StatefulProcessor):
    """The zone machine over a stream of its rows, one symbol's at a time: a state variable for each zone alive, and one
    for the last closes and the place reached. Rows at or before that place are late or repeated, and pass by."""

    def __init__(self, machine: ZoneMachine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.zones = handle.getMapState("zones", "known_i int, price double", "zone string")
        self.rest = handle.getValueState("rest", "rest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["i", "step", "price"], kind="stable").drop_duplicates(["i", "step", "price"])
        state, place = self.machine.start(), [-1, -1]
        if self.rest.exists():
            state["past"], state["pushes"], place = json.loads(self.rest.get()[0])
        new = new[(new["i"] > place[0]) | (new["i"] == place[0]) & (new["step"] > place[1])]
        if not len(new):
            return
        held = {k: v[0] for k, v in self.zones.iterator()}
        state["zones"] = [json.loads(v) for _, v in sorted(held.items())]
        state, found = self.machine.run(state, new, new.iloc[:0])
        now = {(z[KNOWN], z[PRICE]): json.dumps(z) for z in state["zones"]}
        for k in held.keys() - now.keys():
            self.zones.removeKey(k)
        for k, v in now.items():
            if held.get(k) != v:
                self.zones.updateValue(k, (v,))
        last = new.iloc[-1]
        self.rest.update((json.dumps([state["past"], state["pushes"], [int(last["i"]), int(last["step"])]]),))
        names = [x.split()[0] for x in self.machine.out.split(", ")]
        yield pd.DataFrame([(key[0], *r) for r in found], columns=["symbol", *names], dtype=object)

    def close(self) -> None:
        pass


def zone_touches(rows: DataFrame, lifetime: int = LIFETIME) -> DataFrame:
    """Touches and zones of a stream of machine rows (zones.machine_rows), each as it is decided, in whatever batches the
    rows come: what zone_history gives for all rows at once but for touches and zones still open. A symbol's rows must come in
    order of (i, step), as bars and the levels they confirm do; levels of one bar and price are one. Needs the RocksDB
    state store."""
    machine = ZoneMachine(lifetime)
    return rows.groupBy("symbol").transformWithStateInPandas(ZoneProcessor(machine), f"symbol string, {machine.out}", "Append", "None")


def upsert_last(path: str, keys: list[str], order: str):
    """For foreachBatch: a table at `path` that keeps the last row of each key by `order`, over all batches. Each batch
    writes a new version beside the old one, which readers find by the highest number; the one before that goes, so that
    two are kept and a batch that is run again finds what it started from."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = lambda rows: rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        rows = batch if number == 0 else batch.unionByName(spark.read.parquet(f"{path}/{number - 1}"))
        last(rows).write.mode("overwrite").parquet(f"{path}/{number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return write
