"""Ordered passes of any length: a machine with a small state runs over ranges of (key, position) in as many tasks, and the
state that each range starts from is made that of one unbroken pass."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

RANGE_ROWS, WARM_ROWS = 50_000, 2_000


class Machine:
    """What runs over the rows of one key in order. States are what JSON can hold, so equal ones are equal as text."""

    #: Columns of what it gives for rows, as a schema.
    out: str

    def start(self):
        """The state before the first row."""
        raise NotImplementedError

    def run(self, state, rows: pd.DataFrame, ahead: pd.DataFrame) -> tuple[object, list[tuple]]:
        """(state after the rows, what it gives for them). It may look at the rows ahead but takes no state from them."""
        raise NotImplementedError


class Joining(Machine):
    """A machine whose states can be joined: what rows do to any state follows from what they leave of an empty one."""

    def join(self, before, own):
        """The state after a range that left `own` from an empty one, if it starts from `before`."""
        raise NotImplementedError


def pass_over(rows: DataFrame, machine: Machine, by: str = "symbol", at: str = "i", order: tuple[str, ...] = ("i",), ahead: int = 0, range_rows: int = RANGE_ROWS, warm_rows: int = WARM_ROWS) -> tuple[DataFrame, DataFrame]:
    """(what the machine gives, with `by` before it; the state each key ends with, as JSON text).

    Rows of a key are cut by their position into ranges of range_rows, a task each. A Joining machine runs from nothing
    first; one row a range is then joined up in order and each range runs again from what came. Any other runs from a
    state found over the warm_rows positions before its range; where the range before left another state, it runs again from
    that, in rounds, until none differs: one or two where states forget, as many as ranges at worst, and exact always.
    Rows without key or position are left out; no rows give none. Rows that tie in the order go in the order of their
    other columns."""
    columns = rows.columns
    ties = [*order, *(c for c in columns if c not in order and c != by)]
    joining = isinstance(machine, Joining)
    place = F.col(at) % range_rows
    own = F.floor(F.col(at) / range_rows).cast("int")
    parts = [F.struct(own.alias("range_"), F.lit(0).alias("part_"))]
    if not joining:
        parts.append(F.when(place >= range_rows - warm_rows, F.struct((own + 1).alias("range_"), F.lit(-1).alias("part_"))))
    if ahead:
        parts.append(F.when(place < ahead, F.struct((own - 1).alias("range_"), F.lit(1).alias("part_"))))
    ranged = rows.where(F.col(by).isNotNull() & F.col(at).isNotNull()).withColumn("p_", F.explode(F.array_compact(F.array(*parts)))).select(*columns, "p_.*")
    ranged = checkpointed(ranged)
    names = [x.strip().split()[0] for x in machine.out.split(",")]
    kind = dict(rows.dtypes)[by]
    schema = f"{by} {kind}, range_ int, {machine.out}, came_ string, left_ string"

    def given(key, part: pd.DataFrame, state) -> pd.DataFrame:
        part = part.sort_values(ties, kind="stable")
        own, warm, later = (part[part["part_"] == k].drop(columns=["range_", "part_"]) for k in (0, -1, 1))
        out: list[tuple] = []
        if len(own):
            if state is None:
                state = machine.start()
                if len(warm):
                    state, _ = machine.run(state, warm, warm.iloc[:0])
            came = json.dumps(state)
            state, found = machine.run(json.loads(came), own, later)
            out = [(*key, *r, None, None) for r in found]
            out.append((*key, *[None] * len(names), came, json.dumps(state)))
        return pd.DataFrame(out, columns=[by, "range_", *names, "came_", "left_"], dtype=object)

    def from_warm(key, part: pd.DataFrame) -> pd.DataFrame:
        return given(key, part, None)

    def from_given(key, part: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        return given(key, part, json.loads(came["want_"].iloc[0]))

    def again(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select(F.col(by).alias("key_"), F.col("range_").alias("of_"), "want_")
        some = ranged.join(wanted.select("key_", "of_"), (F.col(by) == F.col("key_")) & (F.col("range_") == F.col("of_")), "left_semi")
        return some.groupBy(by, "range_").cogroup(wanted.groupBy("key_", "of_")).applyInPandas(from_given, schema)

    done = checkpointed(ranged.groupBy(by, "range_").applyInPandas(from_warm, schema))
    states = done.where("left_ is not null").select(by, "range_", "came_", "left_")
    if joining:

        def joined(own: pd.DataFrame) -> pd.DataFrame:
            own, want, state = own.sort_values("range_"), [], machine.start()
            for left in own["left_"]:
                want.append(json.dumps(state))
                state = machine.join(state, json.loads(left))
            return own[[by, "range_"]].assign(want_=want)

        if not states.where("range_ > 0").isEmpty():
            wanted = states.groupBy(by).applyInPandas(joined, f"{by} {kind}, range_ int, want_ string").where("range_ > 0")
            late = checkpointed(again(wanted))
            done = done.where("range_ = 0").unionByName(late)
    else:
        while True:
            before = F.lag("left_").over(Window.partitionBy(by).orderBy("range_"))
            wanted = checkpointed(states.withColumn("want_", before).where("want_ is not null and want_ <> came_"))
            if wanted.isEmpty():
                break
            done = checkpointed(done.join(wanted.select(by, "range_"), [by, "range_"], "left_anti").unionByName(again(wanted)))
            states = done.where("left_ is not null").select(by, "range_", "came_", "left_")
    ends = done.where("left_ is not null").groupBy(by).agg(F.max_by("left_", "range_").alias("state"))
    return done.where("left_ is null").select(by, *names), ends
