"""Exact removal of long repeated passages with sparse suffix arrays and their common-prefix interval trees.

A passage of `length` bytes is looked up by its anchor: the gram of GRAM bytes with the least hash in it, the leftmost
of equals. Equal passages have equal anchors at equal places, so comparing occurrences of one anchor with each other
finds every repeat. The suffixes that start at the occurrences of an anchor, sorted by Spark, are its sparse suffix
array; the interval tree over their common prefixes gives, for every set of occurrences that agree on R bytes from the
anchor on, how many bytes L they also agree on before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, checkpoint, in_slices, mix, read_spread, written
from .stored_sieve import StoredSieve, stored_sieve

LENGTH, GRAM = 200, 32
SEGMENT = 1 << 20
#: Bits of the anchor sieve for each anchor it holds, and in all at least and at most.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 29
TEXT_BITS = 1 << 24
GROUP_ROWS = 20_000
#: Places that windows of one group of parts may start at, for groups of more rows; after the last each is by itself.
PART_PLACES = (16, 1)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of GRAM (a power of two) bytes, by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    step, c = 1, MIX
    while step < GRAM:
        h = h[:-step] * c + h[step:]
        c = c * c
        step *= 2
    return mix(mix(h))


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): the anchors of a text, and the first and last start of the windows each stands for."""
    w = length - GRAM + 1
    out = []
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        b = np.frombuffer(data, np.uint8, min(len(data) - at, SEGMENT + length - 1), at)
        with np.errstate(over="ignore"):
            h = gram_hashes(b)
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        pad = np.full(-len(key) % w, np.iinfo(np.uint64).max, np.uint64)
        rows = np.concatenate([key, pad]).reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - w + 1
        place = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [n - 1]])
        place = place[first]
        out.append((h[place].view(np.int64), place + at, first + at, last + at))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bytes(texts) -> Iterator[bytes]:
    for t in texts:
        yield (t.as_py() or "").encode("utf-8", "surrogatepass")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("hi"), F.xxhash64(F.lit(2), text).alias("lo"))


def _anchor_counts(texts: DataFrame, length: int) -> DataFrame:
    """Hashes of anchors that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            held = [anchors(d, length)[0] for d in _bytes(b.column(0))]
            if held:
                seen, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return texts.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def _contexts(texts: Iterator[bytes], sieve: StoredSieve, length: int):
    """(text's number, anchor, context, place, left, right) of each anchor that may occur again; left is reversed."""
    for some in batched(enumerate(texts), 64):
        found = [anchors(d, length) for _, d in some]
        own = sieve.passes(np.concatenate([f[0] for f in found]))
        start = 0
        for (k, data), (h, place, first, last) in zip(some, found, strict=True):
            for i in np.flatnonzero(own[start : start + len(h)]).tolist():
                p = int(place[i])
                left, right = data[int(first[i]) : p][::-1], data[p : int(last[i]) + length]
                yield k, int(h[i]), xxhash.xxh3_64_intdigest(left, xxhash.xxh3_64_intdigest(right)) - (1 << 63), p, left, right
            start += len(h)


def _classes(texts: DataFrame, sieve: StoredSieve, length: int) -> DataFrame:
    """Distinct contexts of repeated anchors, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            seen: dict[tuple[int, int], list] = {}
            for _, a, c, _, left, right in _contexts(_bytes(b.column(0)), sieve, length):
                seen.setdefault((a, c), [left, right, 0])[2] += 1
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in seen], pa.int64()),
                        pa.array([k[1] for k in seen], pa.int64()),
                        pa.array([v[0] for v in seen.values()], pa.binary()),
                        pa.array([v[1] for v in seen.values()], pa.binary()),
                        pa.array([v[2] for v in seen.values()], pa.int64()),
                    ],
                    ["anchor", "context", "left", "right", "n"],
                )

    rows = texts.select("text").mapInArrow(run, "anchor long, context long, left binary, right binary, n long")
    return rows.groupBy("anchor", "context").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.sum("n").alias("n"))


def _matrix(rows: list[bytes]) -> np.ndarray:
    width = max(map(len, rows), default=0) + 1
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)


def common_prefix(rows: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each row and the next."""
    m = _matrix(rows)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    differ = m[1:] != m[:-1]
    differ[:, -1] = True
    return np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))


def interval_tree(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every common-prefix interval of a sorted run, inner ones first, by a stack scan."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeats_of_group(left: list[bytes], lcp: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(row, L, R) for each row of one anchor's suffix array: L bytes before it and R from it on occur elsewhere too,
    L + R >= length. Of each row only pairs that add bytes to its inner intervals'."""
    longest = max(map(len, left))
    best = [-1] * len(left)
    found = []
    for depth, first, last in interval_tree(lcp):
        if depth + longest < length:
            continue
        order = sorted(range(first, last + 1), key=left.__getitem__)
        own = [left[k] for k in order]
        if own[0] == own[-1]:  # no diversity on the left: all extend as far as their contexts go
            reach = np.full(len(own), len(own[0]), np.int64)
        else:
            near = common_prefix(own)
            reach = np.maximum(np.concatenate([near, [-1]]), np.concatenate([[-1], near]))
        for k, n in zip(order, reach.tolist(), strict=True):
            if n + depth >= length and n > best[k]:
                best[k] = n
                found.append((k, n, depth))
    return found


_FOUND = "anchor long, context long, before long, after long"


def _scan(length: int):
    """Over partitions sorted by group and right context: the repeats of each group, a bounded one at a time."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["anchor", "context", "before", "after"])

    def work(t: pa.Table) -> list[tuple]:
        group = t.column("group").to_numpy()
        anchor, context, before, after, left, right = (t.column(c).to_pylist() for c in ("anchor", "context", "before", "after", "left", "right"))
        lcp = common_prefix(right)
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        size = np.diff(edge)
        out = []
        two = edge[:-1][size == 2]
        if len(two):
            near = common_prefix([left[k] for i in two.tolist() for k in (i, i + 1)])[::2]
            reach = lcp[two]
            for i, n, r in zip(two.tolist(), near.tolist(), reach.tolist(), strict=True):
                if n + before[i] + r + after[i] >= length:
                    out += [(anchor[k], context[k], n + before[k], r + after[k]) for k in (i, i + 1)]
        for i, m in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            for k, n, r in repeats_of_group(left[i : i + m], lcp[i : i + m - 1], length - before[i] - after[i]):
                out.append((anchor[i + k], context[i + k], n + before[i], r + after[i]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            group = b.column("group").to_numpy()
            if held and held[-1].column("group")[-1].as_py() == group[-1]:
                held.append(b)  # one group goes on
                continue
            cut = int(np.flatnonzero(group == group[-1])[0])
            t = pa.Table.from_batches([*held, b.slice(0, cut)]) if cut or held else None
            if t is not None and t.num_rows:
                yield emit(work(t))
            held = [b.slice(cut)]
        if held:
            yield emit(work(pa.Table.from_batches(held)))

    return run


def _parts(rows: DataFrame, places: int, length: int) -> DataFrame:
    """The windows of each row, those that start at `places` neighbouring distances before the anchor together.

    All windows of a part hold the same stretch of bytes around the anchor; its rows are in a group with those of their
    group that agree on it, and keep of left and right what lies beyond. Equal windows are in the same part of their rows,
    so what a row shares with any other of its group it shares with one in a group of its parts."""
    need = F.lit(length) - F.col("before") - F.col("after")
    least = F.greatest(need - F.octet_length("right"), F.lit(0))
    numbers = F.sequence(F.floor(least / places).cast("int"), F.floor(F.octet_length("left") / places).cast("int"))
    out = rows.select("*", need.cast("int").alias("need"), F.explode(numbers).alias("part"))
    out = out.withColumn("l", F.col("part") * places).withColumn("r", F.greatest(F.col("need") - F.col("l") - places + 1, F.lit(0)))
    cut = lambda c, start, size: F.substring(c, start, size)
    one = F.lit(1)
    return out.select(
        F.xxhash64("group", "part", cut("left", one, F.col("l")), cut("right", one, F.col("r"))).alias("group"),
        "anchor",
        "context",
        (F.col("before") + F.col("l")).alias("before"),
        (F.col("after") + F.col("r")).alias("after"),
        cut("left", F.col("l") + 1, F.lit(places - 1)).alias("left"),
        cut("right", F.col("r") + 1, F.lit(places - 1)).alias("right"),
    )


def _split_hot(groups: DataFrame, group_rows: int, length: int) -> tuple[DataFrame, DataFrame | None]:
    """Groups of at most group_rows rows each, and what was found while larger ones were split: into parts of their
    windows, and parts of too many rows into single windows. A single window that so many rows share is a repeat of each
    of them. As many steps as PART_PLACES has, whatever the groups, and only rows of larger groups take part in them."""
    out, early = None, None
    for places in (*PART_PLACES, None):
        hot = checkpoint(groups.groupBy("group").agg(F.count("*").alias("rows")).where(F.col("rows") > group_rows).select("group"))
        if hot.isEmpty():
            return groups if out is None else out.unionByName(groups), None
        hot = F.broadcast(hot)  # of group_rows rows one
        cold = groups.join(hot, "group", "left_anti")
        out = cold if out is None else out.unionByName(cold)
        rows = groups.join(hot, "group")
        if places is None:
            early = rows.select("anchor", "context", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"))
        else:
            groups = _parts(rows, places, length)
    return out, early


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, filter_bits: int | None = None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(hi, lo, starts, ends) for each distinct text, named by two hashes, with spans of bytes that a repeated string of
    `length` bytes covers; spans may overlap.

    The sieve that keeps unique anchors from being compared has filter_bits, or BITS_EACH for each repeated anchor up to
    MOST_BITS: what a larger corpus lets through wrongly costs time, not results."""
    texts = _texts(docs, id_col, text_col).where(F.octet_length("text") >= length)
    repeated = checkpoint(_anchor_counts(texts, length))
    if filter_bits is None:
        filter_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * repeated.count()).bit_length()))
    sieve = stored_sieve(repeated, filter_bits)
    classes = written(_classes(texts, sieve, length))
    whole = classes.where("n > 1").select("anchor", "context", F.octet_length("left").cast("long").alias("before"), F.octet_length("right").cast("long").alias("after"))
    none = F.lit(0)
    groups = classes.select(F.col("anchor").alias("group"), "anchor", "context", none.alias("before"), none.alias("after"), "left", "right")
    groups, early = _split_hot(groups, group_rows, length)
    found = groups.repartition("group").sortWithinPartitions("group", "right").mapInArrow(_scan(length), _FOUND)
    for more in (whole, early):
        found = found if more is None else found.unionByName(more)
    # all spans of a context hold its anchor, so they are one; a table of its own leaves the join below free to split a
    # context that very many places share
    found = written(found.groupBy("anchor", "context").agg(F.max("before").alias("before"), F.max("after").alias("after")))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            out: list[list[int]] = [[], [], [], [], []]
            hi, lo = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, a, c, p, _, _ in _contexts(_bytes(b.column(2)), sieve, length):
                for k, v in enumerate((hi[i], lo[i], a, c, p)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["hi", "lo", "anchor", "context", "place"])

    at = texts.select("hi", "lo", "text").mapInArrow(places, "hi long, lo long, anchor long, context long, place long")
    spans = at.join(found, ["anchor", "context"]).select("hi", "lo", F.struct((F.col("place") - F.col("before")).alias("a"), (F.col("place") + F.col("after")).alias("b")).alias("s"))
    return spans.groupBy("hi", "lo").agg(F.collect_set("s").alias("s")).select("hi", "lo", F.col("s.a").alias("starts"), F.col("s.b").alias("ends"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """Texts without the bytes that a `length`-byte string which also starts elsewhere covers.

    Returns a row per document: doc_id, kept (binary: the remaining bytes joined), n_bytes, n_removed, starts and ends
    (the maximal removed runs). Strings are judged on the input, in the same document or any other, overlaps included;
    matches never cross documents.

    Null texts are empty; texts shorter than `length` lose nothing. All copies of a text of at least `length` bytes lose
    all of it, repeated rows and ids included; rows with a null id are documents as well. An empty table gives no rows;
    other columns are ignored. Very long texts are scanned in overlapping segments.
    """
    spans = written(repeated_spans(docs, id_col, text_col, length, **options))
    # texts that the sieve rules out have no spans and need not move
    sieve = stored_sieve(spans.select("hi"), TEXT_BITS)

    def moves(hi: pd.Series) -> pd.Series:
        return pd.Series(sieve.passes(hi.to_numpy(np.int64)))

    texts = _texts(docs, id_col, text_col).withColumn("moves", F.pandas_udf(moves, "boolean")("hi"))
    none = F.lit(None).cast("array<long>")
    rows = texts.where("not moves").select("doc_id", "text", none.alias("starts"), none.alias("ends"))
    rows = rows.unionByName(texts.where("moves").join(spans, ["hi", "lo"], "left").select("doc_id", "text", "starts", "ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            out: list[list] = [[], [], [], [], []]
            for d, a, e in zip(_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                gone = np.zeros(len(d) + 2, np.int8)
                if a:
                    edge = np.zeros(len(d) + 1, np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, e, -1)
                    gone[1:-1] = np.cumsum(edge)[:-1] > 0
                step = np.diff(gone)
                starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                kept, at = [], 0
                for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
                    kept.append(d[at:x])
                    at = y
                for k, v in enumerate((b"".join([*kept, d[at:]]), len(d), int((ends - starts).sum()), starts, ends)):
                    out[k].append(v)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], longs), pa.array(out[4], longs)],
                ["doc_id", "kept", "n_bytes", "n_removed", "starts", "ends"],
            )

    return rows.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, starts array<long>, ends array<long>")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated 200-byte strings, as counts and a checksum of what is left."""
    out = remove_repeats(read_spread(spark, f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
