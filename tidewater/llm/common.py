"""Helpers the corpus operators share: checkpoints, word hashing, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)
WORD_CACHE = 250_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder named by spark.checkpoint.dir. Where none is set, as in tests, a local session takes a folder of
    its own; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with files every executor can reread, so a lost executor costs a reread and not a rerun."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    free_shuffles(df.sparkSession)
    return out


def written(df: DataFrame) -> DataFrame:
    """As checkpoint, as a compressed table beside the checkpoints: for wide rows of text or bytes."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _own_tables().append(path)
    free_shuffles(spark)
    return spark.read.parquet(path)


#: Tables written and not yet removed, oldest first; each thread has its own, so that runs side by side keep theirs.
_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def _own_tables() -> list[str]:
    if _tables.get() is None:
        _tables.set([])
    return _tables.get()


#: Tables of texts up to this size may be dealt out over the cores; larger ones have row groups enough.
SPREAD_BYTES = 256 << 20


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A table of texts in at least as many partitions as there are cores, if it is small: one file with few row groups
    would leave them idle. A larger one is read as it lies, whatever the number of cores."""
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= SPREAD_BYTES and rows.rdd.getNumPartitions() < cores else rows


def table_mark() -> int:
    return len(_own_tables())


def drop_tables(spark: SparkSession, mark: int) -> None:
    """Removes the tables written since the mark but the newest: for work whose one result that is."""
    tables = _own_tables()
    for p in tables[mark:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del tables[mark:-1]


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files behind a cut lineage go once the driver collects its garbage; ask for that now, to save disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A worker serves stages of several operators in turn; what one has cached goes when another's work begins.
_caches: list = []
_holder: list = [None]


def claim(cache) -> None:
    if _holder[0] is not cache:
        if not any(c is cache for c in _caches):
            _caches.append(cache)
        for c in _caches:
            if c is not cache:
                c.clear()
        _holder[0] = cache


class WordHashes(dict):
    """word -> 64-bit hash, bounded; the value depends on the word alone, so every worker agrees."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    claim(_words)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n words; a text of fewer words has one gram, all of it; an empty text none."""
    if len(h) == 0:
        return h
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * MIX + h[i : len(h) - k + 1 + i]
    return mix(out)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct n-gram hashes of the lower-cased, white-space separated words of a whole text."""
    return np.unique(ngram_hashes(word_hashes(text.lower().split()), n)) if text else np.zeros(0, np.uint64)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of at most `rows`: the default of ten thousand holds tens of MB on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task holds of their results stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow where fn turns one RecordBatch into one or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def sieve_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash modulo `bits`: a sieve of fixed size whatever the corpus. What it lets through wrongly is
    compared and found unique, so its size bears on speed alone."""
    words = hashes.toDF("h").select(F.pmod("h", F.lit(bits)).alias("b")).groupBy((F.col("b") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    sieve = np.zeros(bits // 64, np.int64)
    got = words.toPandas()
    sieve[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    return sieve.view(np.uint64)


def passes(sieve: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    b = h.view(np.uint64) & np.uint64(bits - 1)
    return (sieve[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) != 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    Alternating large-star and small-star rounds: each is a grouped minimum and one equi-join, so no task holds a
    component and a hub of any degree is split by skew handling. Rounds grow with the logarithm of the longest
    chain. Self loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    one = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    one = checkpoint(one.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _digest(one)
    if state[0] == 0:
        return one.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        one = checkpoint(small.where("u <> v").distinct())
        now = _digest(one)
        if now == state:
            break
        state = now
    # a settled graph is a forest of stars around the least nodes
    roots = one.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return one.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
