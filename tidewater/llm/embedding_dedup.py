"""Near-duplicate vectors by a tiled comparison in order of principal components, with residual bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, connected_components

THRESHOLD = 0.9
#: Vectors of a block in bytes at most, blocks of one length at least (where they hold SMALL rows), rows compared at a time.
BLOCK_BYTES, BLOCKS, SMALL, TILE_ROWS = 16 << 20, 5, 1024, 512
PARTITION_BYTES = 128 << 20
SLACK = 1e-9  # what rotating and summing in another order may cost


def unit_vector(v: list | None) -> np.ndarray | None:
    """The vector at length 1; None for one that is null, empty, zero, or holds a null or what isn't finite."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    x = np.array(v, np.float64)
    top = np.abs(x).max()
    if not (top > 0 and np.isfinite(top)):
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


def _second_moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Of the vectors of each length d the sum of products: partial sums by task, then one for each pair of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _by_length(b):
                total[d] = total.get(d, 0) + x.T @ x
        for d, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(np.arange(d * d)), pa.array(v.ravel())], ["d", "place", "v"])

    out: dict[int, np.ndarray] = {}
    for r in rows.select("d", "x").mapInArrow(run, "d long, place long, v double").groupBy("d", "place").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["d"], np.zeros(r["d"] ** 2))[r["place"]] = r["v"]
    return {d: v.reshape(d, d) for d, v in out.items()}


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, places in the batch, vectors) for each length among its rows (d, x)."""
    lengths = b.column("d").to_numpy()
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield d, at, np.frombuffer(b"".join(b.column("x").take(pa.array(at)).to_pylist()), np.float64).reshape(-1, d)


def similar_pairs(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b with a cosine from the threshold on. ra and rb are the rotated rows: their leading components come
    first, and a pair is given up once its sum so far and the norms of what is left can't reach the threshold."""
    d = ra.shape[1]
    sa = [np.sqrt((ra[:, c:] ** 2).sum(axis=1)) for c in cuts]
    sb = [np.sqrt((rb[:, c:] ** 2).sum(axis=1)) for c in cuts]
    first = cuts[0]
    part = ra[:, :first] @ rb[:, :first].T
    x, y = np.nonzero(part + sa[0][:, None] * sb[0][None, :] >= threshold - SLACK)
    part = part[x, y]
    for k in range(1, len(cuts) + 1):
        lo, hi = cuts[k - 1], cuts[k] if k < len(cuts) else d
        if k == len(cuts):
            break
        part = part + np.einsum("ij,ij->i", ra[x, lo:hi], rb[y, lo:hi])
        ok = part + sa[k][x] * sb[k][y] >= threshold - SLACK
        x, y, part = x[ok], y[ok], part[ok]
    # what is left is decided on the vectors themselves
    ok = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
    return x[ok], y[ok]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row that each of n rows reaches over the pairs."""
    root = np.arange(n)
    while len(a):
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _compare(rotations, threshold: float, tile: int):
    def run(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        rotation = rotations.value[d]
        cuts = sorted({max(1, d // 4), max(1, d // 2), max(1, 3 * d // 4)})
        vec = table.column("vec").to_numpy()
        order = np.argsort(vec, kind="stable")
        vec, second = vec[order], table.column("second").to_numpy()[order]
        x = np.frombuffer(b"".join(table.column("x").take(pa.array(order)).to_pylist()), np.float64).reshape(-1, d)
        turned = x @ rotation
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        rows_a, rows_b = (np.arange(len(vec)),) * 2 if one else (np.flatnonzero(~second), np.flatnonzero(second))
        links = np.zeros(len(vec), np.int64)
        pairs = []
        for s in range(0, len(rows_a), tile):
            pa_ = rows_a[s : s + tile]
            for t in range(s if one else 0, len(rows_b), tile):
                pb = rows_b[t : t + tile]
                i, j = similar_pairs(x[pa_], x[pb], turned[pa_], turned[pb], threshold, cuts)
                i, j = pa_[i], pb[j]
                ok = (vec[i] != vec[j]) & ((i < j) if one else True)
                pairs.append(np.array([i[ok], j[ok]]))
                links += np.bincount(pairs[-1].ravel(), minlength=len(vec))
        i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        hit = np.flatnonzero(links)
        return pa.table({"vec": pa.array(vec[hit], pa.int64()), "root": pa.array(vec[local_roots(len(vec), i, j)[hit]], pa.int64()), "links": pa.array(links[hit], pa.int64())})

    return run


def _blocks(led: DataFrame, block_rows: int | None, reach: float) -> DataFrame:
    """Rows (vec, d, x) once for each pair of blocks (i, j) they take part in; second tells the sides of a pair apart.

    What the driver sees is a few figures of each block."""
    spark = led.sparkSession
    edges: dict[int, np.ndarray] = {}
    most: dict[int, int] = {}
    for r in led.groupBy("d").count().collect():
        d, n = r["d"], r["count"]
        most[d] = block_rows or max(SMALL, BLOCK_BYTES // (8 * d))
        parts = max(math.ceil(n / most[d]), min(BLOCKS, math.ceil(n / SMALL)))
        edges[d] = np.unique(led.where(F.col("d") == d).approxQuantile("lead", [k / parts for k in range(1, parts)], 0.1 / parts)) if parts > 1 else np.zeros(0)
    held = spark.sparkContext.broadcast(edges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, lead = b.column("d").to_numpy(), b.column("lead").to_numpy()
            bucket = np.zeros(len(d), np.int64)
            for k in np.unique(d).tolist():
                bucket[d == k] = np.searchsorted(held.value[k], lead[d == k], side="right")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec", "d", "x", "lead")), pa.array(bucket)], ["vec", "d", "x", "lead", "bucket"])

    led = led.mapInArrow(place, "vec long, d long, x binary, lead double, bucket long")
    stats = sorted(led.groupBy("d", "bucket").agg(F.count("*").alias("n"), F.min("lead").alias("low"), F.max("lead").alias("high")).collect())
    plan, first, size = [], 0, 0
    for d in sorted(most):
        own = [s for s in stats if s["d"] == d]
        # a bucket of many equal leads is cut further; blocks are numbered along the component
        cut = [math.ceil(s["n"] / (2 * most[d])) for s in own]
        start = first + np.concatenate([[0], np.cumsum(cut)])
        low, high = np.array([s["low"] for s in own]), np.array([s["high"] for s in own])
        lo, hi = np.searchsorted(high, low - reach, side="left"), np.searchsorted(low, high + reach, side="right")
        for k, s in enumerate(own):
            plan.append((d, s["bucket"], int(start[k]), cut[k], int(start[lo[k]]), int(start[hi[k]]) - 1))
            size += s["n"] * (plan[-1][5] - plan[-1][4] + 1) * (8 * d + 40)
        first = int(start[-1])
    pairs = sum((p[5] - p[4] + 1) * p[3] for p in plan)
    placed = led.join(F.broadcast(spark.createDataFrame(plan, "d long, bucket long, first int, cut int, lo int, hi int")), ["d", "bucket"])
    placed = placed.withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec", "x"), F.col("cut")).cast("int")).withColumn("other", F.explode(F.sequence("lo", "hi")))
    placed = placed.select("vec", "d", "x", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"))
    return placed.repartition(max(1, math.ceil(size / PARTITION_BYTES), min(pairs, 4 * spark.sparkContext.defaultParallelism)), "i", "j")


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block_rows: int | None = None, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Links all pairs of vectors whose cosine, in double precision, is at least the threshold (over 0).

    Returns a row per id: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable),
    kept (vec_id = component_id). Vectors of one length are cut into blocks along their first principal component, of at
    most block_rows (as many as BLOCK_BYTES hold, where not given); blocks further apart there than similar vectors can
    be are never paired. Each pair of blocks is one task group, compared tile by tile, and returns counts and roots, not
    pairs. Among vectors without structure every pair of blocks is compared: a vector is then copied once a block.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, vectors of different
    lengths not with each other. Rows without an id are left out; rows that repeat an id are one vector, equal ones
    once, and others with the links of all. Ties take the smallest vec_id. Any number of equal vectors is compared in
    blocks of bounded size. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast("array<double>").alias("x")).where("vec is not null").dropDuplicates(["vec", "x"])
    out = rows.select("vec").distinct()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [unit_vector(v) for v in b.column(1).to_pylist()]
            keep = [i for i, v in enumerate(x) if v is not None]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([len(x[i]) for i in keep], pa.int64()), pa.array([x[i].tobytes() for i in keep], pa.binary())], ["vec", "d", "x"])

    valid = checkpoint(rows.mapInArrow(units, "vec long, d long, x binary"))
    moments = _second_moments(valid)
    if not moments:
        return out.select(F.col("vec").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"), F.lit(True).alias("kept"))
    rotations = spark.sparkContext.broadcast({d: np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1]) for d, m in moments.items()})

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            along = np.zeros(b.num_rows)
            for d, at, x in _by_length(b):
                along[at] = x @ rotations.value[d][:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(along)], ["vec", "d", "x", "lead"])

    led = checkpoint(valid.mapInArrow(lead, "vec long, d long, x binary, lead double"))
    placed = _blocks(led, block_rows, math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    found = checkpoint(placed.groupBy("i", "j").applyInArrow(_compare(rotations, threshold, tile_rows), "vec long, root long, links long"))
    component = connected_components(found, "vec", "root").withColumnRenamed("node", "vec")
    counts = found.groupBy("vec").agg(F.sum("links").alias("n_links"))
    out = out.join(counts, "vec", "left").join(component, "vec", "left").select(F.col("vec").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings, whatever their labels."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
