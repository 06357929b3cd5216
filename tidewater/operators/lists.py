"""Approximate nearest vectors: inverted lists under centroids, exact cosines for what the probed lists hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import top

#: Vectors that centroids are fitted on at most, rounds of fitting, and rows of a list that meet in one task.
SAMPLE, ROUNDS, GROUP_ROWS = 20_000, 12, 20_000


def _units(vectors) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of unit vectors, which rows have one): null, zero and non-finite vectors have none."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    out = np.zeros((len(vectors), width))
    good = np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width and width:
            x = np.array([np.nan if c is None else c for c in v], float)
            n = np.sqrt(x @ x)
            if np.isfinite(n) and n > 0:
                out[i], good[i] = x / n, True
    return out, good


def fit_centroids(vectors: DataFrame, lists: int, vector_col: str = "embedding", id_col: str = "vec_id", sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of the vectors with the least hashes of their id, at most `sample` of them, which the driver holds;
    what is listed under them is every vector. Fewer distinct vectors than lists give as many centroids as there are."""
    rows = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(F.lit(11), id_col), id_col).limit(sample).select(vector_col).toPandas()
    x, good = _units(list(rows[vector_col]))
    x = x[good]
    if not len(x):
        return np.zeros((0, 0))
    centers = np.unique(x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)], axis=0)
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centers = np.where(size > 1e-12, sums / np.where(size > 1e-12, size, 1), centers)
    return centers


def listed(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(doc_id, v, list): every vector under its nearest centroid; those without a direction are in no list."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, good = _units(list(f["v"]))
            f = f[good].copy()
            f["list"] = (x[good] @ centroids.T).argmax(axis=1) if len(f) else np.zeros(0, int)
            yield f

    kinds = dict(vectors.dtypes)
    rows = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v"))
    return rows.mapInPandas(run, f"doc_id {kinds[id_col]}, v {kinds[vector_col]}, list int") if len(centroids) else rows.withColumn("list", F.lit(0)).where("false")


def nearest(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int, query_id: str = "query_id", query_vector: str = "q", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, doc_id, score, rank): of the rows in each query's `probes` nearest lists the k with the largest cosine, in
    double precision, ties by id. A task compares the queries of a list with at most about group_rows of its rows and
    passes on k for each query; with all lists probed the result is exact. Queries without a direction find nothing."""
    most = index.groupBy("list").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // group_rows))
    kinds = dict(queries.dtypes)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, good = _units(list(f["q"]))
            f, x = f[good], x[good]
            if len(f) and len(centroids):
                order = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": np.repeat(f["query_id"].to_numpy(), order.shape[1]), "q": [q for q in f["q"] for _ in range(order.shape[1])], "list": order.ravel()})

    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q")).mapInPandas(probe, f"query_id {kinds[query_id]}, q {kinds[query_vector]}, list int")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = index.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))

    def best(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("doc_id")
        out = []
        if len(own) and len(asked):
            scores = _units(list(asked["q"]))[0] @ _units(list(own["v"]))[0].T
            for q, s in zip(asked["query_id"], scores, strict=True):
                at = np.argsort(-s, kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": q, "doc_id": own["doc_id"].to_numpy()[at], "score": s[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

    schema = f"query_id {kinds[query_id]}, doc_id {dict(index.dtypes)['doc_id']}, score double"
    return top(rows.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInPandas(best, schema), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (query_id, doc_id) that were found; 1 where there are none."""
    n = exact.count()
    return exact.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").count() / n if n else 1.0
