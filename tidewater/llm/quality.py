"""Document quality by a regularised quadratic discriminant over transformed text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_spread, word_hashes

SHRINKAGE, CUT, PRIOR = 0.1, 0.3, 15
#: Labelled rows learned from at most, of each class.
TRAIN_ROWS = 20_000
FEATURES = (
    "words word_length upper digits marks symbols bars exclamations repeats recurring one_word_runs lines line_copies stops"
).split()

_KIND = np.full(256, 7, np.uint8)  # 7: letters and bytes of longer characters
for _c, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), (b"0123456789", 1), (b".,;:'\"()-?", 2), (b"#$%&*@^_=+~<>{}[]/\\`", 3), (b"|", 4), (b"!", 5), (b" \t\r\n", 6)):
    _KIND[list(_c)] = _k


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text: logs of sizes, square roots of shares."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KIND[data], minlength=8)
    words = text.split() if text else []
    n = len(words)
    solid = max(1, len(data) - kinds[6])
    h = word_hashes(words)
    same = h[1:] == h[:-1]
    lines = [x for x in (text or "").split("\n") if x]
    stops = sum(w[-1] in ".,;:?" for w in words)
    share = lambda x, of: np.sqrt(x / (of + PRIOR))  # noqa: E731  short texts can't show extreme shares
    return np.array(
        [
            np.log1p(n),
            np.log1p(solid / max(1, n)),
            share(kinds[0], solid),
            share(kinds[1], solid),
            share(kinds[2], solid),
            share(kinds[3], solid),
            share(kinds[4], n),
            share(kinds[5], n),
            share(same.sum(), n),
            share(n - len(np.unique(h)), n),
            share(_longest_run(same), n),
            share(len(lines), n),
            share(len(lines) - len(set(lines)), len(lines)),
            share(stops, n),
        ]
    )


def _longest_run(same: np.ndarray) -> int:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return int((edge[1::2] - edge[::2]).max()) if len(edge) else 0


@dataclass
class Discriminant:
    """Class means, cached inverse Cholesky factors, and log determinants of the shrunk covariances."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 by the difference of the classes' log densities."""
        z = (x - self.centre) / self.scale
        density = [p - d - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, d, p in zip(self.means, self.inverse, self.log_det, self.log_prior, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -60, 60)))


def discriminant(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From each class's count, feature sums and sums of products. A class without rows takes the other's figures."""
    d = sums.shape[1]
    total = max(1.0, n.sum())
    centre = sums.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(squares.sum(axis=0)) / total - centre**2, 1e-6))
    means, inverse, log_det = [], [], []
    pooled = squares.sum(axis=0) / total - np.outer(centre, centre)
    for k in range(len(n)):
        mean = sums[k] / n[k] if n[k] else centre
        cov = squares[k] / n[k] - np.outer(mean, mean) if n[k] > 1 else pooled
        cov = cov / np.outer(scale, scale)
        # towards the class's own mean variance, and a floor for statistics that never vary in a class
        cov = (1 - shrinkage) * cov + shrinkage * (np.trace(cov) / d) * np.eye(d) + 1e-3 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append((mean - centre) / scale)
        inverse.append(np.linalg.inv(factor))
        log_det.append(np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(inverse), np.array(log_det), np.log((n + 1) / (n + 1).sum()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = SHRINKAGE, train_rows: int = TRAIN_ROWS) -> Discriminant:
    """Learns from labelled rows: partial sums by task, then one sum for each class and pair of statistics.

    Of each class at most train_rows labels count, those with the least hashes of their id: few enough to go to every
    task, which then measures only texts that are learned from."""
    d = len(FEATURES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False).astype(int)
            x = np.array([statistics(t.as_py()) for t in b.column(1)]).reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        m = sums.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], m)), pa.array(np.tile(np.arange(m), 2)), pa.array(sums.ravel())], ["class", "place", "v"])

    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    hashed = known.withColumn("h", F.xxhash64("id"))
    few = [hashed.where(F.col("y") == k).orderBy("h", "id").limit(train_rows).select("id", "y") for k in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = texts.join(F.broadcast(few[0].unionByName(few[1])), "id").select("y", "text")
    rows = own.mapInArrow(partial, "class long, place long, v double").groupBy("class", "place").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + d + d * d))
    for r in rows:
        sums[r["class"], r["place"]] = r["v"]
    return discriminant(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d), shrinkage)


def score_column(spark: SparkSession, model: Discriminant, text: str = "text") -> Column:
    """Score of each whole text, 0 to 1; null and empty texts have the score of no words."""
    held = spark.sparkContext.broadcast(model)

    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))))

    return F.pandas_udf(scores, "double")(F.col(text).cast("string"))


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fold: crc32 of the id as text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col(id_col).cast("string")) % 5 != 0)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; labels of the held-out fold are never learned from.

    Repeated rows are scored each; a repeated labelled id counts as often as it is labelled. A null id isn't held out.
    Without labels of a class every text scores by the other class's figures. An empty table gives no rows; other
    columns are ignored and never inputs.
    """
    model = fit(docs, learnable(labels, id_col), id_col, text_col, **options)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), score_column(docs.sparkSession, model, text_col).alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return score_documents(read_spread(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
