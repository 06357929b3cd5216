"""Quantile heads: histogram boosting with the pinball loss, and what each feature contributes to a score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

QUANTILES, ROUNDS, DEPTH, RATE, BINS, FEWEST = (0.1, 0.5, 0.9), 30, 2, 0.2, 32, 20


@dataclass
class Tree:
    """A tree in arrays: a row goes left where its feature is below the cut, right otherwise and where it is missing.
    feature is -1 at leaves; cover is the number of rows seen at a node."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: float, n_left: float, n_right: float) -> None:
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for n in (n_left, n_right):
            for x, v in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.cover, n)):
                x.append(v)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix."""
        at = np.zeros(len(x), np.int64)
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] < cut[node], left[node], right[node])
        return at

    def paths(self) -> Iterator[tuple[int, list[tuple[int, float, bool, float]]]]:
        """(leaf, steps) of each leaf; a step is feature, cut, whether it goes left, and the share of rows that do."""
        todo: list[tuple[int, list]] = [(0, [])]
        while todo:
            node, steps = todo.pop()
            if self.feature[node] < 0:
                yield node, steps
                continue
            for child, goes_left in ((self.left[node], True), (self.right[node], False)):
                todo.append((child, [*steps, (self.feature[node], self.cut[node], goes_left, self.cover[child] / max(self.cover[node], 1e-300))]))

    def contributions(self, x: np.ndarray, n_features: int) -> tuple[float, np.ndarray]:
        """(expected value, Shapley values of each row and feature) where features outside a coalition follow the shares
        of rows at each split. A leaf's game is a product over the features of its path, so only those take part."""
        out = np.zeros((len(x), n_features))
        expected = 0.0
        for leaf, steps in self.paths():
            own: dict[int, tuple[np.ndarray, float]] = {}
            for f, cut, goes_left, share in steps:
                holds, total = own.get(f, (np.ones(len(x), bool), 1.0))
                own[f] = holds & ((x[:, f] < cut) == goes_left), total * share
            expected += self.value[leaf] * float(np.prod([s for _, s in own.values()]))
            names, m = list(own), len(own)
            for f in names:
                others = [k for k in names if k != f]
                total = np.zeros(len(x))
                for size in range(m):
                    weight = factorial(size) * factorial(m - size - 1) / factorial(m)
                    for inside in combinations(others, size):
                        total += weight * np.prod([own[k][0].astype(float) if k in inside else np.full(len(x), own[k][1]) for k in others], axis=0)
                out[:, f] += self.value[leaf] * total * (own[f][0] - own[f][1])
        return expected, out


@dataclass
class QuantileModel:
    features: list[str]
    quantiles: tuple[float, ...]
    base: list[float]
    rate: float
    trees: list[list[Tree]]  # by quantile

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores (rows, quantiles) as boosted, which may cross."""
        out = np.tile(np.array(self.base, float), (len(x), 1))
        for k, trees in enumerate(self.trees):
            for t in trees:
                out[:, k] += self.rate * np.array(t.value)[t.leaf_of(x)]
        return out

    def contributions(self, x: np.ndarray, k: int) -> tuple[float, np.ndarray]:
        """(expected score, contributions) of a quantile's score: they sum to it with the expected one."""
        expected, out = self.base[k], np.zeros((len(x), len(self.features)))
        for t in self.trees[k]:
            e, c = t.contributions(x, len(self.features))
            expected, out = expected + self.rate * e, out + self.rate * c
        return expected, out


def fit_quantiles(
    rows: DataFrame, features: list[str], label: str, quantiles: tuple[float, ...] = QUANTILES, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, fewest: int = FEWEST
) -> QuantileModel:
    """A boosted model of several quantiles of a label. Features are cut into `bins` once; each round grows one tree for
    each quantile, all at once: tasks sum up the loss's gradient by (quantile, node, feature, bin), Spark adds that up, and
    the driver, which sees as many sums as there are such cells, picks splits. A leaf's value is the quantile of what is left
    of the label there, again as an aggregate. Rows stay where they are.

    Rows without a label are left out; missing and non-finite features go right at every split. Without rows the model is 0."""
    clean = rows.where(F.col(label).isNotNull() & ~F.isnan(label)).select(*(F.when(F.abs(f) < float("inf"), F.col(f).cast("double")).alias(f) for f in features), F.col(label).cast("double").alias("y_"))
    probs = [i / bins for i in range(1, bins)]
    edges = [sorted(set(e)) or [0.0] for e in clean.approxQuantile(features, probs, 0.002)]
    base = clean.agg(F.percentile_approx("y_", list(quantiles), 10_000)).first()[0] or [0.0] * len(quantiles)
    splits = [[-float("inf"), *e, float("inf")] for e in edges]
    cut = Bucketizer(splitsArray=splits, inputCols=features, outputCols=[f"b{i}_" for i in range(len(features))], handleInvalid="keep")
    table = checkpointed(cut.transform(clean.na.fill(float("nan"), features)).select(F.array(*(F.col(f"b{i}_").cast("int") for i in range(len(features)))).alias("b"), "y_"))
    model = QuantileModel(features, tuple(quantiles), list(base), rate, [[] for _ in quantiles])
    # trees over bins while growing: a row goes left where its bin is below the split's
    grown: list[list[Tree]] = [[] for _ in quantiles]

    def scores(b: np.ndarray) -> np.ndarray:
        return QuantileModel(features, model.quantiles, model.base, rate, grown).raw(b)

    for _ in range(rounds):
        trees = [Tree() for _ in quantiles]
        for level in range(depth):

            def sums(frames: Iterator[pd.DataFrame], trees=trees) -> Iterator[pd.DataFrame]:
                total: dict[tuple[int, int, int], np.ndarray] = {}
                for f in frames:
                    b = np.stack(f["b"].to_numpy()).astype(float) if len(f) else np.zeros((0, len(features)))
                    now, y = scores(b), f["y_"].to_numpy(float)
                    for k, q in enumerate(quantiles):
                        g, node = q - (y < now[:, k]), trees[k].leaf_of(b)
                        for n in np.unique(node):
                            at = node == n
                            for j in range(len(features)):
                                bin_ = b[at, j].astype(int)
                                cell = total.setdefault((k, int(n), j), np.zeros((2, bins + 2)))
                                cell += np.stack([np.bincount(bin_, minlength=bins + 2), np.bincount(bin_, g[at], minlength=bins + 2)])
                out = [(*key, i, c[0, i], c[1, i]) for key, c in total.items() for i in np.flatnonzero(c[0])]
                yield pd.DataFrame(out, columns=["k", "node", "feature", "bin", "n", "g"])

            cells = table.mapInPandas(sums, "k int, node int, feature int, bin int, n double, g double").groupBy("k", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).toPandas()
            for (k, node), own in cells.groupby(["k", "node"]):
                best = None
                for j, of in own.groupby("feature"):
                    of = of.sort_values("bin")
                    n, g = of["n"].cumsum().to_numpy(), of["g"].cumsum().to_numpy()
                    if len(of) < 2:
                        continue
                    a, rest = n[:-1], n[-1] - n[:-1]
                    gain = np.where((a >= fewest) & (rest >= fewest), g[:-1] ** 2 / a + (g[-1] - g[:-1]) ** 2 / rest - g[-1] ** 2 / n[-1], -1.0)
                    i = int(gain.argmax())
                    if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                        best = gain[i], int(j), int(of["bin"].iloc[i]), a[i], rest[i]
                if level == 0:
                    trees[k].cover[node] = float(own[own["feature"] == own["feature"].iloc[0]]["n"].sum())
                if best:
                    _, j, bin_, n_left, n_right = best
                    trees[k].split(int(node), j, bin_ + 0.5, n_left, n_right)

        def left_over(frames: Iterator[pd.DataFrame], trees=trees) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    b = np.stack(f["b"].to_numpy()).astype(float)
                    now, y = scores(b), f["y_"].to_numpy(float)
                    for k in range(len(quantiles)):
                        yield pd.DataFrame({"k": k, "leaf": trees[k].leaf_of(b), "rest": y - now[:, k]})

        leaves = table.mapInPandas(left_over, "k int, leaf int, rest double").groupBy("k", "leaf").agg(F.percentile_approx("rest", list(quantiles), 10_000).alias("q")).collect()
        for r in leaves:
            trees[r["k"]].value[r["leaf"]] = r["q"][r["k"]]
        for k, t in enumerate(trees):
            grown[k].append(t)
    for k, trees in enumerate(grown):
        # a bin below j + 0.5 is a value below that bin's upper edge
        model.trees[k] = [Tree(t.feature, [edges[f][int(c)] if f >= 0 and int(c) < len(edges[f]) else float("inf") if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut, strict=True)], t.left, t.right, t.value, t.cover) for t in trees]
    return model


def _matrix(columns) -> np.ndarray:
    x = np.column_stack([pd.to_numeric(c).to_numpy(float) for c in columns])
    return np.where(np.isfinite(x), x, np.nan)


def quantile_columns(rows: DataFrame, model: QuantileModel, names: list[str]) -> DataFrame:
    """Adds the model's quantiles in ascending order under these names; they never cross."""

    @F.pandas_udf("array<double>")
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(np.sort(model.raw(_matrix(columns)), axis=1)))

    out = rows.withColumn("q_", scored(*(F.col(f).cast("double") for f in model.features)))
    return out.withColumns({n: F.col("q_")[i] for i, n in enumerate(names)}).drop("q_")


def contribution_columns(rows: DataFrame, model: QuantileModel, k: int) -> DataFrame:
    """Adds expected and contributions (a number for each feature, in order): with the expected score they sum to the
    row's raw score for the model's k-th quantile."""

    @F.pandas_udf("struct<expected:double,contributions:array<double>>")
    def explained(*columns: pd.Series) -> pd.DataFrame:
        expected, c = model.contributions(_matrix(columns), k)
        return pd.DataFrame({"expected": [expected] * len(c), "contributions": list(c)})

    return rows.withColumn("e_", explained(*(F.col(f).cast("double") for f in model.features))).select(*rows.columns, "e_.*")


def top_contributions(explained: DataFrame, key: list[str], model: QuantileModel, most: int = 6) -> DataFrame:
    """The `most` features that move each row's score furthest: (key, rank, feature, contribution), ties by name."""
    pairs = F.arrays_zip(F.array(*map(F.lit, model.features)).alias("feature"), F.col("contributions").alias("contribution"))
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct((-F.abs(p["contribution"])).alias("by"), p["feature"].alias("feature"), p["contribution"].alias("contribution"))))
    return explained.select(*key, F.posexplode(F.slice(ordered, 1, most)).alias("rank", "p")).select(*key, (F.col("rank") + 1).alias("rank"), "p.feature", "p.contribution")


def feature_shares(explained: DataFrame, model: QuantileModel) -> DataFrame:
    """(feature, share): each feature's part in all rows' absolute contributions."""
    pairs = explained.select(F.explode(F.arrays_zip(F.array(*map(F.lit, model.features)).alias("feature"), F.col("contributions").alias("c"))).alias("p"))
    total = pairs.groupBy("p.feature").agg(F.sum(F.abs("p.c")).alias("size"))
    whole = total.agg(F.sum("size").alias("whole"))
    return total.join(F.broadcast(whole)).select("feature", F.coalesce(F.col("size") / F.nullif("whole", F.lit(0.0)), F.lit(0.0)).alias("share"))
