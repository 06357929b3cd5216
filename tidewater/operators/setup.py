"""The setup head: an ensemble over purged time folds, each member calibrated on the block after what it learned from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .choices import time_folds

#: A stepwise curve needs this many rows of each class in every fold; with fewer it is a logistic one.
STEPWISE, FEWEST_TRAIN = 3000, 60


class NotEnoughRows(ValueError):
    """No fold has every class among what it would learn from."""


@dataclass
class Curve:
    """A probability made honest: by straight lines between points, or a logistic curve of its logit."""

    x: list[float]
    y: list[float]
    slope: float = 0.0
    offset: float = 0.0

    def __call__(self, p: np.ndarray) -> np.ndarray:
        if self.x:
            return np.interp(p, self.x, self.y)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.offset)))


@dataclass
class SetupModel:
    features: list[str]
    classes: int
    version: str
    method: str
    members: list[tuple[Model, list[Curve]]]
    folds: list[dict]

    def check(self, names: list[str], version: str) -> None:
        """Refuses features that the head wasn't trained on."""
        if version != self.version:
            raise ValueError(f"features of version {version}; the head was trained on {self.version}")
        if list(names) != self.features:
            raise ValueError(f"the head was trained on other features, or on these in another order: {self.features}")


def learner(features: list[str], label: str = "label_", trees: int = 40, depth: int = 5, seed: int = 7) -> Pipeline:
    filled = [f"{f}_f" for f in features]
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features_"), RandomForestClassifier(featuresCol="features_", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)])


def curve(scored: DataFrame, stepwise: bool, score: str = "p", hit: str = "hit") -> Curve:
    """The curve of outcomes (0 or 1) on scores: the engine's isotonic regression, in which equal scores are one point, or
    a logistic curve of the logit."""
    rows = scored.select(F.col(score).cast("double").alias("p"), F.col(hit).cast("double").alias("hit"))
    if stepwise:
        model = IsotonicRegression(featuresCol="p", labelCol="hit").fit(rows)
        return Curve([float(v) for v in model.boundaries], [float(v) for v in model.predictions])
    near = F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = VectorAssembler(inputCols=["z"], outputCol="z_").transform(rows.withColumn("z", F.log(near / (1 - near))))
    model = LogisticRegression(featuresCol="z_", labelCol="hit", regParam=1e-3).fit(rows)
    if model.numClasses < 2 or len(model.coefficients) == 0:
        share = rows.agg(F.avg("hit")).first()[0] or 0.0
        return Curve([0.0, 1.0], [share, share])
    return Curve([], [], float(model.coefficients[0]), float(model.intercept))


def _probabilities(model: Model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows).withColumn("p_", vector_to_array("probability"))
    return out.select(*rows.columns, "p_")


def fit_setup(rows: DataFrame, features: list[str], label: str, start: str, end: str, classes: int = 3, splits: int = 5, gap: int = 48, version: str = "1", stepwise_from: int = STEPWISE) -> SetupModel:
    """A model of a label in 0 .. classes - 1. Folds go by time: each learns from rows before its block, `gap` starts
    left out, of these only rows whose outcome (`end`) was known by then, and is calibrated on the block, class by class.

    Folds whose training part lacks a class or has fewer than FEWEST_TRAIN rows are left out; if none is left that is
    an error. Rows without a label are left out; missing features take the fold's median."""
    clean = rows.where(F.col(label).isNotNull()).withColumn("label_", F.col(label).cast("double"))
    placed = checkpointed(time_folds(clean.select(*features, "label_", start, end), start, end, splits, gap))
    counts: dict[int, dict] = {}
    for r in placed.groupBy("fold", "part", "label_").count().collect():  # folds times classes
        counts.setdefault(r["fold"], {"train": {}, "calibrate": {}})[r["part"]][int(r["label_"])] = r["count"]
    usable = [f for f, c in sorted(counts.items()) if len(c["train"]) == classes and sum(c["train"].values()) >= FEWEST_TRAIN and c["calibrate"]]
    if not usable:
        raise NotEnoughRows("no fold has every class in its training part")
    stepwise = min(counts[f]["calibrate"].get(k, 0) for f in usable for k in range(classes)) >= stepwise_from
    members = []
    for f in usable:
        own = placed.where(F.col("fold") == f)
        model = learner(features).fit(own.where("part = 'train'"))
        scored = checkpointed(_probabilities(model, own.where("part = 'calibrate'").select(*features, "label_")).select("label_", "p_"))
        members.append((model, [curve(scored.select(F.col("p_")[k].alias("p"), (F.col("label_") == k).alias("hit")), stepwise) for k in range(classes)]))
    return SetupModel(features, classes, version, "stepwise" if stepwise else "logistic", members, [{"train": sum(counts[f]["train"].values()), "calibrate": sum(counts[f]["calibrate"].values())} for f in usable])


def _honest(curves: list[Curve]):
    def honest(p: pd.Series) -> pd.Series:
        raw = np.stack(p.to_numpy()) if len(p) else np.zeros((0, len(curves)))
        q = np.column_stack([c(raw[:, k]) for k, c in enumerate(curves)])
        total = q.sum(axis=1, keepdims=True)
        return pd.Series(list(np.where(total > 0, q / np.where(total > 0, total, 1), 1 / len(curves))))

    return F.pandas_udf(honest, "array<double>")


def setup_columns(rows: DataFrame, model: SetupModel, name: str = "p") -> DataFrame:
    """Adds the classes' probabilities as an array: each member's calibrated ones, made to sum to 1 (even where all are
    0), then averaged over the members."""
    out = rows.withColumn("sum_", F.array(*(F.lit(0.0) for _ in range(model.classes))))
    for member, curves in model.members:
        out = _probabilities(member, out).withColumn("q_", _honest(curves)("p_")).drop("p_")
        out = out.withColumn("sum_", F.zip_with("sum_", "q_", lambda a, b: a + b)).drop("q_")
    n = len(model.members)
    return out.withColumn(name, F.transform("sum_", lambda x: x / n)).drop("sum_")
