"""Queries over trained heads: quantiles of coming returns, and what moves them. Fitted, so no SQL gives their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosted, indicators, lists, setup
from ..session import checkpointed, table
from .common import daily, shown

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FEATURES = [*(f"ret_{n}" for n in (1, 2, 3, 5, 10, 20)), "rv_20", "rv_ratio", "range_pos_20", "dow"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _fitted(spark, d, rounds: int):
    rows = indicators.returns(daily(spark, d))
    return rows, boosted.fit_quantiles(rows, FEATURES, "target", rounds=rounds)


@query
def quantile_heads(spark, d):
    """For each bar the quantiles of its log return five bars on."""
    rows, model = _fitted(spark, d, 12)
    return shown(boosted.quantile_columns(rows, model, ["q10", "q50", "q90"]), "symbol", "ts", "q10", "q50", "q90")


@query
def top_contributions(spark, d):
    """For each bar the six features that move its median furthest."""
    rows, model = _fitted(spark, d, 6)
    return shown(boosted.top_contributions(boosted.contribution_columns(rows, model, 1), ["symbol", "ts"], model))


@query
def feature_shares(spark, d):
    """Each feature's part in what moves the upper quantile, over all bars."""
    rows, model = _fitted(spark, d, 6)
    return shown(boosted.feature_shares(boosted.contribution_columns(rows, model, 2), model))


@query
def setup_head(spark, d):
    """For each bar calibrated odds that the next five bars rise by a tenth, fall by one, or neither."""
    rows = indicators.returns(daily(spark, d)).withColumns({"label": F.when(F.col("target") > 0.1, 0).when(F.col("target") < -0.1, 1).when(F.col("target").isNotNull(), 2), "t": F.unix_seconds("ts")})
    rows = rows.withColumn("t_end", F.col("t") + 5 * 86400)
    model = setup.fit_setup(rows, FEATURES, "label", "t", "t_end", splits=3, gap=5)
    out = setup.setup_columns(rows, model)
    return shown(out.select("symbol", "ts", *(F.col("p")[k].alias(n) for k, n in enumerate(("p_buy", "p_sell", "p_hold")))))


#: Of 32 lists a search probes 28: the given vectors lie in no clusters, so fewer lists would miss more.
LISTS, PROBES = 32, 28


@query
def listed_neighbours(spark, d):
    """The hundred nearest vectors of each stated query by inverted lists over all vectors."""
    vectors = table(spark, d, "embeddings")
    centroids = lists.fit_centroids(vectors, LISTS)
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return shown(lists.nearest(checkpointed(lists.listed(vectors, centroids)), centroids, queries, 100, PROBES), "query_id", "doc_id", "score", "rank")
