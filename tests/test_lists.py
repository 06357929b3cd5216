"""Inverted lists: exact with all of them probed, nearly so with few on vectors that lie in clusters."""

import numpy as np

from tidewater.operators import lists, retrieval


def test_few_lists_find_nearly_all_and_all_lists_all(spark):
    r = np.random.default_rng(2)
    centers = r.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centers[i % 12] + 0.35 * r.normal(size=16)]) for i in range(1500)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0]), (9003, [float("nan")] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").persist()
    queries = vectors.where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding as q")
    centroids = lists.fit_centroids(vectors, 24)
    index = lists.listed(vectors, centroids).persist()
    assert index.count() == 1500
    exact = retrieval.vector_top(vectors.where("vec_id < 9000"), queries.where("query_id < 9000"), 50)
    few = lists.nearest(index, centroids, queries, 50, 6, group_rows=100)
    got = lists.recall(few, exact)
    print("recall at 50 with 6 of 24 lists:", got)
    assert 0.95 <= got <= 1
    every = lists.nearest(index, centroids, queries, 50, 24)
    assert lists.recall(every, exact) == 1
    assert {(x["query_id"], x["rank"]): round(x["score"], 9) for x in every.collect()} == {(x["query_id"], x["rank"]): round(x["score"], 9) for x in exact.collect()}


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    centroids = lists.fit_centroids(none, 4)
    index = lists.listed(none, centroids)
    assert lists.nearest(index, centroids, none.selectExpr("vec_id as query_id", "embedding as q"), 3, 2).count() == 0
