"""The stored index gives the scores of a scan, takes further documents as they come, and skips blocks."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.operators import retrieval
from tidewater.operators.index import TermIndex, postings


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    common = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(common) for _ in range(r.randint(0, 40))) + (f" rare{i % 40}" if i % 5 == 0 else "")) for i in range(1200)]
    return spark.createDataFrame([*rows, (5000, None), (5001, ""), (5002, "w1 w1 w1 only1")], "doc_id long, text string")


def rows_of(df):
    return sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def test_scores_of_segments_are_those_of_one_scan(spark, texts, tmp_path):
    queries = spark.createDataFrame([(1, "w1 w2 rare3"), (2, "only1 W1 w1"), (3, "nothing here"), (4, ""), (5, "rare0 rare5")], "query_id long, query string")
    index = TermIndex(spark, f"{tmp_path}/index", buckets=8, block_docs=50)
    index.add(texts.where("doc_id < 500"))
    first = rows_of(index.search(queries))
    assert first == rows_of(retrieval.bm25(texts.where("doc_id < 500"), queries))
    index.add(texts.where("doc_id >= 500"))
    index.add(texts.where("false"))
    want = retrieval.bm25(texts, queries)
    assert rows_of(index.search(queries)) == rows_of(want) != first
    best = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in retrieval.top(want, 7).collect())
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in index.search_top(queries, 7).collect()) == best


def test_blocks_that_cannot_hold_a_best_one_are_left_out(spark, texts, tmp_path):
    index = TermIndex(spark, f"{tmp_path}/index", buckets=8, block_docs=50)
    index.add(texts)
    asked = spark.createDataFrame([(5, "rare0 w1"), (6, "only1 w3")], "query_id long, query string")
    needed = index.bounded(asked, 3).groupBy("query_id").agg(F.count("*").alias("all"), F.sum(F.col("needed").cast("int")).alias("read")).collect()
    assert all(r["read"] < 0.8 * r["all"] for r in needed)
    plan = index.search(asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_a_block_is_counted_in_one_task(spark, tmp_path):
    """Words are counted where their block lies; blocks are bounded by bytes too, and nothing but postings is stored."""
    block = pa.table({"block": pa.array([3] * 4, pa.int32()), "doc_id": [9, 2, 5, 7], "w": pa.array([["b", "a", "b"], ["a"], None, []], pa.list_(pa.string()))})
    got = postings(block).sort_by("term").to_pylist()
    assert [(r["term"], r["block"], r["ids"], r["tfs"], r["sizes"], r["n"], r["most"], r["least"]) for r in got[:2]] == [("a", 3, [2, 9], [1, 1], [1, 3], 2, 1, 1), ("b", 3, [9], [2], [3], 1, 2, 3)]
    assert [got[2][k] for k in ("term", "docs", "sized", "words")] == [None, 4, 3, 4]
    empty = postings(block.slice(2, 1)).to_pylist()
    assert [(r["docs"], r["sized"], r["words"]) for r in empty] == [(1, 0, None)]
    index = TermIndex(spark, f"{tmp_path}/index", buckets=8)
    index.add(spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("much text "), 100_000).alias("text")))
    assert spark.read.parquet(f"{tmp_path}/index/postings").where("term = 'much'").count() > 1
    assert os.listdir(f"{tmp_path}/index") == ["postings"]
