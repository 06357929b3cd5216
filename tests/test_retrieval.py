"""Searches and packing against plain versions, in small blocks and on more rows than one task may hold."""

import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewater.operators import retrieval
from tidewater.plans import catalog


def shown(df):
    return sorted(map(str, df.select("query_id", "doc_id", "rank", F.round("score", 12).alias("score")).collect()))


def test_blocks_of_vectors_and_queries_give_the_plain_ranks(spark):
    r = np.random.default_rng(3)
    own = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(300)] + [(500, None), (501, [0.0] * 4), (502, [1.0, None, 1.0, 1.0]), (503, [1.0, 2.0]), (504, [float("nan")] * 4), (None, [1.0] * 4)]
    v = spark.createDataFrame(own, "vec_id long, embedding array<double>")
    q = v.where("vec_id is null or vec_id % 7 = 0 or vec_id > 499").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = v.select(F.col("vec_id").alias("doc_id"), "embedding").crossJoin(q)
    plain = shown(retrieval.top(pairs.select("query_id", "doc_id", retrieval.cosine(F.col("embedding"), F.col("q")).alias("score")), 5))
    assert shown(retrieval.vector_top(v, q, 5)) == plain
    assert shown(retrieval.vector_top(v, q, 5, row_bytes=3000, query_bytes=900)) == plain
    numbers = v.select("vec_id", (F.col("vec_id") % 13).alias("n"))
    asked = numbers.where("vec_id % 11 = 0").select(F.col("vec_id").alias("query_id"), F.col("n").alias("own"))
    pairs = numbers.select(F.col("vec_id").alias("doc_id"), "n").crossJoin(asked)
    plain = shown(retrieval.top(pairs.select("query_id", "doc_id", (-F.abs(F.col("n") - F.col("own"))).cast("double").alias("score")), 5))
    assert shown(retrieval.value_top(numbers, asked, 5, "vec_id", "n", "query_id", "own", row_bytes=1000, query_bytes=200)) == plain


def test_any_number_of_queries_is_answered(spark):
    v = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    q = spark.range(10_500).select(F.col("id").alias("query_id"), F.array(F.cos("id"), F.sin("id")).alias("q"))
    got = retrieval.vector_top(v, q, 2)
    assert got.count() == 21_000 and got.where("rank = 1 and query_id < 40 and query_id <> doc_id").count() == 0


def test_packing_gathers_no_more_rows_than_the_budget_allows(spark):
    r = random.Random(5)
    rows = [(g, i, r.choice([0, 1, 3, 7, 30, 60, 200, None]) if i % 40 else 5) for g in ("a", "b", None) for i in range(400)]
    rows += [("big", 0, 101), ("big", 1, 0), ("big", 2, 5), ("null", 0, None), ("null", 1, 1), ("zero", 0, 0), ("zero", 1, 100), ("zero", 2, 0), ("zero", 3, 1)]
    expect = []
    for g in {g for g, _, _ in rows}:
        used, some = 0, False
        for _, i, n in sorted((i % 17, i, n) for x, i, n in rows if x == g):
            if not some or used is not None and n is not None and used + n <= 100:
                used = None if n is None else used + n
                expect.append((str(g), i))
            some = True
    df = spark.createDataFrame(rows, "source string, doc_id long, n int")
    pack = lambda x: retrieval.pack_budget(x, "source", [F.col("doc_id") % 17, F.col("doc_id")], "n", 100)
    assert sorted((str(x["source"]), x["doc_id"]) for x in pack(df).select("source", "doc_id").collect()) == sorted(expect)
    # a group of any number of rows: what would not fit into one cell
    many = spark.range(200_000).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.lit(1).alias("n"))
    assert pack(many).count() == 100
    assert "collect_list" not in pack(many)._jdf.queryExecution().optimizedPlan().toString()


def test_squeezed_lines_take_linear_time(spark):
    n = 20_000
    long = "\n".join(f"  line   {i // 2}" for i in range(n))
    odd = [None, "", "\n", "\n\n\n", "a", "a\n", "a\r\n", "a\n\n", "\n\na\n\n\n\nb \n b\n", " \n a  a\na a\n\n\n\na a", "a\n\t\na", "x\nx\nx\n\nx\n"]
    want = [None, "", "", "", "a", "a", "a", "a\n", "a\n\nb [×2]", "a a [×2]\n\na a", "a\n\na", "x [×3]\n\nx"]
    rows = spark.createDataFrame(list(enumerate([*odd, long])), "i int, t string").coalesce(1)
    start = time.monotonic()
    got = [r["x"] for r in rows.select("i", retrieval.normalize_whitespace(F.col("t")).alias("x")).orderBy("i").collect()]
    assert time.monotonic() - start < 30
    assert got[:-1] == want and got[-1] == "\n".join(f"line {i} [×2]" for i in range(n // 2))


def test_texts_of_odd_blanks_are_squeezed_and_collapsed_as_in_the_sql(spark, tmp_path):
    odd = [None, "", "\n", " \n\t", "\r\n", "a\n\nb", "a\na. a"]
    for c in "\x0b\x0c\x1f\x85\u00a0\u1680\u180e\u2003\u200b\u2028\u202f\u3000\ufeff":
        odd += [c, f"{c}a", f"a{c}", f"a{c}b", f"a\n{c}\nb", f"a {c}\na", f"{c}{c}a\na", f"a.{c} a. {c}"]
    pq.write_table(pa.table({"doc_id": range(len(odd)), "text": pa.array(odd, pa.string())}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    for name in ("squeezed_texts", "collapse_runs"):
        got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).select("doc_id", "h").collect()))
        assert got == sorted(con.execute(f"select doc_id, h from ({catalog.ORACLES[name]})").fetchall()), name
