"""A stored inverted index: postings by term in buckets and blocks with their maxima, segments for added documents, pruned search."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .retrieval import B, K1, tokens, top

BUCKETS, BLOCK_DOCS, FIRST_BLOCKS = 64, 1024, 4
#: Bytes of text that a block holds at most, on average; the bucket of the rows that only count a block's documents.
BLOCK_BYTES, STATS = 16 << 20, -1


def postings(block: pa.Table) -> pa.Table:
    """A row for each term of a block's documents (block, doc_id, w) with its postings in order of ids, and one without a
    term that counts documents, those with a text, and words."""
    own = block.sort_by("doc_id")
    words, ids = own["w"].combine_chunks(), own["doc_id"].combine_chunks()
    size = pc.list_value_length(words)
    doc, terms = pc.list_parent_indices(words).to_numpy(zero_copy_only=False), pc.list_flatten(words).dictionary_encode()
    key, tf = np.unique(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(own) + doc, return_counts=True)
    term, at = key // len(own), key % len(own)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    offsets = pa.array([*starts, len(key)], pa.int32())
    tf, sizes = tf.astype(np.int32), pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int32)[at]
    extreme = lambda f, x: pa.array(f.reduceat(x, starts) if len(starts) else x, pa.int32())
    number, lists = block["block"][0].as_py(), lambda x: pa.ListArray.from_arrays(offsets, x)
    found = {"term": terms.dictionary.take(pa.array(term[starts])), "block": pa.array([number] * len(starts), pa.int32()), "ids": lists(ids.take(pa.array(at))), "tfs": lists(pa.array(tf)), "sizes": lists(pa.array(sizes))}
    found |= {"n": pa.array(np.diff(offsets), pa.int64()), "most": extreme(np.maximum, tf), "least": extreme(np.minimum, sizes)}
    found |= {k: pa.nulls(len(starts), pa.int64()) for k in ("docs", "sized", "words")}
    rows = pa.table(found)
    count = {"block": number, "docs": len(own), "sized": len(size) - size.null_count, "words": pc.sum(size).as_py()}
    return pa.concat_tables([rows, pa.table({k: pa.array([count.get(k)], rows.schema.field(k).type) for k in rows.column_names})])


class TermIndex:
    """Postings under one folder that the cluster shares. Each added batch is a segment of its own beside the others, so
    nothing is built again; frequencies and lengths are summed over segments as a search runs, and scores are those of
    bm25() over all documents together. A document id must be added once.

    Within a segment documents are dealt into blocks of about BLOCK_DOCS by hash. A row holds a term's postings of one
    block: ids, frequencies and sizes side by side, and what bounds their weights, so no term, however frequent, makes a
    large row, and a search reads only the buckets its terms lie in."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, block_docs: int = BLOCK_DOCS):
        self.spark, self.path, self.buckets, self.block_docs = spark, path.rstrip("/"), buckets, block_docs

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds documents; those without a token have no postings but count, and the mean length is that of texts that are
        not null. No rows, no segment.

        Texts are dealt into blocks once, and a task tokenises and counts a block at a time, of about BLOCK_DOCS documents
        and BLOCK_BYTES at most, so that single words never move."""
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        if not n:
            return
        block = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(max(-(-n // self.block_docs), -(-size // BLOCK_BYTES)))).cast("int")
        words = rows.withColumn("block", block).repartition("block").select("block", "doc_id", tokens(F.col("text")).alias("w"))
        kind = words.schema["doc_id"].dataType.simpleString()
        found = words.groupBy("block").applyInArrow(postings, f"term string, block int, ids array<{kind}>, tfs array<int>, sizes array<int>, n long, most int, least int, docs long, sized long, words long")
        bucket = F.when(F.col("term").isNull(), STATS).otherwise(self._bucket(F.col("term")))
        found = found.withColumns({"bucket": bucket, "segment": F.lit(uuid.uuid4().hex)})
        found.repartition("bucket", F.pmod("block", F.lit(8))).sortWithinPartitions("bucket", "term", "block").write.mode("append").partitionBy("bucket", "segment").parquet(f"{self.path}/postings")

    def _read(self, queries: DataFrame, query_id: str, query_text: str) -> tuple[DataFrame, DataFrame]:
        """(blocks of the queries' terms with idf, (query_id, term)): only buckets that hold a term are read."""
        terms = checkpointed(queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term")))
        used = [r[0] for r in terms.select(self._bucket(F.col("term"))).distinct().collect()]  # at most as many as there are buckets
        blocks = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(used)).join(terms.select("term").distinct(), "term", "left_semi")
        total = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket") == STATS).agg(F.sum("docs").alias("docs_"), (F.sum("words") / F.sum("sized")).alias("mean_"))
        df = blocks.groupBy("term").agg(F.sum("n").alias("df")).join(F.broadcast(total))
        df = df.withColumn("idf", F.log((F.col("docs_") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).select("term", "idf", "mean_")
        return blocks.join(df, "term"), terms

    @staticmethod
    def _weight(tf: Column, size: Column) -> Column:
        return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.col("mean_")))

    def _scored(self, blocks: DataFrame) -> DataFrame:
        rows = blocks.select("query_id", "idf", "mean_", F.explode(F.arrays_zip("ids", "tfs", "sizes")).alias("p"))
        return rows.select("query_id", F.col("p.ids").alias("doc_id"), self._weight(F.col("p.tfs"), F.col("p.sizes")).alias("weight")).groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"))

    def search(self, queries: DataFrame, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
        """(query_id, doc_id, score) of every document that shares a term with a query, as bm25() gives them."""
        blocks, terms = self._read(queries, query_id, query_text)
        return self._scored(blocks.join(terms, "term"))

    def bounded(self, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query", first: int = FIRST_BLOCKS) -> DataFrame:
        """The blocks that a search for the k best must read: (query_id, segment, block, bound, needed). A block's bound is
        what its best document could score; the `first` blocks by bound are scored, and those whose bound is below the
        k-th score found there can't hold one of the k best."""
        blocks, terms = self._read(queries, query_id, query_text)
        asked = checkpointed(blocks.join(terms, "term").withColumn("most_", self._weight(F.col("most"), F.col("least"))))
        own = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        bounds = asked.groupBy("query_id", "segment", "block").agg(F.sum("most_").alias("bound")).withColumn("place_", F.row_number().over(own))
        head = asked.join(bounds.where(F.col("place_") <= first), ["query_id", "segment", "block"])
        worst = top(self._scored(head), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("worst_"))
        out = bounds.join(worst, "query_id", "left").withColumn("needed", F.col("worst_").isNull() | (F.col("bound") >= F.col("worst_") * (1 - 1e-12)))
        self._asked = asked
        return out.select("query_id", "segment", "block", "bound", "needed")

    def search_top(self, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query", first: int = FIRST_BLOCKS) -> DataFrame:
        """The k best documents of each query with their rank, ties by id: search() with the blocks left out that can't
        hold any of them."""
        needed = self.bounded(queries, k, query_id, query_text, first).where("needed").select("query_id", "segment", "block")
        return top(self._scored(self._asked.join(needed, ["query_id", "segment", "block"])), k).select("query_id", "doc_id", "score", "rank")
