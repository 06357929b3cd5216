"""Near-duplicate join on word n-grams: MinHash bands find candidates, whole n-gram sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, checkpoint, connected_components, shingles

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9995
BLOCK_ROWS, BLOCK_BYTES = 400, 4 << 20


def choose_bands(threshold: float, recall: float, max_rows: int = 12) -> tuple[int, int]:
    """(bands, rows): the most selective rows a band whose bands, as many as the target recall at the threshold
    needs, stay within 64 hashes; pairs at the threshold share a band with probability 1 - (1 - t^rows)^bands."""
    best = (1, 1)
    for rows in range(1, max_rows + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - p)))
        if bands * rows <= 64:
            best = (bands, rows)
    return best


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 32, (2, n), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def band_hashes(s: np.ndarray, bands: int, rows: int, coefficients: np.ndarray) -> np.ndarray:
    """One 64-bit hash a band of the MinHash signature of a set of 64-bit n-gram hashes."""
    low = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 4096):  # a bounded scratch area for very long texts
        part = (x[None, i : i + 4096] ^ coefficients[1][:, None]) * coefficients[0][:, None]
        np.minimum(low, part.min(axis=1), out=low)
    low = low.reshape(bands, rows)
    return np.array([xxhash.xxh3_64_intdigest(low[b].tobytes(), b) for b in range(bands)], np.uint64).view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """version tells apart the texts of rows that repeat an id."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null").withColumn("version", F.xxhash64("text"))


def _signed(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """(doc, set digest, size of the set, bytes, bands) of each document with an id."""
    co = _multipliers(bands * rows)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = t.as_py() or ""
            s = shingles(text, n)
            out[0].append(i)
            out[1].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            out[2].append(len(s))
            out[3].append(len(text))
            out[4].append(band_hashes(s, bands, rows, co) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.list_(pa.int64())), b.column(2)],
            ["doc", "digest", "grams", "bytes", "bands", "version"],
        )

    return arrow_map(_texts(docs, id_col, text_col), run, "doc long, digest binary, grams long, bytes long, bands array<long>, version long").dropDuplicates(["doc", "digest"])


def _compare(threshold: float, n: int):
    """Links within one block pair: pairs whose first shared band is this bucket's, decided on whole n-gram sets."""

    def run(table: pa.Table) -> pa.Table:
        doc = table.column("doc").to_numpy()
        order = np.argsort(doc, kind="stable")
        table, doc = table.take(pa.array(order)), doc[order]
        side = table.column("side").to_numpy()
        band = int(table.column("band")[0].as_py())
        one_block = bool(table.column("i")[0].as_py() == table.column("j")[0].as_py())
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(doc), -1)
        sets = [shingles(t.as_py(), n) for t in table.column("text").combine_chunks()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        weight = table.column("copies").to_numpy()
        flat_all, codes = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        codes = [codes[e - s : e] for e, s in zip(ends, size, strict=True)]
        mark = np.zeros(len(flat_all), bool)
        links = np.zeros(len(doc), np.int64)
        parent = np.arange(len(doc))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a in range(len(doc)):
            if not one_block and side[a]:
                continue
            other = np.arange(a + 1, len(doc)) if one_block else np.flatnonzero(side)
            # sizes alone bound the similarity; a pair is judged in the first band that it shares
            ok = np.minimum(size[other], size[a]) >= threshold * np.maximum(size[other], size[a])
            ok &= (bands[other, : band + 1] == bands[a, : band + 1]).argmax(axis=1) == band
            other = other[ok & (doc[other] != doc[a])]
            if not len(other):
                continue
            mark[codes[a]] = True
            lens = size[other]
            starts = np.cumsum(lens) - lens
            common = np.add.reduceat(mark[np.concatenate([codes[o] for o in other])].astype(np.int64), starts)
            mark[codes[a]] = False
            for o in other[common >= threshold * (lens + size[a] - common) - 1e-9]:
                links[a] += weight[o]
                links[o] += weight[a]
                x, y = sorted((find(a), find(int(o))))
                parent[y] = x
        hit = np.flatnonzero(links)
        return pa.table({"doc": pa.array(doc[hit], pa.int64()), "root": pa.array(doc[[find(int(x)) for x in hit]] if len(hit) else [], pa.int64()), "links": pa.array(links[hit], pa.int64())})

    return run


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    n: int = NGRAM,
    recall: float = RECALL,
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Links all documents whose sets of word n-grams have a Jaccard similarity of at least the threshold.

    Returns a row per document with an id: doc_id, class_id (smallest doc_id reachable over links), n_links (other
    documents linked directly, copies counted), copy_of (smallest doc_id with the same n-gram set), kept (doc_id =
    class_id).

    Documents with equal sets are one class before any pairing, so copies never multiply. Buckets of equal band
    hashes are cut into blocks of bounded rows and bytes and each pair of blocks is one small task group; buckets
    with the same members are compared once and a pair only in its first shared band. Groups return counts and the
    roots of their links, not pairs.

    Words are lower-cased and parted by white space. A text of fewer than n words is one gram. Null and empty texts
    have no grams and link with nothing; rows without an id are left out; rows that repeat an id with the same text
    give one row, with different texts they count as one document whose links are those of both. Ties take the
    smallest doc_id. An empty table gives no rows; other columns are ignored.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = checkpoint(_signed(docs, id_col, text_col, n, bands, rows))
    classes = checkpoint(
        signed.where("digest is not null")
        .groupBy("digest")
        .agg(F.min(F.struct("doc", "version")).alias("rep"), F.count("*").alias("copies"), F.max("bytes").alias("bytes"), F.min_by("bands", "doc").alias("bands"))
        .select("digest", F.col("rep.doc").alias("rep"), F.col("rep.version").alias("version"), "copies", "bytes", "bands")
    )
    member = classes.select("rep", "version", "copies", "bytes", F.posexplode("bands").alias("band", "key"))
    bucket = (
        member.groupBy("band", "key")
        .agg(F.count("*").alias("size"), F.sum("bytes").alias("total"), F.bit_xor(F.xxhash64("rep", "version")).alias("x"), F.sum(F.hash("rep", "version").cast("long")).alias("s"))
        .where("size > 1")
    )
    # buckets of the same members: one of them is enough, the one of the lowest band
    bucket = bucket.groupBy("size", "total", "x", "s").agg(F.min(F.struct("band", "key")).alias("b")).select(F.col("b.band").alias("band"), F.col("b.key").alias("key"), "size", "total")
    bucket = bucket.withColumn("blocks", F.greatest(F.ceil(F.col("size") / block_rows), F.ceil(F.col("total") / block_bytes)).cast("int")).drop("size", "total")
    placed = member.select("rep", "version", "copies", "band", "key").join(bucket, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64(F.col("rep"), F.lit(7)), F.col("blocks")).cast("int"))
    placed = checkpoint(placed)
    wanted = classes.select("rep", "version", "bands").join(placed.select("rep", "version").distinct(), ["rep", "version"], "left_semi")
    wanted = wanted.join(_texts(docs, id_col, text_col).withColumnRenamed("doc", "rep"), ["rep", "version"]).dropDuplicates(["rep", "version"])
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", "version", "copies", "band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("side")
    )
    rows_in = pairs.join(wanted, ["rep", "version"]).drop("version").withColumnRenamed("rep", "doc")
    found = checkpoint(rows_in.groupBy("band", "key", "i", "j").applyInArrow(_compare(threshold, n), "doc long, root long, links long"))
    # rows that repeat an id with other texts belong together: their classes meet in that document
    own = signed.where("digest is not null").select("doc", "digest").distinct()
    several = own.groupBy("doc").agg(F.count("*").alias("texts")).where("texts > 1").select("doc")
    joined = own.join(several, "doc", "left_semi").join(classes.select("digest", F.col("rep").alias("root")), "digest").select("doc", "root")
    component = connected_components(found.select("doc", "root").unionByName(joined), "doc", "root").withColumnRenamed("node", "rep")
    count = found.groupBy(F.col("doc").alias("rep")).agg(F.sum("links").alias("links"))
    per_class = classes.select("digest", "rep", "copies").join(component, "rep", "left").join(count, "rep", "left")
    out = signed.select("doc", "digest").distinct().join(per_class, "digest", "left")
    out = out.groupBy("doc").agg(
        F.min(F.coalesce("component", "rep", "doc")).alias("class_id"),
        F.collect_set(F.struct("rep", F.coalesce("links", F.lit(0)).alias("links"))).alias("found"),
        F.sum(F.greatest(F.coalesce(F.col("copies"), F.lit(1)) - 1, F.lit(0))).alias("copies"),
        F.min(F.coalesce("rep", "doc")).alias("copy_of"),
    )
    # links are counted by representative: one that stands for several of an id's texts counts once
    out = out.withColumn("n_links", F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["links"]) + F.col("copies"))
    return out.select(F.col("doc").alias("doc_id"), "class_id", "n_links", "copy_of", (F.col("doc") == F.col("class_id")).alias("kept"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of all documents."""
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
