"""Benchmark decontamination: rare word n-grams of the test items seed Smith-Waterman alignments in the training texts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_CACHE, claim, in_slices, ngram_hashes, passes, read_spread, sieve_of, written

SEED_WORDS, RARE, LEAST_SHARE = 3, 1e-7, 0.5
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
SCORE = 0.5
ITEM_BYTES = 32 << 20
COUNTED_WORDS = 2_000_000
SIEVE_BITS, TEXT_BITS = 1 << 27, 1 << 24
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”‘’„…–—¿¡·"


class BareWords(dict):
    """word -> hash of it without case and outer marks."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower().strip(MARKS).encode("utf-8", "surrogatepass"))
        return h


_bare = BareWords()


def words_of(text: str | None) -> np.ndarray:
    claim(_bare)
    words = text.split() if text else []
    return np.fromiter(map(_bare.__getitem__, words), np.uint64, len(words))


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """(score, first, end) of the best local alignment of all of `item` with words of `passage`; score 1 is an exact copy.

    Rows run over the item; gaps in the passage are resolved in a row by a running maximum.
    """
    n = len(passage)
    slope = GAP * np.arange(n + 1)
    h, start = np.zeros(n + 1), np.arange(n + 1)
    best, at = 0.0, (0, 0)
    for w in item:
        step = np.zeros(n + 1)
        origin = np.arange(n + 1)
        diagonal = h[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = h + GAP
        take = diagonal >= up[1:]
        value = np.where(take, diagonal, up[1:])
        where = np.where(take, start[:-1], start[1:])
        good = value > 0
        step[1:][good], origin[1:][good] = value[good], where[good]
        lifted = step - slope
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, np.arange(n + 1), 0))
        h = peak + slope
        start = origin[source]
        k = int(h.argmax())
        if h[k] > best:
            best, at = float(h[k]), (int(start[k]), k)
    return best / (MATCH * max(1, len(item))), *at


def rare_grams(words: np.ndarray, counts: np.ndarray, total: int, n: int, rare: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of an item's n-grams whose chance, words taken as independent at their shares of all documents,
    is at most `rare`; of an item of common words its rarest half. counts are those of its words, in turn."""
    share = np.log((counts + 1) / (total + 1))
    chance = np.convolve(share, np.ones(min(n, len(words))), "valid")
    ok = chance <= math.log(rare)
    if ok.mean() < LEAST_SHARE:
        ok = chance <= np.quantile(chance, LEAST_SHARE)
    return ngram_hashes(words, n)[ok], np.flatnonzero(ok)


@dataclass
class WordCounts:
    """How often each of some words (sorted hashes) occurs in all documents, and how many words there are."""

    words: np.ndarray
    counts: np.ndarray
    total: int

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)


def seeds_in(words: np.ndarray, sizes: Iterable[int], passes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) of a text's grams of each size that pass a sieve."""
    for size in sizes:
        if 0 < size <= len(words):
            grams = ngram_hashes(words, size)
            at = np.flatnonzero(passes(grams))
            yield grams[at], at


def best_alignment(item: np.ndarray, words: np.ndarray, begins: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """(score, first, end) of the item's best alignment near one of the places where its seeds say that a copy begins."""
    begins = np.sort(begins)
    best = None
    # seeds that can belong to one copy are aligned at once
    for near in np.split(begins, np.flatnonzero(np.diff(begins) > len(item)) + 1):
        a, b = max(0, int(near[0]) - len(item) // 2), int(near[-1]) + len(item) + len(item) // 2
        passage = words[a:b]
        if np.isin(item, passage).mean() < least:  # no alignment can score more than its shared words
            continue
        score, x, y = smith_waterman(item, passage)
        if score >= least and (best is None or score > best[0]):
            best = score, a + x, a + y
    return best


class Seeds:
    """Test items and their rare n-grams in sorted arrays: 16 bytes a seed and 8 a word, so a few times the items' size."""

    def __init__(self, items: list[tuple[int, np.ndarray]], counts: WordCounts, n: int, rare: float):
        found = [rare_grams(w, counts.of(w), counts.total, n, rare) for _, w in items]
        grams = np.concatenate([g for g, _ in found])
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.owner = np.repeat(np.arange(len(items), dtype=np.int32), [len(g) for g, _ in found])[order]
        self.place = np.concatenate([p for _, p in found]).astype(np.int32)[order]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words = np.concatenate([w for _, w in items])
        self.ends = np.cumsum([len(w) for _, w in items])
        self.sizes = sorted({min(n, len(w)) for _, w in items})
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def leaks(self, text: str | None, least: float) -> list[dict]:
        words = words_of(text)
        owners, begins = [], []
        for grams, at in seeds_in(words, self.sizes, lambda g: self.table[(g >> np.uint64(44)).astype(np.int64)]):
            lo = np.searchsorted(self.grams, grams)
            hit = self.grams[np.minimum(lo, len(self.grams) - 1)] == grams
            if not hit.any():
                continue
            grams, at, lo = grams[hit], at[hit], lo[hit]
            n = np.searchsorted(self.grams, grams, side="right") - lo
            own = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            owners.append(self.owner[own])
            begins.append(np.repeat(at, n) - self.place[own])
        if not owners:
            return []
        owner, begin = np.concatenate(owners), np.concatenate(begins)
        found: dict[int, tuple] = {}
        for k in np.unique(owner).tolist():
            item = self.words[self.ends[k - 1] if k else 0 : self.ends[k]]
            best = best_alignment(item, words, begin[owner == k], least)
            item_id = int(self.ids[k])
            # of an id's texts the better alignment, and of equal ones the first in the text
            if best and (item_id not in found or (best[0], -best[1], -best[2]) > found[item_id]):
                found[item_id] = best[0], -best[1], -best[2]
        return [{"item_id": k, "score": x, "first_word": -a, "end_word": -b} for k, (x, a, b) in sorted(found.items())]


LEAK = "array<struct<item_id:long,score:double,first_word:long,end_word:long>>"


def _item_words(items: DataFrame) -> DataFrame:
    """(word): the distinct words of all items."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [words_of(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([*own, np.zeros(0, np.uint64)])).view(np.int64))], ["word"])

    return items.select("text").mapInArrow(distinct, "word long").distinct()


def _counted(docs: DataFrame, text_col: str, sought) -> DataFrame:
    """(word, n): how often words that `sought` lets through occur in all documents, and under null how many words there
    are. Tasks sum up what they find; one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = waiting = 0

        def flush() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for b in batches:
            for t in b.column(0):
                w = words_of(t.as_py())
                total += len(w)
                held.append(w[sought(w)])
                waiting += len(held[-1])
            if waiting >= COUNTED_WORDS:
                yield flush()
                held, waiting = [], 0
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["word", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame, text_col: str, items: DataFrame) -> WordCounts:
    """Counts of the words of items that fit into every task: as many numbers as they have distinct words."""
    wanted = np.sort(_item_words(items).toArrow().column("word").to_numpy().astype(np.int64).view(np.uint64))
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def sought(w: np.ndarray) -> np.ndarray:
        known = held.value
        return known[np.minimum(np.searchsorted(known, w), len(known) - 1)] == w if len(known) else np.zeros(len(w), bool)

    rows = _counted(docs, text_col, sought).toArrow()
    word, n = rows.column("word"), rows.column("n").to_numpy()
    total = word.is_null().to_numpy()
    counts = np.zeros(len(wanted), np.int64)
    counts[np.searchsorted(wanted, word.drop_null().to_numpy().astype(np.int64).view(np.uint64))] = n[~total]
    return WordCounts(wanted, counts, int(n[total].sum()))


def _leaks_udf(seeds, score: float):
    def leaks(texts: pd.Series) -> pd.Series:
        return pd.Series([seeds.value.leaks(t, score) for t in texts], dtype=object)

    return F.pandas_udf(leaks, LEAK)


def _names(text: Column) -> dict[str, Column]:
    """What names a text among all: two hashes of it."""
    return {"hi": F.xxhash64(F.lit(1), text), "lo": F.xxhash64(F.lit(2), text)}


def _joined_seeds(docs: DataFrame, versions: DataFrame, text_col: str, n: int, rare: float) -> DataFrame:
    """(item, version, gram, place): the rare grams of items of any number. Words that pass a sieve of the items' words
    are counted, and counts meet the items' words in a join; the driver gets the total alone."""
    spark = docs.sparkSession
    sieve = spark.sparkContext.broadcast(sieve_of(_item_words(versions), SIEVE_BITS))
    counts = written(_counted(docs, text_col, lambda w: passes(sieve.value, w, SIEVE_BITS)))
    total = (counts.where("word is null").first() or {"n": 0})["n"]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            own = [words_of(t) for t in b.column(2).to_pylist()]
            sizes = [len(w) for w in own]
            ids = [np.repeat(b.column(k).to_numpy(zero_copy_only=False), sizes) for k in (0, 1)]
            place = np.concatenate([*map(np.arange, sizes), np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(place.astype(np.int64)), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))], ["item", "version", "place", "word"])

    @F.pandas_udf("array<struct<gram:long,place:long>>")
    def grams(word: pd.Series, count: pd.Series) -> pd.Series:
        out = []
        for w, c in zip(word, count, strict=True):
            g, at = rare_grams(np.asarray(w, np.int64).view(np.uint64), np.asarray(c, np.int64), total, n, rare)
            out.append([{"gram": x, "place": y} for x, y in zip(g.view(np.int64).tolist(), at.tolist(), strict=True)])
        return pd.Series(out, dtype=object)

    rows = versions.select("item", "version", "text").mapInArrow(words, "item long, version long, place long, word long").join(counts.where("word is not null"), "word", "left")
    texts = rows.groupBy("item", "version").agg(F.array_sort(F.collect_list(F.struct("place", "word", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))
    return texts.select("item", "version", F.explode(grams("w.word", "w.n")).alias("g")).select("item", "version", "g.*")


def _joined_leaks(docs: DataFrame, items: DataFrame, text_col: str, score: float, n: int, rare: float) -> DataFrame:
    """(hi, lo, item_id, score, first_word, end_word): seeds and texts of a benchmark of any size meet by shuffles.

    Rows move only for grams that pass a sieve of the seeds, and texts only where a seed was found."""
    spark = docs.sparkSession
    versions = items.withColumn("version", F.xxhash64("text")).distinct()
    seed_rows = written(_joined_seeds(docs, versions, text_col, n, rare))
    sieve = spark.sparkContext.broadcast(sieve_of(seed_rows.select("gram"), SIEVE_BITS))
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''").select("text", *[c.alias(k) for k, c in _names(F.col("text")).items()])
    sizes = range(1, n + 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for hi, lo, t in zip(*(b.column(c).to_pylist() for c in ("hi", "lo", "text")), strict=True):
                for grams, at in seeds_in(words_of(t), sizes, lambda g: passes(sieve.value, g, SIEVE_BITS)):
                    for k, v in enumerate((np.full(len(at), hi), np.full(len(at), lo), grams.view(np.int64), at)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)])) for x in out], ["hi", "lo", "gram", "at"])

    at = texts.mapInArrow(places, "hi long, lo long, gram long, at long").distinct()
    begins = at.join(seed_rows, "gram").groupBy("hi", "lo", "item", "version").agg(F.collect_set(F.col("at") - F.col("place")).alias("begins"))
    begins = written(begins)
    moving = spark.sparkContext.broadcast(sieve_of(begins.select("hi"), TEXT_BITS))

    @F.pandas_udf("boolean")
    def moves(hi: pd.Series) -> pd.Series:
        return pd.Series(passes(moving.value, hi.to_numpy(np.int64), TEXT_BITS))

    @F.pandas_udf("struct<score:double,first_word:long,end_word:long>")
    def align(text: pd.Series, item: pd.Series, begins: pd.Series) -> pd.DataFrame:
        found = [best_alignment(words_of(i), words_of(t), np.asarray(b), score) or (None, None, None) for t, i, b in zip(text, item, begins, strict=True)]
        return pd.DataFrame(found, columns=["score", "first_word", "end_word"]).astype({"score": "float64", "first_word": "Int64", "end_word": "Int64"})

    once = texts.where(moves("hi")).dropDuplicates(["hi", "lo"])
    both = begins.join(once, ["hi", "lo"]).join(versions.withColumnRenamed("text", "item_text"), ["item", "version"])
    found = both.select("hi", "lo", F.col("item").alias("item_id"), align("text", "item_text", "begins").alias("a")).where("a.score is not null")
    best = F.max_by("a", F.struct("a.score", -F.col("a.first_word"), -F.col("a.end_word")))
    return written(found.groupBy("hi", "lo", "item_id").agg(best.alias("a")).select("hi", "lo", "item_id", "a.*"))


def _prepared(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, score: float, n: int, rare: float, item_bytes: int):
    """(column, table): the leaks of each text as a column where the items fit into every task, else as a joined table."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > item_bytes:
        return None, _joined_leaks(docs, items, text_col, score, n, rare)
    counts = word_counts(docs, text_col, items)
    held = [(r["item"], w) for r in items.orderBy("item", "text").collect() if len(w := words_of(r["text"]))]
    if not held:
        return F.array().cast(LEAK), None
    seeds = docs.sparkSession.sparkContext.broadcast(Seeds(held, counts, n, rare))
    return _leaks_udf(seeds, score)(F.col(text_col).cast("string")), None


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    score: float = SCORE,
    n: int = SEED_WORDS,
    rare: float = RARE,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every test item that a document holds a copy of, edited or not.

    score is the item's best Smith-Waterman alignment by words over that of the item with itself; rows from `score`
    (0.5) on are kept, the best of each document and item. Words are compared without case and outer marks. Seeds are
    rare n-grams by the words' shares of all documents: a leak, however often copied, can't make its own seeds common.
    Items of up to item_bytes in all go to every task; more meet the texts in joins, with the same rows.

    Null or empty texts and items leak nothing. Items shorter than n words are sought whole. Very long texts are read
    whole, and only the stretches around seeds are aligned. Repeated rows are judged each; rows with a null id keep it;
    of items with the same id the better alignment counts, of equal ones the first in the text. Empty tables give no rows; other columns are ignored.
    """
    column, table = _prepared(docs, benchmark, text_col, item_col, item_text_col, score, n, rare, item_bytes)
    doc = F.col(id_col).cast("long").alias("doc_id")
    if table is None:
        return docs.select(doc, F.explode(column).alias("leak")).select("doc_id", "leak.*")
    return docs.select(doc, *[c.alias(k) for k, c in _names(F.col(text_col).cast("string")).items()]).join(table, ["hi", "lo"]).drop("hi", "lo")


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    score: float = SCORE,
    n: int = SEED_WORDS,
    rare: float = RARE,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The rows of `docs`, all columns, that leak no test item."""
    column, table = _prepared(docs, benchmark, text_col, item_col, item_text_col, score, n, rare, item_bytes)
    if table is None:
        return docs.where(F.size(column) == 0)
    gone = table.select("hi", "lo").distinct()
    own = _names(docs[text_col].cast("string"))
    return docs.join(gone, (own["hi"] == gone["hi"]) & (own["lo"] == gone["lo"]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item in the documents."""
    return find_leaks(read_spread(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
