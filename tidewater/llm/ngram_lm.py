"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays that workers map into memory."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, WORD_CACHE, claim, ensure_checkpoint_dir, in_slices, mix, read_spread, written

ORDER = 2
WINDOW_TOKENS = 2_000_000
SHARD_BYTES = 32 << 20
#: Marks of a text's start and end; no word holds a blank.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))
#: What is discounted where counts of counts give no discounts: too few n-grams, or copies that bend them.
PLAIN_DISCOUNTS = (0.5, 1.0, 1.5)


class LowerWords(dict):
    """word as UTF-8 bytes -> 64-bit hash, bounded; the value depends on the word alone."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = LowerWords()


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased and parted by ASCII white space, and of the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def laid_out(texts: list[str | None], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, sizes): for each token of all texts in turn, its order - 1 predecessors and itself; the start's mark
    stands before a text as often as that takes."""
    own = [tokens(t) for t in texts]
    sizes = np.array([len(x) for x in own], np.int64)
    pad = np.full(order - 1, START, np.uint64)
    flat = np.concatenate([y for x in own for y in (pad, x)])
    ends = np.cumsum(sizes + order - 1)
    last = np.repeat(ends - sizes - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return [flat[last - k] for k in range(order - 1, -1, -1)], sizes


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of n-grams; that of one word is the word's."""
    if len(columns) == 1:
        return columns[0]
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = out * MIX + c
    return mix(out)


def _sums(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places of distinct keys in ascending order, sums of values by key)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order[first], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


#: A block of n-grams on its way to the shard of its hash: words are the n-gram's hashes column by column, values are
#: adjusted counts, raw counts and, of the n-gram as a context, the sum and the numbers of counts 1, 2 and 3 or more.
BLOCK = "shard long, words binary, values binary, facts array<long>"
VALUES = 6


def _blocks(columns: list[np.ndarray], values: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """One row for each shard that has some of the n-grams; sorted by their first word, which packs better."""
    shard = gram_hash(columns) >> np.uint64(64 - bits) if bits else np.zeros(len(columns[0]), np.uint64)
    order = np.lexsort((columns[0], shard))
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        yield int(shard[part[0]]), np.concatenate([c[part] for c in columns]).tobytes(), np.concatenate([v[part].astype("<i8") for v in values]).tobytes(), None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["shard", "words", "values", "facts"])


def _count(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """Blocks of the n-grams of the highest order with their counts, summed up within windows of a task's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_words)
        held: list[list[np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            at, (sums,) = _sums(gram_hash(columns), [np.ones(len(columns[0]), np.int64)])
            return _batch([*_blocks([c[at] for c in columns], [sums], bits)])

        for b in in_slices(batches):
            if b.num_rows:
                held.append(laid_out(b.column(0).to_pylist(), order)[0])
                n += len(held[-1][0])
            if n >= WINDOW_TOKENS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, BLOCK)


def _level(blocks: DataFrame, k: int, order: int, bits: int, folder: str) -> DataFrame:
    """Writes the arrays of the k-grams, a task for each shard of hashes, and returns the blocks of the (k-1)-grams.

    Of n-grams below the highest order a count is that of the different words before it, or, where a text starts
    with it, of its occurrences."""
    top = k == order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for shard, words, values, facts in zip(*(b.column(c) for c in range(4)), strict=True):
                if facts.is_valid:
                    yield _batch([(shard.as_py(), None, None, facts.as_py())])
                else:
                    w = np.frombuffer(words.as_buffer(), "<u8").reshape(k, -1)
                    parts.setdefault(shard.as_py(), []).append((w, np.frombuffer(values.as_buffer(), "<i8").reshape(1 if top else VALUES, -1)))
        for shard in sorted(parts):
            got = parts.pop(shard)
            columns = [np.concatenate([w[i] for w, _ in got]) for i in range(k)]
            values = [np.concatenate([v[i] for _, v in got]) for i in range(1 if top else VALUES)]
            del got
            keys = gram_hash(columns)
            at, sums = _sums(keys, values)
            columns, keys = [c[at] for c in columns], keys[at]
            counts, raw = (sums[0], sums[0]) if top else sums[:2]
            names = ["count"] if top else ["count", "raw", "sum", "ones", "twos", "more"]
            _write(folder, k, shard, {"hash": keys} | dict(zip(names, sums, strict=True)))
            facts = [k, *((counts == x).sum() for x in (1, 2, 3, 4)), (counts >= 3).sum(), counts.sum(), raw.sum(), (raw > 0).sum()]
            seen = counts > 0
            rows = [(shard, None, None, [int(x) for x in facts])]
            if k > 1:
                columns, counts, raw = [c[seen] for c in columns], counts[seen], raw[seen]
                none = np.zeros(len(counts), np.int64)
                # the words before the last, as a context
                at, (total, *by_count) = _sums(gram_hash(columns[:-1]), [counts, *((counts == x).astype(np.int64) for x in (1, 2)), (counts >= 3).astype(np.int64)])
                rows += _blocks([c[at] for c in columns[:-1]], [none[: len(at)], none[: len(at)], total, *by_count], bits)
                # the words after the first, as a shorter n-gram
                adjusted = np.where(columns[1] == START, counts, 1)
                at, sums = _sums(gram_hash(columns[1:]), [adjusted, raw])
                rows += _blocks([c[at] for c in columns[1:]], [*sums, *[none[: len(at)]] * 4], bits)
            for i in range(0, len(rows), 64):
                yield _batch(rows[i : i + 64])

    return blocks.repartitionById(1 << bits, F.col("shard").cast("int")).mapInArrow(run, BLOCK)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def _write(folder: str, k: int, shard: int, arrays: dict[str, np.ndarray]) -> None:
    """One file for each array, in the narrowest type. A rerun writes the same bytes, and a file appears whole."""
    store, path = _store(folder)
    for name, values in arrays.items():
        if name != "hash":
            values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
        own = f"{path}/{k}-{shard}-{name}.npy"
        part = f"{own}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            np.lib.format.write_array(out, values)
        store.move(part, own)


class Arrays:
    """The model's arrays in a worker, mapped from the shared folder; where that isn't mounted, from copies of the files
    asked for in the executor's own folder. Pages are read as lookups touch them and are shared by all workers."""

    def __init__(self, folder: str, bits: int):
        self.store, self.path = _store(folder)
        self.bits = bits
        self.open: dict[tuple[int, int, str], np.ndarray] = {}

    def array(self, k: int, shard: int, name: str) -> np.ndarray:
        key = k, shard, name
        if key not in self.open:
            file = f"{self.path}/{k}-{shard}-{name}.npy"
            if not isinstance(self.store, fs.LocalFileSystem):
                file = self._fetched(file)
            self.open[key] = np.load(file, mmap_mode="r") if os.path.exists(file) else np.zeros(0, np.uint64)
        return self.open[key]

    def _fetched(self, file: str) -> str:
        from pyspark import SparkFiles

        own = os.path.join(SparkFiles.getRootDirectory(), file.strip("/").replace("/", "_"))
        if not os.path.exists(own) and self.store.get_file_info(file).is_file:
            with self.store.open_input_stream(file) as src, tempfile.NamedTemporaryFile(dir=os.path.dirname(own), delete=False) as out:
                while chunk := src.read(1 << 22):
                    out.write(chunk)
            os.replace(out.name, own)
        return own

    def lookup(self, k: int, hashes: np.ndarray, *names: str) -> list[np.ndarray]:
        """The values of n-grams by their hashes, 0 for those not there: sorted queries pass over the sorted arrays."""
        asked, back = np.unique(hashes, return_inverse=True)
        out = [np.zeros(len(asked), np.int64) for _ in names]
        shard = asked >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(asked), np.uint64)
        starts = np.flatnonzero(np.diff(shard, prepend=shard[:1] + np.uint64(1)))
        for a, b in zip(starts, np.append(starts[1:], len(asked)), strict=True):
            there = self.array(k, int(shard[a]), "hash")
            if len(there):
                at = np.minimum(np.searchsorted(there, asked[a:b]), len(there) - 1)
                hit = np.flatnonzero(there[at] == asked[a:b])
                for o, name in zip(out, names, strict=True):
                    o[a + hit] = self.array(k, int(shard[a]), name)[at[hit]]
        return [o[back] for o in out]


_arrays: dict[str, Arrays] = {}


@dataclass
class Model:
    """Where the arrays lie, and what sums up each order: counts of counts, totals, discounts."""

    folder: str
    order: int
    bits: int
    counts: dict[int, np.ndarray]
    discounts: dict[int, np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        self.discounts = {k: discounts(*self.counts[k][:4].tolist()) for k in range(1, self.order + 1)}

    @property
    def train_tokens(self) -> int:
        return int(self.counts[1][6])

    @property
    def words(self) -> int:
        return int(self.counts[1][7])

    def _arrays(self) -> Arrays:
        claim(_arrays)
        return _arrays.get(self.folder) or _arrays.setdefault(self.folder, Arrays(self.folder, self.bits))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        columns, sizes = laid_out(texts, self.order)
        arrays = self._arrays()
        adjusted, raw = arrays.lookup(1, columns[-1], "count", "raw")
        ones, twos, _, _, more, total, tokens, words = self.counts[1].tolist()
        d = self.discounts[1]
        p = np.full(len(raw), 1.0 / (words + 1))
        if total:
            p = (adjusted - d[np.minimum(adjusted, 3)] + (d[1] * ones + d[2] * twos + d[3] * more) * p) / total
        for k in range(2, self.order + 1):
            d = self.discounts[k]
            sums, ones, twos, more = arrays.lookup(k - 1, gram_hash(columns[self.order - k : -1]), "sum", "ones", "twos", "more")
            (n,) = arrays.lookup(k, gram_hash(columns[self.order - k :]), "count")
            p = np.where(sums > 0, (n - d[np.minimum(n, 3)] + (d[1] * ones + d[2] * twos + d[3] * more) * p) / np.maximum(sums, 1), p)
        first = np.cumsum(sizes) - sizes
        base = np.log10((raw + 1) / (tokens + words + 1))
        return sizes, np.add.reduceat((raw > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)

    def drop(self, spark: SparkSession) -> None:
        """Removes the arrays; what was scored by them must be written by then."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What counts of 0, 1, 2 and 3 or more lose, by the numbers of n-grams that occur 1 to 4 times."""
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        if all(0 < x < k for k, x in enumerate(d, 1)):
            return np.array([0.0, *d])
    return np.array([0.0, *PLAIN_DISCOUNTS])


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> Model:
    """Counts all n-grams of the texts up to `order` (2 or more), none pruned, and writes the model's arrays.

    One job: tasks sum up windows of their tokens; blocks of n-grams go to the shard of their hash, where a task sums,
    sorts and writes them and sends on what the next shorter n-grams need: contexts' sums, and words before them. Hashes
    spread evenly, so no frequent word or pair loads a task. To the driver come ten numbers a shard.

    A null text is an empty one, which has its end alone. Very long texts count whole; repeated rows count as often as
    they are there. An empty table gives a model by which every token has probability 1 / (0 + 1); other columns are ignored."""
    if order < 2:
        raise ValueError("an interpolated model has an order of 2 at least")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / shard_bytes))))
    level = _count(texts, order, bits)
    for k in range(order, 0, -1):
        level = _level(level, k, order, bits, folder)
    counts = {k: np.zeros(8, np.int64) for k in range(1, order + 1)}
    for r in level.where("facts is not null").select("facts").collect():
        counts[r["facts"][0]] += np.array(r["facts"][1:], np.int64)
    return Model(folder, order, bits, counts)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out_col: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each text, its end counted
    as a token: known ones occur in the training texts, base_score is by add-one counts of single tokens, score by the
    model; both are sums of log10 probabilities. No shuffle.

    A null or empty text is its end alone. Very long texts are scored whole. Repeated rows, and ids that are repeated or
    null, are rows like any other; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            if b.num_rows:
                claim(_words)
                got = model.score(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, got)], [x.split()[0] for x in SCORES.split(", ")])

    held_out = F.col(held_out_col) if held_out_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.cast("boolean").alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, SCORES)
    return out.withColumn("train_tokens", F.lit(model.train_tokens).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by a model of those outside the held-out fold. The arrays go once the scores are written."""
    docs = read_spread(spark, f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)))
    model = train(docs.where(~F.col("held_out")))
    out = written(score(docs, model, held_out_col="held_out"))
    model.drop(spark)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
