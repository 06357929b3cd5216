"""Cost-balanced packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, read_spread

SEQUENCE_TOKENS = 2048
WINDOW_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
END_OF_DOCUMENT = 1
WORDS_KEPT = 450_000
#: The letters that stand for the bytes of a byte-level vocabulary: printable ones for themselves, others from 256 on.
_plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_plain))}

SCHEMA = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long, cost double"


class WordTokens(dict):
    """Tokens of each word, found once per worker: the vocabulary never joins over white space, so a text's
    tokens are those of its words in order. Bounded: once it holds WORDS_KEPT words, among them the frequent ones, a
    text's new words are forgotten with it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids if m else [] for m in ["", *".,;:!?|"]}
        self.new: list[str] = []
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n

    def learn(self) -> None:
        if not self.new:
            return
        first = len(self) - len(self.new)
        flat, sizes = self._tokens_of(self.new)
        total = self.used + len(flat)
        if total > len(self.flat):
            self.flat = np.resize(self.flat, 3 * total // 2)
        if len(self) > len(self.at):
            self.at, self.size = np.resize(self.at, 3 * len(self) // 2), np.resize(self.size, 3 * len(self) // 2)
        self.flat[self.used : total] = flat
        self.size[first : len(self)] = sizes
        self.at[first : len(self)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.new = total, []

    def _tokens_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of the first 256 code points, with one mark after them or none, are what the vocabulary's rules
        leave as they are but for case: they go straight to its merges. All else takes the tokenizer's full path."""
        flat: list[int] = []
        sizes = []
        merge, marks = self.tokenizer.model.tokenize, self.marks
        for w in words:
            core, mark = (w[:-1], w[-1]) if len(w) > 1 and w[-1] in marks else (w, "")
            if core.isalpha() and max(core) < "\u0100":
                core = core.lower()
                got = [t.id for t in merge(core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_LETTERS))] + marks[mark]
            else:
                got = self.tokenizer.encode(w, add_special_tokens=False).ids
            flat += got
            sizes.append(len(got))
        return np.array(flat, np.uint32), np.array(sizes, np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids and the end id; only blanks and line feeds part words, other white space stays within one."""
        if text and text.isascii() and "<|" not in text:
            text = text.lower()  # as the tokenizer does; fewer words to learn
        words = text.replace("\n", " ").split(" ") if text else []
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        late = self.new if len(self) > WORDS_KEPT else []
        used = self.used
        self.learn()
        sizes = self.size[codes].astype(np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        out = np.empty(n + 1, np.uint32)
        out[:n] = self.flat[np.repeat(self.at[codes] - ends + sizes, sizes) + np.arange(n)]
        out[n] = END_OF_DOCUMENT
        for w in late:
            del self[w]
        if late:
            self.used = used
        return out


_tokens: dict[str, WordTokens] = {}


def cost(length, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Estimated work of one piece: its feed-forward share, and its attention, which grows with the square."""
    return linear * length + quadratic * length * length


def assign(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these sizes in as few sequences as they fill.

    Documents go in descending size, ties in order, each to the lowest-cost sequence with room for all of it. One
    that fits nowhere is cut: its head fills the lowest-cost sequence that still has room and its rest goes back in
    line, so only the last sequence's worth of tokens can be left as padding.
    """
    sequences = max(1, -(-int(sizes.sum()) // capacity))
    room, load = np.full(sequences, capacity, np.int64), np.zeros(sequences)
    pieces = []
    # pieces over a whole sequence fill sequences of their own first
    rest: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    filled = 0
    for d, n in enumerate(sizes.tolist()):
        start = 0
        while n - start >= capacity:
            pieces.append((d, start, capacity, filled, 0))
            room[filled], load[filled] = 0, cost(capacity, linear, quadratic)
            filled, start = filled + 1, start + capacity
        if n > start:
            rest[n - start].append((d, start))
    for size in range(capacity, 0, -1):
        line = rest[size]
        for d, start in line:
            fits = np.where(room >= size, load, np.inf)
            s = int(fits.argmin())
            part = size
            if fits[s] == np.inf:
                s = int(np.where(room > 0, load, np.inf).argmin())
                part = int(room[s])
                rest[size - part].append((d, start + part))
            pieces.append((d, start, part, s, capacity - int(room[s])))
            room[s] -= part
            load[s] += cost(part, linear, quadratic)
    return pieces


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    window_tokens: int = WINDOW_TOKENS,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """Every document's tokens, cut into pieces and laid out in sequences of at most sequence_tokens.

    Returns a row per piece: doc_id, start (tokens of the document before it), length, tokens (unsigned 32-bit
    little-endian), doc_tokens, sequence_id, offset (position there; gapless from 0) and cost. Each task packs
    windows of about window_tokens as it reads them: no shuffle, a bounded buffer, and under one sequence of
    padding a window. sequence_id is unique over all tasks; it is the same when a task is run again if its rows come in
    the same order, as they do from a scan, though not after a shuffle.

    A null or empty text is the end id alone. A very long text is tokenised whole, in its task, and cut over as many
    sequences as it takes; padding is under one sequence for each window and for each task's last one, so very many
    small partitions pad more. Repeated rows, repeated or null ids are documents like any other and
    share no piece. Equal sizes go in order of reading. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_tokens)
        words = _tokens.get(tokenizer_path) or _tokens.setdefault(tokenizer_path, WordTokens(tokenizer_path))
        task, number = TaskContext.get().partitionId() << 40, count()
        ids: list = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            pieces = sorted(assign(sizes, sequence_tokens, linear, quadratic), key=lambda p: (p[3], p[4]))
            names: dict[int, int] = {}
            for p in pieces:
                if p[3] not in names:
                    names[p[3]] = task + next(number)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[p[0]] for p in pieces], pa.int64()),
                    pa.array([p[1] for p in pieces], pa.int64()),
                    pa.array([p[2] for p in pieces], pa.int64()),
                    pa.array([held[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes() for p in pieces], pa.binary()),
                    pa.array([len(held[p[0]]) for p in pieces], pa.int64()),
                    pa.array([names[p[3]] for p in pieces], pa.int64()),
                    pa.array([p[4] for p in pieces], pa.int64()),
                    pa.array([cost(p[2], linear, quadratic) for p in pieces], pa.float64()),
                ],
                ["doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset", "cost"],
            )

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                held.append(words.encode(text.as_py()))
                total += len(held[-1])
                if total >= window_tokens:
                    yield flush()
                    ids, held, total = [], [], 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed with the public word vocabulary; the pieces' tokens as checksums."""
    import public_tokenizers

    pieces = pack(read_spread(spark, f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
