"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how often their ids overlap."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, claim, read_spread, written
from .packing import BYTE_LETTERS

CHUNKS_KEPT = 300_000
BLOCK_LINKS = 2_000_000
#: A blank after a character that is none starts a chunk: there a token of either tokenizer ends.
CUT = re.compile(r"(?<=\S)(?= )")
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"


def merge(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> tuple[str, list[int]]:
    """Groups as text, and links as a << 32 | b, of two tokenizations of the same bytes: two pointers over the ends."""
    groups, links = [], []
    i = j = first_a = first_b = 0
    end_a, end_b = size_a[a[0]], size_b[b[0]]
    while True:
        links.append(a[i] << 32 | b[j])
        if end_a == end_b:
            groups.append(",".join(map(str, a[first_a : i + 1])) + "|" + ",".join(map(str, b[first_b : j + 1])))
            i, j = i + 1, j + 1
            if i == len(a):
                return ";".join(groups), links
            first_a, first_b = i, j
            end_a += size_a[a[i]]
            end_b += size_b[b[j]]
        elif end_a < end_b:
            i += 1
            end_a += size_a[a[i]]
        else:
            j += 1
            end_b += size_b[b[j]]


def byte_level_entries(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {chr(BYTE_LETTERS.get(x, x)): x for x in range(256)}
    ids = dict(spec["model"]["vocab"])
    out = [b""] * (1 + max([*ids.values(), *(x["id"] for x in spec.get("added_tokens", []))]))
    for entry, i in ids.items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of each id of a piece vocabulary: a mark for a blank, byte pieces as their byte."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        one = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        out.append(bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode())
    return out


class Chunks(dict):
    """Alignments of chunks, each found once per worker. A text is cut before each blank that follows a character which
    is none: neither tokenizer joins over such a place, so a text's tokens, groups and links are those of its chunks in
    order. Keys are chunks without their leading blank. Bounded: forgotten whole once CHUNKS_KEPT are held."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = byte_level_entries(path_a), piece_bytes(self.b)
        if any(re.search(rb"[^ ] ", x) for x in self.bytes_b if x not in (b" ",)):
            raise ValueError("a piece spans the start of a word; its texts can't be cut into chunks")
        self.size_a, self.size_b = [*map(len, self.bytes_a)], [*map(len, self.bytes_b)]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.groups: list[bytes] = []
        self.links, self.used = np.zeros(1 << 16, np.int64), 0
        #: n_a, n_b, n_groups, n_links, first link, whether the bytes differ, whether a split at blanks alone is too fine
        self.facts = np.zeros((1 << 14, 7), np.int64)

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        n = self[chunk] = len(self)
        return n

    def learn(self) -> None:
        if not self.new:
            return
        first = len(self) - len(self.new)
        if len(self) > len(self.facts):
            self.facts = np.resize(self.facts, (3 * len(self) // 2, 7))
        ids_a = self.a.encode_batch([" " + c for c in self.new], add_special_tokens=False)
        ids_b = self.b.encode(self.new, num_threads=1)
        flat: list[int] = []
        for k, (chunk, a, b) in enumerate(zip(self.new, ids_a, ids_b, strict=True), first):
            b = b if chunk else [self.b.piece_to_id("▁")]  # a blank at the end, for which the library adds none of its own
            a, fine = a.ids, not chunk or chunk[-1].isspace()
            own = (" " + chunk).encode()
            if b"".join([self.bytes_a[x] for x in a]) != own or b"".join([self.bytes_b[x] for x in b]) != own:
                self.groups.append(b"")
                self.facts[k] = 0, 0, 0, 0, 0, 1, fine
                continue
            groups, links = merge(a, b, self.size_a, self.size_b)
            self.groups.append(groups.encode())
            self.facts[k] = len(a), len(b), groups.count("|"), len(links), self.used + len(flat), 0, fine
            flat += links
        total = self.used + len(flat)
        if total > len(self.links):
            self.links = np.resize(self.links, 3 * total // 2)
        self.links[self.used : total] = flat
        self.used, self.new = total, []

    def codes(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The chunks of each text; none of a text that is empty or whose bytes come out otherwise."""
        if len(self) > CHUNKS_KEPT:
            self.forget()
        found = [self.codes(t.split(" ")) if t else np.zeros(0, np.int64) for t in texts]
        self.learn()
        for k, codes in enumerate(found):
            if len(codes) and self.facts[codes, 6].any():  # white space before a blank
                found[k] = self.codes([c[1:] for c in CUT.split(" " + texts[k])])
        self.learn()
        return [c if not self.facts[c, 5].any() else c[:0] for c in found]

    def links_of(self, codes: np.ndarray) -> np.ndarray:
        sizes, starts = self.facts[codes, 3], self.facts[codes, 4]
        ends = np.cumsum(sizes)
        return self.links[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


_chunks: dict[tuple[str, str], Chunks] = {}


def chunks_for(path_a: str, path_b: str) -> Chunks:
    claim(_chunks)
    return _chunks.get((path_a, path_b)) or _chunks.setdefault((path_a, path_b), Chunks(path_a, path_b))


def _aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, digest: bool, counted: bool, block_links: int) -> DataFrame:
    """A row for each document; if counted, with the distinct links as places in a list, and that list with its counts
    in one more row for each block of documents."""
    schema = f"block long, {DOCUMENT}" + ", places binary, times binary, pairs array<long>, counts array<long>" * counted
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = chunks_for(path_a, path_b)
        number, task = count(), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        links = 0

        def flush() -> pd.DataFrame:
            block = task + next(number)
            if not counted:
                return pd.DataFrame([(block, *r) for r in rows], columns=names)
            ends = np.cumsum([len(p) for p, _ in held])
            every = np.concatenate([p for p, _ in held])
            pairs, place = np.unique(every, return_inverse=True)
            counts = np.zeros(len(pairs), np.int64)
            np.add.at(counts, place, np.concatenate([n for _, n in held]))
            own = np.split(place.astype("<u4"), ends[:-1])
            out = [(block, *r, p.tobytes(), n.astype("<u4").tobytes(), None, None) for r, p, (_, n) in zip(rows, own, held, strict=True)]
            out.append((block, *(None,) * 8, pairs, counts))
            return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names[1:6]})

        for frame in frames:
            texts = frame["text"].tolist()
            for doc, codes in zip(frame["doc_id"].tolist(), known.of(texts), strict=True):
                groups = b";".join([known.groups[c] for c in codes.tolist()])
                n = known.facts[codes, :4].sum(axis=0).tolist()
                shown = (hashlib.sha256(groups).hexdigest() if len(codes) else "") if digest else groups.decode()
                rows.append((None if pd.isna(doc) else int(doc), *n, shown))
                if counted:
                    held.append(np.unique(known.links_of(codes), return_counts=True))
                links += n[3]
                if links >= block_links or len(rows) >= 10_000:
                    yield flush()
                    rows, held, links = [], [], 0
        if rows:
            yield flush()

    # ids go as decimals would: a null among longs becomes a float in pandas
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, schema)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups) of each document: its tokens by tokenizer A (byte level, of a blank
    and the text) and B (pieces, which add that blank), cut into groups where tokens of both end. groups holds ids as
    `a1,a2|b1;a3|b2,b3`; a link is a token of A and one of B whose bytes overlap. No shuffle.

    A text that is null, empty, or whose tokens' bytes differ from the blank and the text has no tokens: zeros and ''.
    Special tokens' strings are plain text. Very long texts are aligned whole, chunk by chunk. Repeated rows, and ids
    that are repeated or null, are rows like any other; an empty table gives no rows; other columns are ignored."""
    bounded_batches(docs.sparkSession)
    return _aligned(docs, path_a, path_b, id_col, text_col, False, False, BLOCK_LINKS).drop("block")


def align_and_count(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, block_links: int = BLOCK_LINKS) -> DataFrame:
    """align(), and by the links of all documents together: n_best, the links of a document whose pair is the most
    frequent one of its B id (ties included), and count_sum, their pairs' counts summed up. digest gives groups as SHA-256.

    Tasks align blocks of documents, of about block_links links each, and count a block's distinct pairs; Spark sums
    those up by pair, takes the maxima by B id, and joins both back to the pairs of each block, which then meets its
    documents. So what meets in one task is a block, whatever the corpus; a pair in every block is as many rows as there
    are blocks. Odd rows as in align()."""
    bounded_batches(docs.sparkSession)
    first = written(_aligned(docs, path_a, path_b, id_col, text_col, digest, True, block_links))
    found = first.where("pairs is null").drop("pairs", "counts")
    pairs = first.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    total = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    best = total.groupBy("b").agg(F.max("count").alias("most"))
    known = total.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("top"))
    back = pairs.join(known, "pair").select(F.col("block").alias("of_block"), "place", "count", "top")
    names = [x.split()[0] for x in DOCUMENT.split(", ")]

    def summed(docs: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        counts, top = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
        counts[links["place"]], top[links["place"]] = links["count"], links["top"]
        out = docs[names].copy()
        places = [np.frombuffer(x, "<u4") for x in docs["places"]]
        times = [np.frombuffer(x, "<u4").astype(np.int64) for x in docs["times"]]
        out["n_best"] = [int((top[p] * n).sum()) for p, n in zip(places, times, strict=True)]
        out["count_sum"] = [int((counts[p] * n).sum()) for p, n in zip(places, times, strict=True)]
        return out

    typed = found.withColumn("doc_id", F.col("doc_id").cast("string"))  # as above: ids stay exact beside nulls
    out = typed.groupBy("block").cogroup(back.groupBy("of_block")).applyInPandas(summed, DOCUMENT.replace("doc_id long", "doc_id string") + ", n_best long, count_sum long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of the public byte and piece vocabularies, groups as a checksum."""
    import public_tokenizers

    docs = read_spread(spark, f"{sf_dir}/documents.parquet")
    out = align_and_count(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
