"""The language model, the resampling and the token alignment against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame, odd_rows, words
from tidewater.llm import ngram_lm, resampling, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def more_rows():
    return [(100 + i, " ".join(words(20 + 13 * i % 90, i % 17))) for i in range(60)] + [(500, "Mixed Case  two\tblanks\n new line"), (501, " lead"), (502, "trail "), (503, "a\n b \n\n c"), (504, "x  y \x1c z")]


# operator 11


def plain_tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


class PlainModel:
    """Interpolated modified Kneser-Ney by dictionaries, from its definition."""

    def __init__(self, texts, order):
        self.order, grams, raw = order, Counter(), Counter()
        for t in texts:
            own = plain_tokens(t)
            raw.update(own)
            own = ["<start>"] * (order - 1) + own
            grams.update(tuple(own[i : i + order]) for i in range(len(own) - order + 1))
        self.raw, self.levels = raw, {order: grams}
        for k in range(order - 1, 0, -1):
            below = Counter()
            for g, n in self.levels[k + 1].items():
                below[g[1:]] += n if g[1] == "<start>" else 1
            self.levels[k] = below
        self.contexts, self.d = {}, {}
        for k, level in self.levels.items():
            self.contexts[k] = defaultdict(list)
            for g, n in level.items():
                self.contexts[k][g[:-1]].append(n)
            self.contexts[k] = {h: (sum(own), Counter(min(n, 3) for n in own)) for h, own in self.contexts[k].items()}
            self.d[k] = ngram_lm.discounts(*[sum(n == x for n in level.values()) for x in (1, 2, 3, 4)])

    def p(self, gram):
        if not gram:
            return 1 / (len(self.raw) + 1)
        k = len(gram)
        own = self.contexts[k].get(gram[:-1])
        if not own:
            return self.p(gram[1:])
        n, d = self.levels[k].get(gram, 0), self.d[k]
        left = sum(d[x] * times for x, times in own[1].items())
        return (n - d[min(n, 3)] + left * self.p(gram[1:])) / own[0]

    def score(self, text):
        own = ["<start>"] * (self.order - 1) + plain_tokens(text)
        return sum(math.log10(self.p(tuple(own[i : i + self.order]))) for i in range(len(own) - self.order + 1))


@pytest.mark.parametrize(("order", "shard_bytes"), [(2, 1 << 25), (2, 40_000), (3, 90_000), (4, 1 << 25)])
def test_language_model_against_definition(spark, order, shard_bytes):
    rows = odd_rows() + more_rows()
    docs = frame(spark, rows).withColumn("held_out", F.col("doc_id") % 5 == 2).repartition(3)
    texts = [t for i, t in rows if i is None or i % 5 != 2]
    plain = PlainModel(texts, order)
    model = ngram_lm.train(docs.where(F.coalesce(~F.col("held_out"), F.lit(True))), order=order, shard_bytes=shard_bytes)
    got = ngram_lm.score(docs, model, held_out_col="held_out").collect()
    assert len(got) == len(rows)
    by_id = {i: t for i, t in rows}
    total, distinct = sum(plain.raw.values()), len(plain.raw)
    for r in got:
        own = plain_tokens(by_id[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(plain.raw[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((plain.raw[w] + 1) / (total + distinct + 1)) for w in own), rel=1e-9)
        assert r["score"] == pytest.approx(plain.score(by_id[r["doc_id"]]), rel=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]), rel=1e-9)


def test_probabilities_sum_to_one():
    model = PlainModel([t for _, t in more_rows()], 3)
    for context in list(model.contexts[3])[:40] + [("never", "seen"), ("<start>", "never")]:
        assert sum(model.p((*context, w)) for w in [*model.raw, "unknown"]) == pytest.approx(1)


def test_language_model_without_training_texts(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    model = ngram_lm.train(docs.where("false"))
    assert [(r["n_tokens"], r["n_known"], r["score"]) for r in ngram_lm.score(docs, model).orderBy("doc_id").collect()] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert ngram_lm.score(docs.where("false"), model).count() == 0


def test_language_model_beats_single_words_on_held_out_texts(spark, data):
    got = ngram_lm.op11_language_model(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert got.count() == docs.count()
    held = got.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert held[2] > 10 and held[0] > held[1]
    assert {r["doc_id"] for r in got.where("held_out").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2}


# operator 12


def plain_features(text, runs, buckets):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(own), [zlib.crc32(" ".join(own[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(own) - n + 1)]


def plain_resample(rows, target, runs, buckets, share):
    found = [plain_features(t, runs, buckets) for _, t in rows]
    s = Counter(b for _, f in found for b in f)
    t = Counter(b for x in target for b in plain_features(x, runs, buckets)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], -1 if x[0] is None else x[0], x[1], x[2]))
    rank = {id(x): k for k, x in enumerate(able[: share * len(able) // 100], 1)}
    return sorted((*map(str, x[:4]), str(rank.get(id(x)))) for x in out)


@pytest.mark.parametrize(("runs", "buckets", "share"), [(1, 10_000, 10), (3, 97, 40), (2, 1000, 100), (1, 50, 0)])
def test_resampling_against_definition(spark, runs, buckets, share):
    rows = odd_rows() + more_rows() + [(900 + i, "Übergang " * 25) for i in range(30)] + [(6, "again " * 21)]
    target = [" ".join(words(40, 3)), None, "", "Übergang one"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.importance_resample(frame(spark, rows), bench, runs=runs, buckets=buckets, share=share)
    assert sorted(tuple(map(str, r)) for r in got.collect()) == plain_resample(rows, target, runs, buckets, share)


def test_resampling_of_empty_tables(spark):
    none, some = frame(spark, []), spark.createDataFrame([("a b",)], "text string")
    assert resampling.importance_resample(none, some).count() == 0
    got = resampling.importance_resample(frame(spark, more_rows()), some.where("false")).collect()
    assert len(got) == len(more_rows()) and sum(r["rank"] is not None for r in got) == 6


def test_resampling_against_sql(spark, data):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = resampling.op12_resampling(spark, data).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = con.execute(f"select doc_id, n_features, weight, score, rank from ({resampling.OP12_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


# operator 13


def plain_alignment(rows):
    """Both tokenizers over whole texts, and byte ranges compared outright."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    bytes_a, bytes_b = token_alignment.byte_level_entries(A), token_alignment.piece_bytes(b)
    found, totals = [], Counter()
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        own = (" " + text).encode() if text else b""
        if b"".join(bytes_a[x] for x in ids_a) != own or b"".join(bytes_b[x] for x in ids_b) != own:
            ids_a, ids_b = [], []
        spans = []
        for ids, table in ((ids_a, bytes_a), (ids_b, bytes_b)):
            ends, at = [], 0
            for x in ids:
                ends.append((at, at + len(table[x]), x))
                at += len(table[x])
            spans.append(ends)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for s, e, x in side if last <= s and e <= c) for side in spans))
            last = c
        links = [(x, y) for s, e, x in spans[0] for u, v, y in spans[1] if s < v and u < e]
        totals.update(links)
        found.append((i, len(ids_a), len(ids_b), groups, links))
    best = Counter()
    for (_, y), n in totals.items():
        best[y] = max(best[y], n)
    out = []
    for i, n_a, n_b, groups, links in found:
        text = ";".join(groups)
        out.append((str(i), n_a, n_b, len(groups), len(links), sum(totals[x] == best[x[1]] for x in links), sum(totals[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out)


def awkward_rows():
    texts = ["<|endoftext|> and </s> <s> <unk>", "▁ mark", "a▁b", "tabs\t\tand  blanks   here ", "  two leading", "\n", " ", "nul\x00 \x01", "don't we'll I'm", "  sep   em", "é combining １２", "🙂🙂 emoji 👩‍👩‍👧", "\r\n win \r\n lines", "ＡＢＣ ﬁ ﬂ", "日本語 テキスト です", "x" * 300, "שלום עולם", "1234567890 3.14159 $5", "� ﻿ bom", "a\x1c b\x85 c"]
    return [(1000 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block_links", [50, 2_000_000])
def test_alignment_against_whole_texts(spark, block_links):
    rows = [r for r in odd_rows() if r[0] not in (6, 7)] + more_rows() + awkward_rows()
    got = token_alignment.align_and_count(frame(spark, rows).repartition(3), A, B, digest=True, block_links=block_links)
    cols = "n_a n_b n_groups n_links n_best count_sum groups".split()
    assert sorted((str(r["doc_id"]), *(r[c] for c in cols)) for r in got.collect()) == plain_alignment(rows)


def test_alignment_groups_and_long_texts(spark):
    rows = [(6, " ".join(words(900, 1))), (None, "with special <|endoftext|>"), (7, None)]
    got = {r["doc_id"]: r for r in token_alignment.align(frame(spark, rows), A, B).collect()}
    assert {(str(i), hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else r["groups"]) for i, r in got.items()} == {(x[0], x[-1]) for x in plain_alignment(rows)}
    assert token_alignment.align_and_count(frame(spark, []), A, B).count() == 0


def test_chunks_are_forgotten_and_found_again():
    known = token_alignment.Chunks(A, B)
    texts = [t for _, t in awkward_rows()]
    before = [known.facts[c, :4].sum(axis=0).tolist() for c in known.of(texts)]
    known.forget()
    assert [known.facts[c, :4].sum(axis=0).tolist() for c in known.of(texts)] == before
