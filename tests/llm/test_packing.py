import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewater.llm.packing import WordTokens, assign, op1_packing, pack

from .helpers import frame, odd_rows, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_assign_fills_sequences_and_keeps_every_token():
    sizes = np.array([5000, 2048, 1, 1, 700, 700, 700, 3, 2047, 1024])
    pieces = assign(sizes, 2048)
    seen = {d: [] for d in range(len(sizes))}
    used = {}
    for d, start, length, s, offset in pieces:
        seen[d].append((start, length))
        used.setdefault(s, []).append((offset, length))
    for d, own in seen.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == sizes[d]
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) == -(-sizes.sum() // 2048)


def test_assign_balances_cost_in_descending_order():
    loads = {}
    for _, _, length, s, _ in assign(np.array([900, 900, 100, 100, 50, 46]), 1098):
        loads.setdefault(s, []).append(length)
    assert sorted(map(sorted, loads.values())) == [[46, 100, 900], [50, 100, 900]]


@pytest.mark.parametrize("text", ["Hello, World. It's ÀÉÎ straße!!", "İstanbul ΟΔΟΣ ſ", "a\tb c\r\nd <|endoftext|> E<|x", "é ñ ﬁ ½ ² µ ª", "1234 +1 (988) 555-2485 | x|", "中文 \U0001f600 don't we'll", " " * 50, "", "ß.Ω,ž;"])
def test_words_encode_as_the_tokenizer_does(text):
    whole = Tokenizer.from_file(PATH)
    assert WordTokens(PATH).encode(text).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]


def test_pack_odd_documents(spark):
    rows = odd_rows()
    got = pack(frame(spark, rows), PATH, window_tokens=4000).collect()
    whole = Tokenizer.from_file(PATH)
    expect = sorted(zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in rows)
    docs = {}
    for r in got:
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    found = []
    for own in docs.values():
        own.sort(key=lambda r: r["start"])
        copies = sum(r["start"] == 0 for r in own)
        for k in range(copies):
            found.append(zlib.crc32(b"".join(bytes(r["tokens"]) for i, r in enumerate(own) if i % copies == k)))
    assert sorted(found) == expect
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_pack_empty_and_query(spark, data):
    assert pack(frame(spark, []), PATH).count() == 0
    out = op1_packing(spark, data)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    total = out.selectExpr("sum(length) t", "count(distinct sequence_id) s").first()
    assert total["t"] > 0.9 * 2048 * (total["s"] - 8)


def test_a_full_cache_changes_no_tokens(monkeypatch):
    monkeypatch.setattr("tidewater.llm.packing.WORDS_KEPT", 50)
    t, whole = WordTokens(PATH), Tokenizer.from_file(PATH)
    for seed in range(5):
        text = " ".join(words(60, seed))
        assert t.encode(text).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]
