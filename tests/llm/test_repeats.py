import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import repeats
from tidewater.llm.repeats import common_prefix, interval_tree, op7_repeats, remove_repeats
from tidewater.llm.stored_sieve import FILE_BITS, stored_sieve

from .helpers import frame, odd_rows, words


def brute(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, int)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i + 1 : i + n + 1] = 1
        kept = bytes(np.frombuffer(d, np.uint8)[gone[1:-1] == 0])
        out.append((len(d), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def shared_passages(seed, docs=60):
    """Passages of many lengths around 200 bytes in many documents, cut and joined at random places."""
    r = random.Random(seed)
    pool = [" ".join(words(r.randint(20, 90), seed * 50 + k)) for k in range(6)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(pool)
            a = r.randrange(len(p) // 2)
            parts += [p[a : a + r.randint(100, 500)], "".join(r.choice("ab ") for _ in range(r.randint(0, 6)))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("group_rows", [3, 20_000])
def test_matches_brute_force_even_when_groups_are_split(spark, group_rows):
    rows = shared_passages(7) + [(1000 + (i or 0), t) for i, t in odd_rows() if t is None or len(t) < 5000]
    out = remove_repeats(frame(spark, rows), group_rows=group_rows).selectExpr("doc_id", "n_bytes", "n_removed", "size(starts) n", "sha2(kept, 256) s").collect()
    assert sorted((r[0], r[1], r[2], r[3], r[4]) for r in out) == sorted((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 200), strict=True))


def test_null_ids_copies_and_empty_table(spark):
    text = " ".join(words(100, 1))
    rows = [(None, text), (None, text), (3, text[:100])]
    out = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in remove_repeats(frame(spark, rows)).collect()}
    assert out == {(None, len(text)): len(text), (3, 100): 0}
    assert remove_repeats(frame(spark, [])).count() == 0


def test_a_small_sieve_changes_nothing(spark):
    rows = shared_passages(9, 20)
    few, many = (remove_repeats(frame(spark, rows), filter_bits=b).selectExpr("doc_id", "sha2(kept, 256)").collect() for b in (64, 1 << 22))
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))


def test_hot_groups_take_few_steps_and_nothing_of_the_sieve_comes_to_the_driver(spark, monkeypatch):
    steps, cut = [], repeats.checkpoint
    monkeypatch.setattr(repeats, "checkpoint", lambda df: steps.append(df) or cut(df))
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda self: pytest.fail("a table was fetched whole"))
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh") for _ in range(190))
    rows = [(i, f"{r.random()} " * r.randint(0, 4) + r.choice(["of " * r.randint(60, 120), passage + "xy"[i % 2] * r.randint(0, 30)]) + f" {r.random()}" * r.randint(0, 4)) for i in range(60)]
    out = remove_repeats(frame(spark, rows), group_rows=3).selectExpr("doc_id", "n_bytes", "n_removed", "size(starts) n", "sha2(kept, 256) s").collect()
    assert sorted(map(tuple, out)) == sorted((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 200), strict=True))
    assert len(steps) <= 4


def test_a_stored_sieve_of_several_files_passes_what_it_holds(spark):
    r = np.random.default_rng(1)
    held = r.integers(-(1 << 63), (1 << 63) - 1, 5000)
    sieve = stored_sieve(spark.createDataFrame([(int(x),) for x in held], "h long"), 4 * FILE_BITS)
    others = r.integers(-(1 << 63), (1 << 63) - 1, 5000)
    bit = lambda h: h.view(np.uint64) % np.uint64(4 * FILE_BITS)
    assert sieve.passes(held).all()
    assert (sieve.passes(others) == np.isin(bit(others), bit(held))).all()
    assert not stored_sieve(spark.createDataFrame([], "h long"), 64).passes(held).any()
    assert len(sieve.passes(held[:0])) == 0


def test_interval_tree_finds_all_common_prefix_intervals():
    rows = sorted([b"banana", b"band", b"bandit", b"can", b"canal", b"x"])
    tree = set(interval_tree(common_prefix(rows)))
    assert (3, 0, 2) in tree and (4, 1, 2) in tree and (3, 3, 4) in tree


def test_query(spark, data):
    import duckdb

    rows = duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall()
    got = {r[0]: tuple(r[1:]) for r in op7_repeats(spark, data).collect()}
    assert got == {i: b for (i, _), b in zip(rows, brute([t for _, t in rows], 200), strict=True)}
