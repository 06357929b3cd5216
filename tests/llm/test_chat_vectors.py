import numpy as np
import pytest

from tidewater.llm.chat import maximal_conversations, op9_chat, render
from tidewater.llm.common import connected_components
from tidewater.llm.embedding_dedup import near_duplicate_vectors


def test_snapshots_collapse(spark):
    talks = {
        1: [("user", "a"), ("assistant", "b")],
        2: [("user", "a"), ("assistant", "b"), ("user", "c")],
        3: [("user", "a"), ("assistant", "x")],
        4: [("user", "a"), ("assistant", "b"), ("user", "c")],
        5: [("user", "a")],
        6: [(None, None)],
        7: [("assistant", "b"), ("user", "a")],
    }
    rows = [(c, t, r, x, "clash", 0) for c, own in talks.items() for t, (r, x) in enumerate(own)] + [(2, 0, "user", "a", "clash", 0), (None, 0, "user", "a", "clash", 0)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h1 string, k int")
    out = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in render(maximal_conversations(chats)).collect()}
    assert set(out) == {2, 3, 6, 7}
    assert out[3] == (2, "<|user|>\na<|end|>\n<|assistant|>\nx<|end|>")
    assert out[6] == (1, "<|unknown|>\n<|end|>")
    assert render(maximal_conversations(chats.where("false"))).count() == 0


def test_chat_query_keeps_all_without_a_longer_one(spark, data):
    assert op9_chat(spark, data).count() > 0


def brute(rows, threshold=0.9):
    d = 8
    ok = {}
    for i, v in rows:
        if i is None:
            continue
        good = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.setdefault(i, []).append(np.array(v, float) / np.linalg.norm(v) if good else None)
    ids = sorted(ok)
    links = {a: {b for b in ids if a != b and any(x is not None and y is not None and len(x) == len(y) and float(x @ y) >= threshold for x in ok[a] for y in ok[b])} for a in ids}
    root = {}
    for i in ids:
        todo = [] if i in root else [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return {i: (len(links[i]), root[i], root[i] == i) for i in ids}


@pytest.mark.parametrize("block_rows", [10, 4096])
def test_vectors_match_brute_force(spark, block_rows):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] * r.uniform(0.1, 50) + r.normal(size=8) * 0.25).tolist()) for i in range(150)]
    rows += [(i, [0.5] * 8) for i in range(200, 230)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] + [1.0] * 7), (304, [1.0] * 7), (305, []), (306, [float("inf")] + [1.0] * 7), (308, [2.0] * 7), (309, [3.0]), (310, [-1.0]), (311, [0.25]), (None, [1.0] * 8), (200, [0.5] * 8), (307, [1e200] * 8)]
    vectors = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<double>, label int, x string")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in near_duplicate_vectors(vectors, block_rows=block_rows, tile_rows=7).collect()}
    expect = brute([(i, [0.5] * 8 if i == 307 else v) for i, v in rows])
    assert got == expect


def test_empty_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicate_vectors(empty).count() == 0
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in near_duplicate_vectors(none).collect()] == [(1, 0, 1, True)]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (101, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
