import random

import pytest

from tidewater.llm.ngram_join import choose_bands, ngram_jaccard_join

from .helpers import frame, odd_rows, words


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: grams(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    root = {}
    for i in ids:
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += links[x]
    return {i: (root[i], len(links[i])) for i in ids}


def near_copies(seed):
    r = random.Random(seed)
    rows, n = [], 100
    for g in range(12):
        base = words(120, seed * 100 + g)
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "edit" + str(r.randint(0, 999))
            rows.append((n, " ".join(w)))
            n += 1
    return rows


@pytest.mark.parametrize("block_rows", [4, 400])
def test_links_match_brute_force(spark, block_rows):
    rows = near_copies(3) + odd_rows()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_jaccard_join(frame(spark, rows), block_rows=block_rows).collect()}
    assert got == brute(rows)


def test_kept_is_one_of_each_class(spark):
    rows = near_copies(5)
    out = ngram_jaccard_join(frame(spark, rows)).toPandas()
    assert (out[out.kept].groupby("class_id").size() == 1).all()
    assert set(out.class_id) == set(out[out.kept].doc_id)


def test_classes_of_an_id_with_several_texts_meet(spark):
    a, b, c = (words(80, k) for k in (71, 72, 73))
    near = lambda w: " ".join([*w[:-1], "edit"])
    rows = [(3, " ".join(a)), (20, near(a)), (20, near(b)), (20, near(b)), (7, " ".join(b)), (30, " ".join(c))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in ngram_jaccard_join(frame(spark, rows)).collect()}
    assert got == {3: (3, 1, True), 7: (3, 1, False), 20: (3, 2, False), 30: (30, 0, True)}


def test_empty_table(spark):
    assert ngram_jaccard_join(frame(spark, [])).count() == 0


def test_bands_reach_the_target_recall():
    bands, rows = choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995
    assert bands * rows <= 64
