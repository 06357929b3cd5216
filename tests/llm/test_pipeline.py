import time
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
from tidewater.llm import common, decontaminate, pii, queries
from tidewater.llm.ngram_join import ngram_jaccard_join

from .helpers import words
from .test_ngram_join import brute


def _docs(spark):
    good = [(i, ". ".join(" ".join(words(14, i * 31 + k)).capitalize() for k in range(9)) + ".") for i in range(120)]
    good = [(i, t + (" Mail a.b@c.de and 70.1.2.3 now." if i % 6 == 5 else "")) for i, t in good]
    near = [(200 + i, good[i][1].replace("Bak", "Dol", 1)) for i in range(10)]
    junk = [(300 + i, " ".join(w.upper() + "!!" for w in words(90, 5000 + i))) for i in range(30)]
    rows = [*good, *near, good[3], *junk, (None, ". ".join(" ".join(words(14, 9000 + k)).capitalize() for k in range(9)) + ". Mail a.b@c.de and 70.1.2.3 now")]
    return good, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_in_turn(spark, tmp_path):
    good, docs = _docs(spark)
    labels = [(i, 1) for i in range(120)] + [(300 + i, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(good[7][1].split()[10:50]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = dict(corpus_pipeline.STAGES)
    assert list(names) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "personal data", "packing"]
    kept = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and ids >= {i for i in range(120)} and not any(i and i >= 300 for i in ids)
    once = corpus_pipeline.keep_one_of_near_copies(spark, kept, str(tmp_path))
    texts = [(r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None]
    expect = {c for c, _ in brute(texts).values()}
    assert sorted(r["doc_id"] for r in once.collect() if r["doc_id"] is not None) == sorted(expect)
    assert once.where("doc_id is null").count() == 1 and once.columns == docs.columns
    clean = corpus_pipeline.keep_unleaked(spark, once, str(tmp_path))
    assert {r["doc_id"] for r in once.collect()} - {r["doc_id"] for r in clean.collect()} == {7}
    masked = corpus_pipeline.mask_personal_data(spark, clean, str(tmp_path))
    row = masked.where("doc_id is null").first()
    assert row["text"].endswith("Mail <EMAIL> and <IP> now") and row["n_chars"] == len(row["text"]) and masked.columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == masked.select("doc_id").distinct().count()


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    a, b, c = (words(80, k) for k in (51, 52, 53))
    rows = [(1, " ".join(a)), (2, " ".join([*a[:-1], "edit"])), (2, " ".join(b)), (2, " ".join(b)), (3, " ".join([*b[:-1], "edit"])), (4, " ".join(c)), (None, " ".join(c)), (None, " ".join(c)), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], *rows[5:]], key=str)


def test_every_operator_has_a_query(spark):
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert ngram_jaccard_join and decontaminate and pii


def test_runs_side_by_side_keep_their_tables(spark):
    def run(n):
        mark = common.table_mark()
        common.written(spark.range(n))
        kept = common.written(spark.range(n + 1))
        common.drop_tables(spark, mark)
        time.sleep(1)
        return kept.count()

    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(run, (1, 2, 3))) == [2, 3, 4]
