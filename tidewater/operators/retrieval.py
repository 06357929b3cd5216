"""Text retrieval: BM25, exact vector top-k, rank fusion, memory scoring, packing into a budget and deduplication."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Fixed values.
K1, B, RRF = 1.2, 0.75, 60
#: Query terms that the plan holds itself.
TERMS = 10_000
#: Bytes of a block of rows and of queries that meet in one task, and rows of it compared at a time.
ROW_BYTES, QUERY_BYTES, CHUNK = 16_000_000, 4_000_000, 4096


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of more than one character."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.char_length(w) > 1)


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query; distinct query terms count once.

    Documents are tokenised once; of their words only the queries' terms leave the scan, with the document's length. Up
    to TERMS terms are a constant of the plan, more are joined. Lengths and frequencies are over all documents."""
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    wanted = terms.select("term").distinct()
    # the explode of one array keeps the tokens from being computed again for each use
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(tokens(F.col(text_col)))).alias("w")).select("doc_id", F.size("w").alias("size"), "w")
    known = wanted.limit(TERMS + 1).toArrow().column("term").to_pylist()
    if len(known) <= TERMS:
        words = checkpointed(words.select("doc_id", "size", F.filter("w", lambda x: x.isin(known)).alias("w")))
    sizes = words.agg(F.count("*").alias("docs_"), F.avg("size").alias("mean_"))
    if len(known) <= TERMS:
        found = words.select("doc_id", "size", F.explode("w").alias("term"))
    else:
        found = words.select("doc_id", "size", F.explode("w").alias("term")).join(wanted, "term")
    tf = found.groupBy("doc_id", "size", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(df, "term").join(F.broadcast(sizes))
    idf = F.log((F.col("docs_") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_")))
    return rows.withColumn("weight", weight).join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"))


def top(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of each query with their rank, ties by id."""
    own = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


class ByCosine:
    """Cosines of a block's queries with its rows: rough ones at once, and those of `cosine`, sums in order, for a few."""

    def __init__(self, queries: pa.Array, rows: pa.Array):
        self.queries, self.rows = ([None if x is None or None in x else np.array(x, float) for x in c.to_pylist()] for c in (queries, rows))
        self.width = next((len(x) for x in self.queries if x is not None), 0)
        self.q, self.v = self._units(self.queries), self._units(self.rows)

    def _units(self, vectors: list) -> np.ndarray:
        """Vectors of length 1; nan, which says nothing, for those that have none or another number of components."""
        out = np.full((len(vectors), self.width), np.nan)
        with np.errstate(all="ignore"):
            for i, x in enumerate(vectors):
                if x is not None and len(x) == self.width and np.isfinite(n := np.sqrt(x @ x)) and n > 1e-100:
                    out[i] = x / n
        return out

    def rough(self, queries: slice, rows: slice) -> np.ndarray:
        if not self.width:
            return np.full((len(self.q[queries]), len(self.v[rows])), np.nan)
        return self.q[queries] @ self.v[rows].T

    def exact(self, query: int, rows: np.ndarray) -> list[float | None]:
        q = self.queries[query]
        out: list[float | None] = [None] * len(rows)
        same = [n for n, i in enumerate(rows) if q is not None and self.rows[i] is not None and len(self.rows[i]) == len(q)]
        if not same or not len(q):
            return out
        v = np.array([self.rows[rows[n]] for n in same])
        total = lambda x: np.add.accumulate(x, axis=1)[:, -1] + 0.0
        with np.errstate(all="ignore"):
            size = np.sqrt(total(v * v)) * np.sqrt(total((q * q)[None]))
            for n, dot, of in zip(same, total(v * q), size, strict=True):
                out[n] = None if of == 0 else float(dot / of)
        return out


class ByDistance:
    """Numbers, scored by their distance: 0 for equal ones, less for others, null if either is null."""

    def __init__(self, queries: pa.Array, rows: pa.Array):
        self.queries, self.rows = queries.to_pylist(), rows.to_pylist()
        self.q, self.v = (np.array([np.nan if x is None else x for x in c], float) for c in (self.queries, self.rows))

    def rough(self, queries: slice, rows: slice) -> np.ndarray:
        return -np.abs(self.q[queries, None] - self.v[None, rows])

    def exact(self, query: int, rows: np.ndarray) -> list[float | int | None]:
        q = self.queries[query]
        return [None if q is None or self.rows[i] is None else -abs(self.rows[i] - q) for i in rows]


def block_top(rows: DataFrame, queries: DataFrame, k: int, scorer: type, row_bytes: int = ROW_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k best rows (doc_id, v_) of each query (query_id, q_) with their rank, exactly, whatever the number of either.

    Both are cut by hash into blocks of bounded bytes. Each pair of blocks is one small group that keeps the k best of
    its queries; these are merged. Scores order as Spark orders them: nan first, null last, ties by id."""

    def blocks(df: DataFrame, value: str, size: int) -> int:
        wide = F.size(value) if df.schema[value].dataType.typeName() == "array" else F.lit(1)
        return max(1, -(-int(df.agg(F.sum(F.greatest(wide, F.lit(0)) * 8 + 16)).first()[0] or 0) // size))

    n_rows, n_queries = blocks(rows, "v_", row_bytes), blocks(queries, "q_", query_bytes)
    part = lambda c, n: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(part(["doc_id", "v_"], n_rows).alias("rows_"), each(n_queries).alias("queries_"), "doc_id", "v_")
    right = queries.select(each(n_rows).alias("rows_"), part(["query_id", "q_"], n_queries).alias("queries_"), "query_id", "q_")

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        own = own.sort_by("doc_id") if not own["doc_id"].null_count else own.take(pa.compute.sort_indices(own, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
        score = scorer(asked["q_"], own["v_"])
        # (class, score, place by id) of the best so far: nan is class 0, null 2
        best: list[list[tuple[int, float, int]]] = [[] for _ in range(asked.num_rows)]
        at_least = np.full(asked.num_rows, -np.inf)
        for a in range(0, own.num_rows, CHUNK):
            for b in range(0, asked.num_rows, CHUNK // 8):
                rough = score.rough(slice(b, b + CHUNK // 8), slice(a, a + CHUNK))
                with np.errstate(all="ignore"):
                    least = at_least[b : b + CHUNK // 8]
                    maybe = ~(rough < (least - 1e-9 * (1 + np.abs(least)))[:, None])
                for i in np.flatnonzero(maybe.any(axis=1)):
                    near = np.flatnonzero(maybe[i])
                    known = rough[i, near]
                    if len(near) > 4 * k and not np.isnan(known).any():
                        cut = np.partition(known, -k)[-k]
                        near = near[known >= cut - 1e-9 * (1 + abs(cut))]
                    for j, s in zip(near + a, score.exact(b + i, near + a), strict=True):
                        best[b + i].append((2, 0.0, j) if s is None else (0, 0.0, j) if s != s else (1, -s, j))
                    best[b + i] = sorted(best[b + i])[:k]
                    if len(best[b + i]) == k:
                        c, s, _ = best[b + i][-1]
                        at_least[b + i] = -np.inf if c == 2 else np.inf if c == 0 else -s
        found = [(i, j, None if c == 2 else np.nan if c == 0 else -s) for i, x in enumerate(best) for c, s, j in x]
        to = lambda n, t: pa.array([x[n] for x in found], t)
        ids, docs = asked["query_id"].take(to(0, pa.int64())), own["doc_id"].take(to(1, pa.int64()))
        return pa.table({"query_id": ids, "doc_id": docs, "score": pa.array([None if x[2] is None else float(x[2]) for x in found], pa.float64())})

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double"
    return top(left.groupBy("rows_", "queries_").cogroup(right.groupBy("rows_", "queries_")).applyInArrow(run, schema), k)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "q", **sizes: int) -> DataFrame:
    """The k nearest vectors of each query by cosine, exactly, for any number of queries."""
    rows = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v_"))
    return block_top(rows, queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q_")), k, ByCosine, **sizes)


def value_top(rows: DataFrame, queries: DataFrame, k: int, id_col: str, value_col: str, query_id: str, query_value: str, **sizes: int) -> DataFrame:
    """The k rows of each query whose number is nearest to its own, exactly, for any number of queries."""
    own = rows.select(F.col(id_col).alias("doc_id"), F.col(value_col).alias("v_"))
    return block_top(own, queries.select(F.col(query_id).alias("query_id"), F.col(query_value).alias("q_")), k, ByDistance, **sizes)


def fuse(first: DataFrame, second: DataFrame, k: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (query_id, doc_id, rank); a document may be in one alone."""
    a = first.select("query_id", "doc_id", F.col("rank").alias("rank_a"))
    b = second.select("query_id", "doc_id", F.col("rank").alias("rank_b"))
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    return a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("score", part("rank_a") + part("rank_b"))


def memory_score(fused: Column, age_days: Column, importance: Column, proofs: Column, observation: Column) -> Column:
    """A hit's fused score by recency (half-life 90 days), importance and, for observations, how often confirmed."""
    recency = 0.9 + 0.2 * F.pow(F.lit(0.5), age_days / 90)
    confirmed = F.when(observation, 1 + 0.05 * F.least(F.log(F.greatest(proofs, F.lit(1))), F.lit(2.0))).otherwise(1.0)
    return fused * recency * (0.9 + 0.2 * importance) * confirmed


def retain(existing: DataFrame, new: DataFrame, threshold: float) -> DataFrame:
    """(id, action, memory_id, similarity) of new facts (id, embedding): reinforce the nearest existing memory (id,
    embedding) where the cosine reaches the threshold, else add."""
    near = vector_top(existing, new.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), 1, id_col="id").where(F.col("score") >= threshold)
    rows = new.select("id").join(near.select(F.col("query_id").alias("id"), F.col("doc_id").alias("memory_id"), F.col("score").alias("similarity")), "id", "left")
    return rows.select("id", F.when(F.col("memory_id").isNull(), "add").otherwise("reinforce").alias("action"), "memory_id", "similarity")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where a value that use() names inside lambdas is computed once a row, not again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: The space separators of Unicode, which lines lose at both ends.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def normalize_whitespace(text: Column) -> Column:
    """Blanks squeezed in each line, runs of empty lines as one, none at the start; then identical lines collapsed. Tabs,
    returns and form feeds are squeezed like spaces, vertical tabs are not; other space separators go at a line's ends."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\n\f\r ]+", " "), F.lit(SPACES)))
    some = once(lines, lambda ls: F.filter(ls, lambda x, i: (x != "") | ((i > 0) & (F.element_at(ls, F.greatest(i, F.lit(1))) != ""))))
    return collapse_runs(F.array_join(some, "\n"))


def content_hash(text: Column) -> Column:
    """md5 of the trimmed, lower-cased text with its white space squeezed."""
    return F.md5(F.lower(F.regexp_replace(F.trim(text), r"\s+", " ")))


def estimate_tokens(text: Column) -> Column:
    """Rough token count: four characters each, or one and a half of the CJK ranges."""
    wide = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[぀-ヿ㐀-鿿가-힯]", ""))
    return F.ceil((F.char_length(text) - wide) / 4.0 + wide / 1.5)


def salience(text: Column) -> Column:
    """Words with a digit, a currency or percent sign, or all in capitals, over one more than all words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    marked = F.filter(words, lambda w: w.rlike(r"[0-9$%]|^\p{Lu}{2,}$"))
    return F.when(F.size(words) > 0, F.size(marked) / (F.size(words) + 1)).otherwise(0.0)


def word_shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n tokens; none of a shorter text."""
    w = tokens(text)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def never_worse(raw: Column, shorter: Column) -> Column:
    """The shorter form if it costs fewer tokens, else the raw one."""
    return F.when(estimate_tokens(shorter) < estimate_tokens(raw), shorter).otherwise(raw)


def truncate_chars(text: Column, most: int) -> Column:
    """The first `most` characters and a note of how many are gone; shorter texts as they are."""
    gone = F.char_length(text) - most
    return F.when(gone > 0, F.concat(F.substring(text, 1, most), F.lit("\n[… truncated "), gone.cast("string"), F.lit(" chars]"))).otherwise(text)


def elide_dense_lines(text: Column, least_line: int = 300, least_total: int = 2000, head: int = 160, tail: int = 80) -> Column:
    """Long lines almost without blanks, which machines wrote, keep their ends, if they are large enough in all."""
    lines = F.split(text, "\n")
    bare = lambda x: F.trim(x)
    blanks = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))
    quoted = lambda x, a, b: F.startswith(x, F.lit(a)) & F.endswith(x, F.lit(b))
    dense = lambda x: (F.octet_length(bare(x)) >= least_line) & ~F.contains(bare(x), F.lit("\t")) & (blanks(bare(x)) / F.octet_length(bare(x)) < 0.06) & ~quoted(bare(x), "{", "}") & ~quoted(bare(x), "[", "]")
    total = F.aggregate(F.filter(lines, dense), F.lit(0), lambda s, x: s + F.octet_length(x))
    size = lambda x: F.char_length(bare(x))
    short = lambda x: F.concat(F.substring(bare(x), 1, head), F.lit(" ...["), F.greatest(size(x) - head - tail, F.lit(0)).cast("string"), F.lit(" chars of dense machine-generated content elided]... "), F.substring(bare(x), -tail, tail))
    return F.when(total < least_total, text).otherwise(F.array_join(F.transform(lines, lambda x: F.when(dense(x), short(x)).otherwise(x)), "\n"))


def segments(text: Column, most_lines: int = 8, most_bytes: int = 1200) -> Column:
    """Blocks of a text, array of (text, heading, is_heading): blank lines, headings and a bounded number of lines and
    bytes part them; heading is the place, from 0, of the heading above. An ordered fold over the lines."""
    block = "struct<text:string,heading:int,is_heading:boolean>"
    none = F.lit(None).cast("int")
    start = F.struct(F.array().cast(f"array<{block}>").alias("out"), F.array().cast("array<string>").alias("lines"), F.lit(0).alias("bytes"), none.alias("heading"))

    def closed(s):
        own = F.struct(F.array_join(s["lines"], "\n").alias("text"), s["heading"].alias("heading"), F.lit(False).alias("is_heading"))
        return F.when(F.size(s["lines"]) > 0, F.concat(s["out"], F.array(own))).otherwise(s["out"])

    def state(out, lines, size, heading):
        return F.struct(out.alias("out"), lines.alias("lines"), size.alias("bytes"), heading.alias("heading"))

    def step(s, x):
        empty = F.array().cast("array<string>")
        title = F.struct(x.alias("text"), none.alias("heading"), F.lit(True).alias("is_heading"))
        full = (F.size(s["lines"]) >= most_lines) | (s["bytes"] + F.octet_length(x) > most_bytes)
        headed = state(F.concat(closed(s), F.array(title)), empty, F.lit(0), F.size(closed(s)))
        return (
            F.when(F.startswith(x, F.lit("#")), headed)
            .when(x == "", state(closed(s), empty, F.lit(0), s["heading"]))
            .when(full, state(closed(s), F.array(x), F.octet_length(x), s["heading"]))
            .otherwise(state(s["out"], F.concat(s["lines"], F.array(x)), s["bytes"] + F.octet_length(x), s["heading"]))
        )

    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.aggregate(lines, start, step, closed)


def timeframe_minutes(word: Column) -> Column:
    """Minutes of a timeframe's name (M15, 15m, h1, 1 hour, D1, weekly); null if it is none."""
    s = F.lower(F.trim(word))
    unit = F.coalesce(F.nullif(F.regexp_extract(s, r"^([mhdw])\s*\d{1,3}$", 1), F.lit("")), F.nullif(F.regexp_extract(s, r"^\d{1,3}\s*(m|min|minute|minutes|h|hr|hour|hours|d|day|w|week)$", 1), F.lit("")))
    number = F.regexp_extract(s, r"(\d{1,3})", 1).try_cast("int")
    each = F.when(F.startswith(unit, F.lit("m")), 1).when(F.startswith(unit, F.lit("h")), 60).when(F.startswith(unit, F.lit("d")), 1440).when(F.startswith(unit, F.lit("w")), 10080)
    named = F.when(s == "hourly", 60).when(s == "daily", 1440).when(s == "weekly", 10080).when(s == "monthly", 43200)
    return F.coalesce(named, number * each)


def collapse_runs(text: Column) -> Column:
    """Identical neighbouring non-empty lines become one with its count: 'line [×3]'. Linear in the lines: their starts
    first, then what lies between these."""
    one = lambda line, n: F.when(n > 1, F.concat(line, F.lit(" [×"), n.cast("string"), F.lit("]"))).otherwise(line)

    def joined(ls: Column) -> Column:
        at = lambda i: F.element_at(ls, i)
        starts = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: (at(i) == "") | (i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1)))))
        runs = once(starts, lambda ps: F.transform(ps, lambda p, k: one(at(p), F.coalesce(F.try_element_at(ps, k + 2), F.size(ls) + 1) - p)))
        return F.when(ls.isNotNull(), F.array_join(runs, "\n"))

    return once(F.split(text, "\n"), joined)


def pack_budget(rows: DataFrame, by: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """Greedy by order: the first always goes in, later ones if they still fit, larger ones are passed over.

    Room only shrinks, so of the rows of one size those that go in are the first ones, budget / size at most: only these
    few, whatever the number of rows, meet in one pass over a group. Rows of no size need no pass. Sizes below 0 are an
    error; a null one fits nowhere but in the first place, where nothing can follow it."""
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c != by]
    n = F.col(size).cast("long")
    keyed = rows.select(F.col(by).alias("by_"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row")).alias("at_"), n.alias("n_"))
    keyed = keyed.withColumn("n_", F.when(F.col("n_") < 0, F.raise_error(F.lit("a size below 0")).cast("long")).otherwise(F.col("n_")))
    first = keyed.groupBy("by_").agg(F.min(F.struct("at_", "n_")).alias("first_")).select("by_", "first_.*")
    opens = F.coalesce(F.col("n_") <= budget, F.lit(False))
    alone = first.where(~opens).select("by_", "at_")
    opened = first.where(opens).select(F.col("by_").alias("opened_"))
    inside = keyed.where((F.col("n_") >= 0) & (F.col("n_") <= budget)).join(opened, F.col("by_").eqNullSafe(F.col("opened_")), "left_semi")
    few = inside.where("n_ > 0").withColumn("part_", F.pmod(F.xxhash64("at_"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    for key in (["by_", "n_", "part_"], ["by_", "n_"]):  # a common size is first thinned in parts
        few = few.withColumn("k_", F.row_number().over(Window.partitionBy(*key).orderBy("at_"))).where(F.col("k_") <= F.floor(F.lit(budget) / F.col("n_")))
    few = few.withColumn("k_", F.row_number().over(Window.partitionBy("by_").orderBy("at_"))).select("by_", "at_", "n_", "k_")

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by("k_")
        room, takes = budget, []
        for x in own["n_"].to_pylist():
            takes.append(x <= room)
            room -= x if takes[-1] else 0
        return own.filter(pa.array(takes, pa.bool_())).select(["by_", "at_"])

    kept = few.groupBy("by_").applyInArrow(run, few.select("by_", "at_").schema)
    none = inside.where("n_ = 0").select("by_", "at_")
    return kept.unionByName(none).unionByName(alone).select(F.col("by_").alias(by), "at_.row.*")
