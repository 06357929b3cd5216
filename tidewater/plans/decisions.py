"""Queries over calibration, policy, retrieval, graphs and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..operators import graph, retrieval
from ..operators.index import TermIndex
from ..session import shared_folder, spread, table
from .common import shown

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- calibration: a score of line items, their outcome and segment ---------------------------------------------------
SCORED = "s AS (SELECT l_returnflag AS seg, l_orderkey, l_linenumber, (l_quantity + l_discount * 100) / 61 AS p, (l_quantity * 7 + l_orderkey * 13) % 50 < l_quantity AS yb, 0.5::DOUBLE AS base FROM lineitem), t AS (SELECT *, yb::INTEGER AS y FROM s)"


def _scored(spark, d):
    t = table(spark, d, "lineitem")
    y = ((F.col("l_quantity") * 7 + F.col("l_orderkey") * 13) % 50 < F.col("l_quantity")).cast("int")
    return t.select(F.col("l_returnflag").alias("seg"), "l_orderkey", "l_linenumber", ((F.col("l_quantity") + F.col("l_discount") * 100) / 61).alias("p"), y.alias("y"), F.lit(0.5).alias("base"))


BIN = "greatest(0, least(9, floor(p * 10)::INTEGER))"


@query(
    f"""WITH {SCORED}, g AS (SELECT seg, {BIN} AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed FROM t GROUP BY 1, 2), e AS (SELECT seg, unnest(range(10))::INTEGER AS bin FROM (SELECT DISTINCT seg FROM t))
    SELECT e.seg, e.bin, coalesce(n, 0) AS n, round(predicted, 6) AS predicted, round(observed, 6) AS observed FROM e LEFT JOIN g ON e.seg = g.seg AND e.bin = g.bin"""
)
def reliability(spark, d):
    return shown(cal.reliability(_scored(spark, d), ["seg"], "p", "y"))


@query(f"WITH {SCORED}, g AS (SELECT seg, {BIN} AS bin, count(*) AS n, avg(p) AS a, avg(y) AS b FROM t GROUP BY 1, 2) SELECT seg, round(sum(n * abs(a - b)) / sum(n), 6) AS ece FROM g GROUP BY 1")
def ece(spark, d):
    return shown(cal.calibration_error(_scored(spark, d), ["seg"], "p", "y"))


@query(
    f"""WITH {SCORED}, q AS (SELECT *, greatest(least(p, 1 - 1e-12), 1e-12) AS c FROM t)
    SELECT seg, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg((base - y) ** 2), 6) AS brier_base, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_loss, round(avg(((p >= 0.5)::INTEGER = y)::INTEGER), 6) AS accuracy,
    round(1 - avg((p - y) ** 2) / avg((base - y) ** 2), 6) AS skill FROM q GROUP BY 1"""
)
def brier(spark, d):
    return shown(cal.binary_scores(_scored(spark, d), ["seg"], "p", "y", "base"))


_T = ", ".join(map(str, cal.T_95))


@query(
    f"""WITH {SCORED}, g AS (SELECT seg, ntile(20) OVER (PARTITION BY seg ORDER BY l_orderkey, l_linenumber, p, y) AS b, (base - y) ** 2 - (p - y) ** 2 AS gain FROM t), m AS (SELECT seg, b, avg(gain) AS m FROM g GROUP BY 1, 2),
    k AS (SELECT seg, avg(m) AS mean_gain, stddev_samp(m) AS sd, count(*) AS blocks FROM m GROUP BY 1), l AS (SELECT *, mean_gain - ([{_T}])[least(greatest(blocks - 1, 1), 19)] * sd / sqrt(blocks) AS lower FROM k)
    SELECT seg, round(mean_gain, 6) AS mean_gain, blocks, round(lower, 6) AS lower, mean_gain > 0 AND lower > 0 AS skilled FROM l"""
)
def skill_blocks(spark, d):
    rows = _scored(spark, d).withColumn("gain", F.pow(F.col("base") - F.col("y"), 2) - F.pow(F.col("p") - F.col("y"), 2))
    return shown(cal.block_skill(rows, ["seg"], "gain", ["l_orderkey", "l_linenumber", "p", "y"]), "seg", "mean_gain", "blocks", "lower", "skilled")


@query(
    f"""WITH {SCORED}, v AS (SELECT seg, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM t GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY seg ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
    SELECT seg, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM c GROUP BY 1"""
)
def auc(spark, d):
    return shown(cal.rank_auc(_scored(spark, d), ["seg"], "p", "y"))


@query("WITH t AS (SELECT n_name AS seg, (c_acctbal > 4000)::INTEGER AS y FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT seg, count(*) AS n, round(CASE WHEN count(*) >= 60 THEN avg(y) ELSE (SELECT avg(y) FROM t) END, 6) AS rate FROM t GROUP BY 1")
def segment_priors(spark, d):
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("seg"), (F.col("c_acctbal") > 4000).cast("int").alias("y"))
    return shown(cal.base_rates(rows, "seg", "y", 60))


PROBS = "q AS (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_discount * 600 + 1 AS b, l_tax * 600 + 1 AS h FROM lineitem), t AS (SELECT *, h / (a + b + h) AS p_hold, a / (a + b + h) AS p_buy, b / (a + b + h) AS p_sell FROM q)"


def _probabilities(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 1).alias("a"), (F.col("l_discount") * 600 + 1).alias("b"), (F.col("l_tax") * 600 + 1).alias("h"))
    total = F.col("a") + F.col("b") + F.col("h")
    return rows.select("l_orderkey", "l_linenumber", (F.col("h") / total).alias("p_hold"), (F.col("a") / total).alias("p_buy"), (F.col("b") / total).alias("p_sell"))


@query(
    f"""WITH {PROBS}, e AS (SELECT *, CASE WHEN p_buy >= p_sell THEN 'buy' ELSE 'sell' END AS side, greatest(p_buy, p_sell) AS p, greatest(p_buy, p_sell) - 11.0::DOUBLE / 30 AS edge, least(greatest((greatest(p_hold, p_buy, p_sell) - 1.0::DOUBLE / 3) / (2.0::DOUBLE / 3), 0), 1) AS confidence FROM t)
    SELECT l_orderkey, l_linenumber, side, round(p, 6) AS p, round(edge, 6) AS edge, round(confidence, 6) AS confidence, CASE WHEN p > p_hold AND edge >= 0.05 AND confidence >= 0.15 THEN 'act' WHEN edge >= 0.02 THEN 'confirm' ELSE 'hold' END AS tier FROM e"""
)
def policy_tiers(spark, d):
    return shown(cal.tiers(_probabilities(spark, d), 10.0, 20.0, F.lit(1.0)), "l_orderkey", "l_linenumber", "side", "p", "edge", "confidence", "tier")


@query(
    f"""WITH {SCORED}, k AS (SELECT l_orderkey, l_linenumber, p, 2.0::DOUBLE AS b, greatest(0, p - (1 - p) / 2) AS kelly FROM t WHERE p < 1), f AS (SELECT *, least(0.02, kelly * 0.25) AS stake FROM k)
    SELECT l_orderkey, l_linenumber, round(kelly, 6) AS kelly, round(stake, 6) AS stake, round(CASE WHEN stake <= 0 THEN 0 ELSE p * ln(1 + stake * b) + (1 - p) * ln(1 - stake) END, 6) AS growth FROM f"""
)
def kelly(spark, d):
    rows = _scored(spark, d).where("p < 1")
    p, b = F.col("p"), F.lit(2.0)
    return shown(rows.select("l_orderkey", "l_linenumber", cal.kelly(p, b).alias("kelly"), cal.stake(p, b).alias("stake"), cal.log_growth(p, b, cal.stake(p, b)).alias("growth")))


@query(f"WITH {SCORED} SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, {BIN} AS bin, sum(y) AS wins, sum(1 - y) AS losses FROM (SELECT DISTINCT l_orderkey, l_linenumber, p, y FROM t) GROUP BY 1, 2")
def ledger_bins(spark, d):
    rows = _scored(spark, d).select(F.concat_ws(":", "l_orderkey", "l_linenumber", "p", "y").alias("decision_id"), F.when(F.col("l_linenumber") % 2 == 0, "buy").otherwise("sell").alias("side"), "p", (F.col("y") == 1).alias("won"))
    return cal.ledger(rows.unionByName(rows.where("side = 'buy'")))  # reported twice, counted once


WINS = "w AS (SELECT s_nationkey AS k, sum((s_acctbal > 3000)::INTEGER) AS wins, count(*) AS n FROM supplier GROUP BY 1)"


def _wins(spark, d):
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum((F.col("s_acctbal") > 3000).cast("int")).alias("wins"), F.count("*").alias("n"))


@query(
    f"""WITH {WINS}, e AS (SELECT w.*, unnest(range(0, n + 1)) AS i FROM w), m AS (SELECT k, wins, n, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.4::DOUBLE) + (n - i) * ln(0.6::DOUBLE))) FILTER (WHERE i >= wins) AS p FROM e GROUP BY 1, 2, 3) SELECT k, wins, n, round(p, 6) AS p_value FROM m"""
)
def binomial_test(spark, d):
    return shown(_wins(spark, d).select("k", "wins", "n", cal.binomial_tail(F.col("wins"), F.col("n"), F.lit(0.4)).alias("p_value")))


@query(
    f"""WITH {WINS}, e AS (SELECT w.*, unnest(range(0, wins::BIGINT + 1)) AS i FROM w), m AS (SELECT k, sum(exp(lgamma(n + 2) - lgamma(i + 1) - lgamma(n + 1 - i + 1) + i * ln(0.4::DOUBLE) + (n + 1 - i) * ln(0.6::DOUBLE))) AS p FROM e GROUP BY 1) SELECT k, round(p, 6) AS above FROM m"""
)
def posterior(spark, d):
    return shown(_wins(spark, d).select("k", cal.posterior_above(F.col("wins"), F.col("n") - F.col("wins"), F.lit(0.4)).alias("above")))


@query(f"WITH {WINS}, p AS (SELECT k, wins / n AS p FROM w) SELECT k, CASE WHEN p > 0.4 AND p < 1 THEN ceil(((1.6448536 * sqrt(0.24::DOUBLE) + 0.8416212 * sqrt(p * (1 - p))) / (p - 0.4)) ** 2)::BIGINT END AS trades FROM p")
def trades_needed(spark, d):
    return _wins(spark, d).select("k", cal.trades_needed(F.col("wins") / F.col("n"), F.lit(0.4)).alias("trades"))


@query(f"WITH {WINS}, p AS (SELECT *, wins / n AS p, 1.959964 AS z FROM w) SELECT k, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM p")
def wilson(spark, d):
    from ..operators.outcomes import wilson as interval

    low, high = interval(F.col("wins"), F.col("n"))
    return shown(_wins(spark, d).select("k", low.alias("low"), high.alias("high")))


@query(
    f"""WITH {PROBS}, v AS (SELECT l_orderkey, l_linenumber, [p_hold, p_buy, p_sell] AS p FROM t), m AS (SELECT *, list_position(p, list_max(p)) - 1 AS top FROM v)
    SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, (list_max(p) - 1.0::DOUBLE / 3) / (2.0::DOUBLE / 3))), 6) AS choice, round(greatest(0, 1 - (p[1] * abs(0 - top) + p[2] * abs(1 - top) + p[3] * abs(2 - top)) / (2.0::DOUBLE / 3)), 6) AS score FROM m"""
)
def confidence(spark, d):
    rows = _probabilities(spark, d).withColumn("p", F.array("p_hold", "p_buy", "p_sell"))
    return shown(rows.select("l_orderkey", "l_linenumber", cal.choice_confidence(F.col("p")).alias("choice"), cal.score_confidence(F.col("p")).alias("score")))


# ---- retrieval -------------------------------------------------------------------------------------------------------
TOK = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) > 1)"


def _bm25(where: str) -> str:
    return rf"""words AS (SELECT doc_id, {TOK} AS w FROM documents), terms AS (SELECT item_id AS query_id, unnest(list_distinct({TOK})) AS term FROM benchmark WHERE {where}),
    size AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM words), x AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM words), tf AS (SELECT doc_id, size, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    bm AS (SELECT query_id, doc_id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), size GROUP BY 1, 2)"""


def _queries(spark, d):
    """The stated query set of searches: every item whose id is divisible by 100."""
    return table(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _texts(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


@query(f"WITH {_bm25('item_id % 100 = 0')} SELECT query_id, doc_id, round(score, 5) AS score FROM bm")
def bm25(spark, d):
    return retrieval.bm25(_texts(spark, d), _queries(spark, d)).withColumn("score", F.round("score", 5))


def _indexed(spark, d):
    """The texts as an index of two segments in the shared folder."""
    index = TermIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    texts = _texts(spark, d)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    index.add(texts.where(half == 0))
    index.add(texts.where(half == 1))
    return index


@query(f"WITH {_bm25('item_id % 100 = 0')} SELECT query_id, doc_id, round(score, 5) AS score FROM bm")
def indexed_search(spark, d):
    return _indexed(spark, d).search(_queries(spark, d)).withColumn("score", F.round("score", 5))


@query(f"WITH {_bm25('item_id % 100 = 0')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) SELECT query_id, round(score, 5) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 20")
def indexed_top(spark, d):
    """Scores of the twenty best; equal ones differ in their last bits, so ids of ties are left out."""
    return _indexed(spark, d).search_top(_queries(spark, d), 20).select("query_id", F.round("score", 5).alias("score"), F.col("rank").cast("int").alias("rank"))


VEC = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM embeddings, q), vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v)"


@query(f"WITH {VEC} SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM vt WHERE rank <= 10")
def cosine_topk(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return shown(retrieval.vector_top(v, q, 10))


@query(
    f"""WITH {VEC}, a AS (SELECT query_id, doc_id, rank FROM vt WHERE rank <= 20), w AS (SELECT a.query_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY a.query_id ORDER BY abs(e.label - a.label), e.vec_id) AS rank FROM (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 100 = 0) a, embeddings e),
    b AS (SELECT * FROM w WHERE rank <= 20) SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank::INTEGER AS rank_a, b.rank::INTEGER AS rank_b, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 6) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id"""
)
def rrf(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0")
    first = retrieval.vector_top(v, q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 20)
    second = retrieval.value_top(v, q, 20, "vec_id", "label", "vec_id", "label")
    return shown(retrieval.fuse(first, second))


@query("SELECT doc_id, md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS h FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", retrieval.content_hash(F.col("text")).alias("h"))


@query("WITH h AS (SELECT doc_id, md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS h FROM documents) SELECT min(doc_id) AS doc_id, count(*) AS proofs FROM h GROUP BY h")
def exact_dedup(spark, d):
    return table(spark, d, "documents").groupBy(retrieval.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("proofs")).drop("h")


@query(rf"SELECT doc_id, len({TOK}) AS n, {TOK}[1] AS first_token FROM documents")
def tokenize(spark, d):
    w = retrieval.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.try_element_at(w, F.lit(1)).alias("first_token"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", retrieval.estimate_tokens(F.col("text")).alias("tokens"))


@query(rf"WITH t AS (SELECT item_id, {TOK} AS w FROM benchmark) SELECT item_id, CASE WHEN len(w) < 3 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END::BIGINT AS n FROM t")
def shingles(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(retrieval.word_shingles(F.col("text"))).cast("long").alias("n"))


@query(r"WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '[0-9$%]|^\p{Lu}{2,}$'))) / (len(w) + 1) ELSE 0 END, 6) AS salience FROM t")
def salience(spark, d):
    return shown(table(spark, d, "documents").select("doc_id", retrieval.salience(F.col("text")).alias("salience")))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), p AS (SELECT *, CASE WHEN line <> '' AND line = lag(line) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM l),
    r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p), g AS (SELECT doc_id, run, min(line) AS line, count(*) AS n FROM r GROUP BY 1, 2) SELECT doc_id, md5(string_agg(CASE WHEN n > 1 THEN line || ' [×' || n || ']' ELSE line END, chr(10) ORDER BY run)) AS h FROM g GROUP BY 1"""
)
def collapse_runs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(retrieval.collapse_runs(F.col("text"))).alias("h"))


@query(
    """WITH RECURSIVE t AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars % 17, doc_id) AS k FROM documents),
    w(source, k, doc_id, used, takes) AS (SELECT source, k, doc_id, n_chars, true FROM t WHERE k = 1 UNION ALL SELECT t.source, t.k, t.doc_id, CASE WHEN w.used + t.n_chars <= 8000 THEN w.used + t.n_chars ELSE w.used END, w.used + t.n_chars <= 8000 FROM w JOIN t ON t.source = w.source AND t.k = w.k + 1)
    SELECT source, doc_id FROM w WHERE takes"""
)
def pack_context(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return retrieval.pack_budget(rows, "source", [F.col("n_chars") % 17, F.col("doc_id")], "n_chars", 8000).select("source", "doc_id")


# ---- graphs ----------------------------------------------------------------------------------------------------------
@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey // 2 IN (SELECT p_partkey FROM part)), l(k, level) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT dst FROM e) UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.k)
    SELECT k AS key, max(level)::INTEGER AS level FROM l GROUP BY 1"""
)
def dag_levels(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    return graph.levels(nodes, nodes.select(F.floor(F.col("key") / 2).alias("src"), F.col("key").alias("dst")))


STATUS = "CASE c_custkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'pending' END"


@query(
    f"""WITH n AS (SELECT c_custkey AS key, {STATUS} AS status, [c_custkey // 2, c_custkey // 3] AS deps FROM customer), x AS (SELECT key, unnest(deps) AS dep FROM n WHERE status = 'pending'),
    s AS (SELECT x.key, bool_and(n.status <> 'pending') AS settled, bool_and(n.status = 'complete') AS complete FROM x JOIN n ON n.key = x.dep GROUP BY 1)
    SELECT n.key, CASE WHEN coalesce(complete, true) THEN 'run' WHEN settled THEN 'skip' ELSE 'wait' END AS action FROM n LEFT JOIN s ON s.key = n.key WHERE n.status = 'pending'"""
)
def dag_ready(spark, d):
    k = F.col("c_custkey")
    status = F.when(k % 4 == 0, "complete").when(k % 4 == 1, "failed").otherwise("pending")
    nodes = table(spark, d, "customer").select(k.alias("key"), status.alias("status"), F.array(F.floor(k / 2), F.floor(k / 3)).alias("depends_on"))
    return graph.schedule_step(nodes)


@query("WITH RECURSIVE w(key, up, depth) AS (SELECT s_suppkey, s_suppkey // 3, 0 FROM supplier UNION ALL SELECT w.key, s.s_suppkey // 3, w.depth + 1 FROM w JOIN supplier s ON s.s_suppkey = w.up WHERE w.depth < 8), h AS (SELECT key, max(depth) AS d, arg_max(up, depth) AS up FROM w GROUP BY 1) SELECT key, least(8, d + 1)::INTEGER AS depth FROM h")
def hire_depth(spark, d):
    return graph.chain_depth(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.floor(F.col("s_suppkey") / 3).alias("boss")), "key", "boss")


# ---- relational forms ------------------------------------------------------------------------------------------------
@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def outer_fuse(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full_outer")


@query("SELECT n_name, count(c_custkey) AS customers, coalesce(round(sum(c_acctbal), 2), 0) AS balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def parent_counts(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("customers", F.lit(0).cast("long")).alias("customers"), F.coalesce("balance", F.lit(0.0)).alias("balance"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def anti_seen(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey").exceptAll(table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct())


@query("SELECT user_id, event_type, n, rank::INTEGER AS rank FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY 1, 2) WHERE rank <= 2")
def topk_by_user(spark, d):
    return retrieval.top(table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), 2, by="user_id", score="n", tie="event_type")


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def newest_events(spark, d):
    return shown(table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200), "event_id", "event_type", "value")


@query("SELECT event_type, sum((json_extract(props, '$.k'))::BIGINT) AS total FROM events GROUP BY 1")
def json_sum(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query(
    """WITH s AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 hours THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s)
    SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM r GROUP BY user_id, run"""
)
def sessions(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    gap = F.col("ts") - F.lag("ts").over(own)
    rows = rows.withColumn("new", F.when(gap <= F.expr("interval 6 hours"), 0).otherwise(1)).withColumn("run", F.sum("new").over(own))
    return shown(rows.groupBy("user_id", "run").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("run"))
