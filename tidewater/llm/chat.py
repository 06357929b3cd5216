"""Chat logs: collapse of cumulative snapshots, and rendering of the conversations that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _turns(chats: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Distinct turns with their number k in the conversation and the rolling hash of all turns up to it."""
    turns = chats.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    turns = turns.distinct()
    own = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("k", F.row_number().over(own))
    # a turn's hash holds its number, so the combination over a prefix depends on their order
    rolling = [F.bit_xor(F.xxhash64(F.lit(seed), "k", "role", "text")).over(so_far).alias(f"h{seed}") for seed in (1, 2)]
    size = F.count("*").over(Window.partitionBy("conv_id")).alias("size")
    return turns.select("conv_id", "k", "role", "text", *rolling, size)


def maximal_conversations(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, k, role, text) of conversations that aren't a prefix of a longer one, k from 1; of equal ones the
    smallest conv_id stays.

    Prefix hashes are grouped, never paired, so a first turn that many conversations share costs one row of each task.
    Turns go by number, nulls first, then role and text; a turn logged again in its conversation counts once, so two
    equal turns without a number are one. A null role is "unknown", a null text empty; rows without a conv_id are left
    out. Very long texts are hashed whole; the turns of one conversation are ordered in one task, which spills. An empty
    table gives no rows; other columns are ignored.
    """
    turns = _turns(chats, conv_col, turn_col, role_col, text_col)
    ends = F.when(F.col("k") == F.col("size"), F.col("conv_id"))
    known = turns.groupBy("k", "h1", "h2").agg(F.max("size").alias("longest"), F.min(ends).alias("keeper"), F.count(ends).alias("ending"))
    known = known.where("ending > 0 and (ending > 1 or longest > k)")
    full = turns.where("k = size").select("conv_id", "k", "h1", "h2")
    covered = full.join(known, ["k", "h1", "h2"]).where("longest > k or conv_id <> keeper").select("conv_id")
    return turns.select("conv_id", "k", "role", "text").join(covered, "conv_id", "left_anti")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered): each turn as <|role|>, a line feed, its text and <|end|>, joined by line feeds."""
    one = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", one.alias("line")))), lambda s: s["line"]), "\n")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), joined.alias("rendered"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation that no longer one begins with, rendered."""
    return render(maximal_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP9_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
l AS (SELECT conv_id, k, '<|' || role || '|>' || chr(10) || text || '<|end|>' AS line FROM o),
p AS (SELECT conv_id, k, list(line) OVER (PARTITION BY conv_id ORDER BY k) AS prefix, count(*) OVER (PARTITION BY conv_id) AS size FROM l),
f AS (SELECT conv_id, size, prefix FROM p WHERE k = size),
g AS (SELECT prefix, max(size) AS longest, min(conv_id) FILTER (WHERE k = size) AS keeper FROM p GROUP BY prefix)
SELECT f.conv_id, f.size AS n_turns, array_to_string(f.prefix, chr(10)) AS rendered
FROM f JOIN g USING (prefix) WHERE g.longest = f.size AND g.keeper = f.conv_id
"""
