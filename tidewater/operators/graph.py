"""Dependency graphs as tables: validity, levels, ready sets, chains of command."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def levels(nodes: DataFrame, edges: DataFrame, node: str = "key", src: str = "src", dst: str = "dst") -> DataFrame:
    """(key, level) of every node that is on no cycle and behind none: 0 without dependencies, else one over the highest
    of them (dst depends on src). Nodes of cycles and what hangs on them are missing. Rounds follow the longest chain;
    each round's table is checkpointed, so lineage stays short."""
    from ..session import checkpointed

    todo = nodes.select(F.col(node).alias("key")).distinct()
    deps = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    deps = checkpointed(deps.join(todo.select(F.col("key").alias("src")), "src", "left_semi").join(todo.select(F.col("key").alias("dst")), "dst", "left_semi"))
    done, level = None, 0
    while True:
        ready = checkpointed(todo.join(deps.select(F.col("dst").alias("key")).distinct(), "key", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return ready if done is None else done
        done = ready if done is None else done.unionByName(ready)
        todo = checkpointed(todo.join(ready, "key", "left_anti"))
        deps = checkpointed(deps.join(ready.select(F.col("key").alias("src")), "src", "left_anti"))
        level += 1


def is_acyclic(nodes: DataFrame, edges: DataFrame) -> bool:
    return levels(nodes, edges).count() == nodes.select("key").distinct().count()


def schedule_step(nodes: DataFrame, terminal=("complete", "failed", "skipped")) -> DataFrame:
    """Of pending nodes (key, status, depends_on): run those whose dependencies are all complete, skip those whose are
    all settled but not all complete; others wait. Unknown dependencies don't count."""
    deps = nodes.where("status = 'pending'").select("key", F.explode("depends_on").alias("dep"))
    state = nodes.select(F.col("key").alias("dep"), F.col("status").alias("dep_status"))
    seen = deps.join(state, "dep").groupBy("key").agg(F.bool_and(F.col("dep_status").isin(*terminal)).alias("settled"), F.bool_and(F.col("dep_status") == "complete").alias("complete"))
    rows = nodes.where("status = 'pending'").select("key").join(seen, "key", "left")
    return rows.select("key", F.when(F.coalesce("complete", F.lit(True)), "run").when(F.col("settled"), "skip").otherwise("wait").alias("action"))


def chain_depth(nodes: DataFrame, node: str, parent: str, most: int = 8) -> DataFrame:
    """Length of each node's chain of parents, `most` at the longest; cycles stop there."""
    link = nodes.select(F.col(node).alias("n_"), F.col(parent).alias("p_"))
    walk = nodes.select(F.col(node).alias("key"), F.col(parent).alias("at"), F.lit(0).alias("depth"))
    for _ in range(most):
        up = link.select(F.col("n_").alias("at"), F.col("p_").alias("next"))
        walk = walk.join(up, "at", "left").select("key", F.col("next").alias("at"), F.when(F.col("at").isNotNull(), F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"))
    return walk.select("key", "depth")
