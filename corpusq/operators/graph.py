"""Search trees and graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_iteration(nodes: DataFrame, edges: DataFrame, gamma: float, sweeps: int = 50, tolerance: float = 1e-6, cut=None) -> DataFrame:
    """V = reward for solved nodes, else gamma * the largest V of the children.

    nodes: id, reward (null if open); edges: id, child.  Each sweep is one join on
    the child; `cut` (by default a checkpoint in the shared folder; or a written
    table) bounds the lineage.  Sweeps end when no value moves by more than the
    tolerance.
    """
    cut = cut or (lambda df: df.checkpoint())
    values = cut(nodes.select("id", "reward", F.coalesce("reward", F.lit(0.0)).alias("v")))
    for _ in range(sweeps):
        best = edges.join(values.select(F.col("id").alias("child"), "v"), "child").groupBy("id").agg(F.max("v").alias("best"))
        new = cut(values.withColumnRenamed("v", "old").join(best, "id", "left").select(
            "id", "reward", F.coalesce("reward", gamma * F.col("best"), F.lit(0.0)).alias("v"), "old"))
        moved = new.agg(F.max(F.abs(F.col("v") - F.col("old")))).first()[0]
        values = new.drop("old")
        if moved is None or moved <= tolerance:
            break
    return values.select("id", "v")


def tree_labels(nodes: DataFrame, depth: int) -> DataFrame:
    """Whether a solution lies at or below a node, and the steps to it, bottom up by levels.

    nodes: id, parent, depth, solved.
    """
    done = None
    for level in range(depth, -1, -1):
        here = nodes.where(F.col("depth") == level)
        if done is None:
            labelled = here.select("id", "parent", F.col("solved").alias("below"), F.when(F.col("solved"), 0).alias("dist"))
            done, last = labelled, labelled
            continue
        up = last.groupBy("parent").agg(F.max("below").alias("b"), F.min(F.when(F.col("below"), F.col("dist"))).alias("m"))
        labelled = here.join(up.withColumnRenamed("parent", "_p"), F.col("id") == F.col("_p"), "left").select(
            "id", "parent", (F.col("solved") | F.coalesce("b", F.lit(False))).alias("below"), F.when(F.col("solved"), 0).otherwise(F.col("m") + 1).alias("dist"))
        done, last = done.unionByName(labelled), labelled
    return done.select("id", "below", "dist")


def paths_to_root(nodes: DataFrame, marked: DataFrame, depth: int) -> DataFrame:
    """Marked nodes and all their ancestors, one join for each level."""
    level = marked.select("id").distinct()
    found = level
    for _ in range(depth):
        level = level.join(nodes.select("id", "parent"), "id").where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
        found = found.unionByName(level)
    return found.distinct()


def bounded_reach(start: DataFrame, edges: DataFrame, depth: int, leaf=None) -> DataFrame:
    """Nodes reached from each start within a number of steps, with the fewest steps; leaves are not followed."""
    front = start.select("start", F.col("start").alias("node"), F.lit(0).alias("steps"))
    found = front
    for i in range(depth):
        open_nodes = front if leaf is None else front.where(~leaf)
        front = open_nodes.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(i + 1).alias("steps")).distinct()
        found = found.unionByName(front)
    return found.groupBy("start", "node").agg(F.min("steps").alias("steps"))
