"""Connected components of a graph as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each u; partial minima are taken before the shuffle, so a hub costs
    one row per task. Joins on a hub are split by adaptive execution."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of the edge table reaches.

    edges: the first two columns are the ends of a link, of one orderable type; direction,
    repetition, loops and rows with a null end have no effect. Large-star and small-star steps
    alternate; each result is written to the shared folder, and the loop ends when an edge table
    repeats. Nodes with no edge to another node are not listed.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"),
                         F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b)))
    edges = written(edges.where(~F.col(edges.columns[2])).select("u", "v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        state_before, state = state, edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == state_before or not state[0]:
            break
        edges = written(_small_star(_large_star(edges).distinct()).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
