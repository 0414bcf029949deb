"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    """One star operation on edges (a, b), written: neighbours move to a node's smallest neighbour.

    The minimum comes from an aggregate with partial results and is joined back as a written table,
    so that both sides are shuffled for the join and a node with very many neighbours is split.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
    moved = both.join(low, "a")
    if large:
        moved = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    out = scratch.save(moved.filter(F.col("a") != F.col("b")).distinct(), name)
    scratch.drop(low, edges)
    return out


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes that have an edge in ``edges`` (a, b bigint); component: the smallest node.

    The state is a written table after each round; a round is two star operations, and the number of rounds
    grows with the logarithm of the nodes. Self-loops and repeated edges do no harm; edges with a
    null end are left out. Nothing but two numbers per round reaches the driver.
    """
    now = scratch.save(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        now, seen = _star(_star(now, True, scratch, "stars"), False, scratch, "edges"), mark
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
