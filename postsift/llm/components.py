"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one grouped minimum (partial aggregation: a hub sends one row per task) and
one join back on the node (split by AQE when a hub is hot).  Every round is written under
the checkpoint folder, so lineage stays short and a lost executor re-reads the last round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over undirected edges (a > b): every node points its larger (large star)
    or its smaller (small star) neighbours at its smallest neighbour."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = both.join(least, "u")
    if large:
        out = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b; any order, repeats and loops
    allowed, nulls dropped) the smallest node of its component.  An empty edge table gives
    an empty result.  Nodes that occur in loops only are left out."""
    e = (edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    cur, state = scratch.keep(e, "cc"), None
    for _ in range(MAX_ROUNDS):
        nxt = scratch.keep(_star(_star(cur, True), False), "cc")
        scratch.drop(cur)
        cur, was, state = nxt, state, _state(nxt)
        if state == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
