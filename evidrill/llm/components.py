"""Connected components of an edge list, with nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrill.llm.common import discard, materialize

#: Rounds after which the search is given up; alternating stars need about log2(diameter) squared at most.
MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v) with u > v.

    Large: every neighbour above a node moves to the least of the node and its neighbours.
    Small: every neighbour below a node, and the node itself, moves to the least of them.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def partial_labels(edges: DataFrame) -> DataFrame:
    """(node, component), materialized, after one pass of stars: nodes of one label are connected; a component may still have several.

    For callers that only want to know what need not be compared again, at the price of one pass.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    moved = materialize(_stars(pairs.distinct(), large=True), "passed-stars")
    labels = moved.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    # a node that is some node's label carries its own, so that both agree
    roots = moved.select(F.col("v").alias("node")).distinct().join(labels.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    out = materialize(labels.unionByName(roots), "partial-labels")
    discard(moved)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges(a, b)`` reaches.

    Nodes without edges are not in the result. Null ends and loops are left out; repeated edges count once.
    A hub of any degree is an ordinary group of an aggregate and a join, which adaptive execution can split.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current = materialize(pairs.distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        current, last = materialize(_stars(_stars(current, large=True), large=False), "stars"), current
        discard(last)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
