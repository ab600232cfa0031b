"""Connected components of an edge table by hooking, pointer jumping and contraction, with shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle


def _jumped(step: DataFrame) -> DataFrame:
    """(node, root) with every root followed to its end: paths halve in each turn, so a chain takes as many turns as the logarithm
    of its length."""
    while True:
        after = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = settle(step.join(after, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved")), "cc-jump")
        step = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return step


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); all nodes of a component share one root.

    Each round hooks every node to its smallest neighbour, follows these pointers to their ends and relabels the edges, so that
    nodes in the order of a chain fall together in one round; otherwise each edge loses at least one end. Nothing is collected:
    every table of a round is written to the shared folder. Loops and repeated edges change nothing; an empty table gives an
    empty result.
    """
    pairs = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    left = settle(pairs(edges, "a", "b"), "cc-edges")
    roots = None
    while roots is None or not left.isEmpty():
        both = left.selectExpr("a AS node", "b AS other").union(left.selectExpr("b AS node", "a AS other"))
        step = _jumped(settle(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), "cc-step"))
        if roots is None:
            roots = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = settle(roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-roots")
        one = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = settle(pairs(left.join(one, "a").join(two, "b"), "ra", "rb"), "cc-edges")
    return roots
