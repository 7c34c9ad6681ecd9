"""Connected components by contraction, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node of its component) of every node in edges.

    Each round every node points to its smallest neighbour if that is smaller,
    pointers are followed to their ends (twice as far with every join), and edges
    are redrawn between what their ends point to.  A node that outlasts two
    rounds has absorbed at least one other, so the nodes of a component halve in
    two rounds, and rounds and joins grow with the logarithm of the nodes.  Hubs
    are no burden: minima are summed before the shuffle, and no list of
    neighbours is built.  Loops and edges with a null end are ignored.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    e = written(e, "cc-edges")
    maps = []
    while not e.isEmpty():
        # Every edge's larger end has a smaller neighbour.
        p = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        p = written(p, "cc-pointers")
        while True:
            far = p.select(F.col("node").alias("to"), F.col("to").alias("far"))
            p = written(p.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "cc-pointers")
            done = p.where("moved").isEmpty()
            p = p.drop("moved")
            if done:
                break
        maps.append(p)
        for end in ("a", "b"):
            q = p.select(F.col("node").alias(end), F.col("to").alias("new"))
            e = e.join(q, end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
        e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        e = written(e, "cc-edges")
    if not maps:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("root")).where("false")
    # A node leaves the contraction once; later rounds move what it points to.
    # Each composition reads the later one twice, so it is written: nested plans
    # would double with every round.
    roots = maps[-1]
    for p in reversed(maps[:-1]):
        roots = written(_compose(p, roots), "cc-roots")
    tops = roots.select(F.col("to").alias("node")).distinct().withColumn("to", F.col("node"))
    return roots.unionByName(tops).groupBy("node").agg(F.min("to").alias("root"))


def _compose(first: DataFrame, later: DataFrame) -> DataFrame:
    """Where nodes of either end up after both."""
    then = later.select(F.col("node").alias("to"), F.col("to").alias("far"))
    moved = first.join(then, "to", "left").select("node", F.coalesce("far", "to").alias("to"))
    return moved.unionByName(later)
