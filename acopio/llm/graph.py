"""Connected components by contraction, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acopio.llm.shared import Table, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component: the smallest node reachable.

    Each round every node points at its smallest neighbour (or itself), pointers are
    followed a few steps, and the graph is contracted to what they point at; what is left
    shrinks geometrically.  Nothing is collected; every round is written.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = written(edges.where("a <> b").select(*pair("a", "b")).distinct())
    found: Table | None = None
    while found is None or not left.df().isEmpty():
        e = left.df()
        both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other")))
        points = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to")))
        hop = points.df().select(F.col("node").alias("to"), F.col("to").alias("next"))
        points2 = written(points.df().join(hop, "to").select("node", F.col("next").alias("to")))
        hop = points2.df().select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = written(points2.df().join(hop, "to").select("node", F.col("next").alias("to")))
        s = step.df()
        moved = e.join(s.select(F.col("node").alias("a"), F.col("to").alias("c")), "a").join(s.select(F.col("node").alias("b"), F.col("to").alias("d")), "b")
        rest = written(moved.where("c <> d").select(*pair("c", "d")).distinct())
        if found is None:
            new = step
        else:
            f = found.df()
            new = written(f.join(s.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to")))
            found.drop()
            step.drop()
        for t in (left, points, points2):
            t.drop()
        found, left = new, rest
    left.drop()
    return found.df().select("node", F.col("to").alias("component"))
