"""Connected components of an edge table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm._shared import discard, store


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct edges between different nodes, from the larger to the smaller."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _roots(down: DataFrame) -> DataFrame:
    """(a, b): each node that has a smaller neighbour with the end of its path over smallest neighbours. Each step doubles the path."""
    low = store(down.groupBy("a").agg(F.min("b").alias("b"), F.lit(True).alias("moved")), "lows")
    while not low.where("moved").isEmpty():
        on = low.select(F.col("a").alias("b"), F.col("b").alias("far"))
        new = store(low.join(on, "b", "left").select("a", F.coalesce("far", "b").alias("b"), F.col("far").isNotNull().alias("moved")), "lows")
        discard(low)
        low = new
    return low


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): each node of `edges` (a, b; longs) with the smallest node that it reaches. Each round merges every node that has a smaller
    neighbour into the root of its smallest one and keeps the edges between roots. Two rounds at least halve the nodes that
    still have an edge; it ends when no edge is left."""
    edges = store(edges.select("a", "b").distinct(), "edges")
    lab = edges.select(F.col("a").alias("v")).unionByName(edges.select(F.col("b").alias("v"))).distinct().withColumn("comp", F.col("v"))
    down, done = store(_downward(edges), "downward"), [edges]
    while not down.isEmpty():
        roots = _roots(down)
        done.append(roots)
        lab = lab.join(roots.select(F.col("a").alias("comp"), F.col("b").alias("root")), "comp", "left").select("v", F.coalesce("root", "comp").alias("comp"))
        ra, rb = (roots.select(F.col("a").alias(x), F.col("b").alias(f"r{x}")) for x in "ab")
        new = down.join(ra, "a").join(rb, "b", "left").select(F.col("ra").alias("a"), F.coalesce("rb", "b").alias("b"))
        new = store(_downward(new), "downward")
        discard(down)
        down = new
    discard(down)
    lab = store(lab, "labels")
    for table in done:
        discard(table)
    return lab
