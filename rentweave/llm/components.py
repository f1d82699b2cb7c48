"""Connected components of a distributed graph by contraction.

In each round every node hooks onto its least neighbour, if that one is less than itself, chains are halved by one jump, and
edges are rewritten to the hooks; loops and repeats go. Least is by node in even rounds (a star around its least node
is gone in one) and by a hash that changes with the round in odd ones (which halves long paths). Only aggregates with map-side
combine and joins against one row a node are used, so a hub with very many edges is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentweave.llm.common import small, staged

FEW_COMPONENTS = 500_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in an edge between two different nodes; a component is named by its least node.

    Null ends, loops and repeated edges add nothing; no edges give no rows.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    live = staged(live, "edges")
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("at", F.col("node"))
    turn = 0
    while not live.isEmpty():
        order = (lambda c: c) if turn % 2 == 0 else (lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("h"), c.alias("n")))
        both = live.union(live.select("b", "a"))
        least = both.groupBy("a").agg(F.min_by("b", order(F.col("b"))).alias("b"))
        hook = staged(least.select("a", F.when(order(F.col("b")) < order(F.col("a")), F.col("b")).otherwise(F.col("a")).alias("p")), "hooks")
        up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
        jump = staged(hook.join(up, "p").select(F.col("a").alias("at"), F.col("q").alias("to")), "jumps")
        nodes = nodes.join(jump, "at", "left").select("node", F.coalesce("to", "at").alias("at"))
        ends = live.join(jump.select(F.col("at").alias("a"), F.col("to").alias("x")), "a")
        ends = ends.join(jump.select(F.col("at").alias("b"), F.col("to").alias("y")), "b")
        live = staged(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        turn += 1
    nodes = staged(nodes, "roots")
    # Stored, so that the join need not take the aggregate's partitioning: a large component can be split over tasks.
    names = staged(nodes.groupBy("at").agg(F.min("node").alias("component")), "names")
    return nodes.join(small(names, FEW_COMPONENTS), "at").select("node", "component")
