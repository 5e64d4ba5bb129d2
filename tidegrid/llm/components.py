"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import stored

MOST_ROUNDS = 60
#: Edges of a task, about: few edges are worked on by few tasks, whatever the number of shuffle partitions.
TASK_EDGES = 100_000


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) -> (node, root): the smallest node reachable, for every node that has an edge.

    Every round hangs each node's larger neighbours on its smallest neighbour, then does the same among its smaller
    ones; the number of rounds grows with the logarithm of the longest path. The minima are combined before their
    shuffle and written, so that a node with very many neighbours is a skewed key of a join of two plain shuffles, which
    Spark splits. Each round's edges are written too, which cuts the lineage. The number of edges never grows by more
    than their nodes, so it sets the number of tasks.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    written = lambda df, what: stored(df.coalesce(tasks), what)
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = written(_min_neighbour(both).select("u", F.least("u", "m").alias("m")), "minima")
        large = written(both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large-star")
        smallest = written(_min_neighbour(large), "minima")
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
