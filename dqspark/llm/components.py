"""Connected components of an undirected graph by alternating large and small stars.

Nodes are longs. Each round joins every node's edges with the least neighbour, found by a
combinable minimum; no node's edges are ever gathered in one row, and the joins can be
split where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with v < u. One large or small star step, giving the same form."""
    if large:  # every neighbour above u is tied to the least of u and its neighbours
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        found = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its smaller neighbours are tied to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        found = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return found.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node at most, and on none that hangs itself: then all components are stars."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v): component is the least node reachable.

    Ties and repeated edges do no harm; self loops are left out, an empty table gives an empty one.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    while not _settled(now):
        now = cut(_star(_star(now, large=True), large=False))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
