"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baglight.functions.stage import drop_stage, stage


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges (a, b); nodes only need an order.

    Alternates two steps until nothing changes: every node ties its larger neighbours to the least
    node it knows (large star), then its smaller neighbours likewise (small star). Each halves the
    distance to the least node, so rounds grow with the logarithm of the longest path, and both are
    aggregations, never a list of a node's neighbours: a node with a third of all edges is a group
    of rows like any other. Self-loops and null ends are left out; an empty table gives no rows.
    """
    e = edges.select("a", "b").filter("a <> b")
    now = stage(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    while now.head(1):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stage(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "star")
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        new = stage(small, "star")
        same = new.count() == now.count() and not new.join(now, ["a", "b"], "left_anti").head(1)
        drop_stage(now)
        drop_stage(large)
        now = new
        if same:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
