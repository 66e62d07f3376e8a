"""Connected components of a link table, on the cluster: every round hooks each node on its least
neighbour, shortens the pointer chains to their roots and contracts the links to the roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``edges``: (a, b) longs, any order, repeats and loops allowed. Returns (node, comp), comp the least
    node reachable, for every node that has a link to another. An empty table gives an empty result.

    Nothing is gathered on the driver but counts. All aggregations are minima, which combine before the
    shuffle, so a node with very many links costs a row for each map task. Joins on a node with very many links
    or pointers to it are left to adaptive execution, which splits a task's rows of 16 bytes by map task when
    they exceed ``spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes``."""
    edges = ws.written(edges.where("a <> b").select("a", "b"), "edges")
    done: DataFrame | None = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ws.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up")), "up")
        if up.isEmpty():
            break
        while True:
            top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            nxt = ws.written(up.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            moved = not nxt.where("moved").isEmpty()
            ws.drop(up)
            up = nxt
            if not moved:
                break
        up = up.select("node", "up")
        a, b = up.toDF("a", "ra"), up.toDF("b", "rb")
        rest = ws.written(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if done is None:
            done = up.toDF("node", "comp")
        else:
            done = ws.written(done.join(up.toDF("comp", "top"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "labels")
        ws.drop(edges)
        edges = rest
        if rest.isEmpty():
            break
    return done if done is not None else up.toDF("node", "comp")
