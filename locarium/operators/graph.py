"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locarium.storage import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of an edge list ``(u, v)``; component is the smallest node reachable.

    Every round hooks each node onto its smallest neighbour, follows the hooks
    to their roots by pointer doubling, and contracts the edges to those roots,
    so that the graph shrinks geometrically. All steps are joins and
    aggregates with partial combination; the driver sees only whether a table
    is empty. Null ends and self-loops are ignored; an edge may repeat.
    """
    # Both directions of one evaluation: edges that depend on the order of rows differ from one evaluation to the next.
    both = F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    e = stored(edges.where("u <> v").select(both).distinct())
    whole = None
    while not e.isEmpty():
        p = stored(e.groupBy("u").agg(F.least("u", F.min("v")).alias("root")).withColumnRenamed("u", "node"))
        while True:
            up = p.select(F.col("node").alias("root"), F.col("root").alias("up"))
            q = stored(p.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            p = q.select("node", "root")
            if q.where("moved").isEmpty():
                break
        if whole is None:
            whole = p
        else:
            onto = p.select(F.col("node").alias("root"), F.col("root").alias("to"))
            whole = stored(whole.join(onto, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        a, b = (p.select(F.col("node").alias(x), F.col("root").alias(f"{x}2")) for x in "uv")
        e = stored(e.join(a, "u").join(b, "v").where("u2 <> v2").select(F.col("u2").alias("u"), F.col("v2").alias("v")).distinct())
    if whole is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return whole.withColumnRenamed("root", "component")
