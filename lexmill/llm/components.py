"""Connected components by alternating star contraction, all in DataFrame joins.

Each round rewrites the edge table and writes it to the shared folder, so the
lineage stays short and nothing about the graph reaches the driver but three
numbers a round.  Hubs are safe: minima are partially aggregated and the joins
back to the edges may be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of long ids, in any order and with repeats, to ``(node, root)``.

    ``root`` is the smallest id reachable.  Ids without an edge are absent;
    edges with a null end or from a node to itself are ignored.
    """
    edges = scratch.table(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        # every neighbour above a node is hung on the least of the node's neighbourhood
        sides = _both_ways(edges)
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # every neighbour below a node, and the node, is hung on the least of them
        low = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low_least = low.groupBy("u").agg(F.min("v").alias("m"))
        hung = low.join(low_least, "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b")
        after_df = scratch.table(hung.where("a <> b").distinct())
        row = after_df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges, after = after_df, (row[0], row[1])
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("root")), F.struct(F.col("a").alias("node"), F.col("a").alias("root")))).alias("e")).select("e.node", "e.root").distinct()
