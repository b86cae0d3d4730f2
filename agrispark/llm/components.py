"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrispark.llm.staging import staged


def _least_neighbour(edges: DataFrame, name: str) -> DataFrame:
    """Every edge (u, v) with the least v of its u; a hub's edges are combined before they are shuffled."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias(name)), "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    A large star ties a node's greater neighbours to its least neighbour, a small star ties its smaller ones and itself;
    in turns they leave stars around the smallest nodes, after a number of rounds that grows with the logarithm of the
    number of nodes. Each round is written to the shared folder, so lineage stays short and lost executors cost one round.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = staged(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", "m")
        large = _least_neighbour(both, "m").filter("v > u").select(F.col("v").alias("u"), least.alias("v")).filter("u != v").distinct()
        near = _least_neighbour(large, "m")
        small = near.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.u", "e.v").filter("u != v").distinct(), "stars")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
