"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.llm.runtime import checkpointed, gathered


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", "root")).alias("x")).first()
    return row["n"], row["x"]


def _round(edges: DataFrame) -> DataFrame:
    # Large star: every greater neighbour of a node is tied to the node's least neighbour (or itself).
    both = edges.select(F.col("node").alias("u"), F.col("root").alias("v")).union(edges.select("root", "node"))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("node"), F.least("low", "u").alias("root")).distinct()
    # Small star: a node and its lesser neighbours are tied to the least of these.
    low = large.groupBy("node").agg(F.min("root").alias("low"))
    moved = large.join(low, "node").where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
    return moved.union(low.select("node", F.col("low").alias("root"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """(node, root) for every node that has a link, except roots: `root` is the least node of its component.

    `most` bounds the number of links, generously, where the caller knows it. Nodes are longs. Links to itself and repeated links do not matter; a link with a null end is none.
    A round joins each link with one row per node, so no node's neighbours are gathered in one place,
    and only one pair of numbers per round reaches the driver.
    """
    edges = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct()
    edges = checkpointed(edges if most is None else gathered(edges, most))
    seen = _digest(edges)
    while seen[0]:
        # Each link becomes one, and each node has one more.
        edges = checkpointed(gathered(_round(edges), 2 * seen[0]))
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    return edges
