"""Connected components by rounds of star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import checkpointed, heavy_keys, spread_join


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node ties its larger (or its smaller) neighbours to the least of its neighbourhood."""
    around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    heavy = heavy_keys(least, "u", "n")
    if large:
        moved = spread_join(around.where("v > u"), least.select("u", F.least("u", "m").alias("m")), "u", "v", heavy)
        return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    moved = spread_join(around, least.select("u", "m"), "u", "v", heavy).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), two columns of one ordered type: root is the least node of its component.

    Rounds of large and small stars until nothing changes, as many as the logarithm of the longest path. Every round is
    grouping, with sums before the shuffle, and joining by node, where the edges of a hub are dealt out further, so that
    neither a component nor a hub lands in one task. Each is checkpointed in the shared folder.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = [F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))]
    edges = checkpointed(edges)
    before = edges.agg(*mark).first()
    while before[0]:
        edges = checkpointed(_stars(_stars(edges, True), False))
        after = edges.agg(*mark).first()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def smallest_of_each(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component_id, best) for `nodes` (node, first), all of them different: the least `first` of the node's component and the least node that has it.

    A null `first` is larger than every other. Only nodes with a link are grouped and joined by component.
    """
    tied = checkpointed(nodes.join(components(edges), "node", "left"))
    many = tied.where("root is not null")
    rank = F.struct(F.col("first").isNull().alias("none"), "first", "node")
    least = many.groupBy("root").agg(F.min(rank).alias("least"), F.count("*").alias("n"))
    least = least.select("root", F.col("least.first").alias("component_id"), F.col("least.node").alias("best"), "n")
    of = spread_join(many.select("root", "node"), least.drop("n"), "root", "node", heavy_keys(least, "root", "n")).select("node", "component_id", "best")
    return of.union(tied.where("root is null").select("node", F.col("first").alias("component_id"), F.col("node").alias("best")))
