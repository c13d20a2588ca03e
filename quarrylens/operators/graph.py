"""Walks over edge tables.

Each hop is one equi-join of the frontier with the edges and one anti-join with what was seen.  From the second hop on
a frontier is checkpointed, since every later one would hold its plan twice; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import cut


def walk(seeds: DataFrame, edges: DataFrame, depth: int, inbound: bool = True) -> DataFrame:
    """(node, hop, via): first hop at which a node is reached and the least seed that reaches it then.

    ``seeds``: one column of nodes; ``edges``: (src, dst).  Inbound follows edges from dst to src (who calls
    it), outbound the other way (what it calls).  Seeds themselves are not returned.
    """
    (key,) = seeds.columns
    at, to = ("dst", "src") if inbound else ("src", "dst")
    links = edges.select(F.col(at).alias("__at"), F.col(to).alias("__to")).where("__at IS NOT NULL AND __to IS NOT NULL").distinct()
    frontier = seeds.select(F.col(key).alias("node"), F.col(key).alias("via")).distinct()
    seen = frontier.select("node")
    hops = []
    for hop in range(1, depth + 1):
        reached = frontier.join(links, F.col("node") == F.col("__at")).groupBy("__to").agg(F.min("via").alias("via"))
        frontier = reached.join(seen, F.col("__to") == F.col("node"), "left_anti").select(F.col("__to").alias("node"), "via")
        if 1 < hop < depth:
            frontier = cut(frontier)
        seen = seen.unionByName(frontier.select("node"))
        hops.append(frontier.withColumn("hop", F.lit(hop).cast("long")))
    return reduce(DataFrame.unionByName, hops).select("node", "hop", "via")


#: Risk by hop (fixed values).
RISKS = {1: "CRITICAL", 2: "HIGH", 3: "MEDIUM"}


def risk_of(hop):
    return F.when(hop == 1, RISKS[1]).when(hop == 2, RISKS[2]).when(hop == 3, RISKS[3]).otherwise("LOW")


def risk_summary(reached: DataFrame) -> DataFrame:
    """(risk, n) over the whole radius."""
    return reached.groupBy(risk_of(F.col("hop")).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


def impact(n_callers):
    """Overall risk of changing something with so many callers."""
    return F.when(n_callers > 10, "high").when(n_callers > 0, "medium").otherwise("unknown")


def degrees(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes with in- and out-degree, 0 where there is no edge."""
    incoming = edges.groupBy(F.col("dst").alias("__d")).agg(F.count(F.lit(1)).alias("in_degree"))
    outgoing = edges.groupBy(F.col("src").alias("__s")).agg(F.count(F.lit(1)).alias("out_degree"))
    return (
        nodes.join(incoming, F.col(key) == F.col("__d"), "left").join(outgoing, F.col(key) == F.col("__s"), "left").drop("__d", "__s")
        .withColumn("in_degree", F.coalesce("in_degree", F.lit(0))).withColumn("out_degree", F.coalesce("out_degree", F.lit(0)))
    )


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    """The n heaviest nodes of a bipartite movement graph, ties by name."""
    sides = edges.select(F.col("src").alias("node"), F.lit("source").alias("side")).unionByName(edges.select(F.col("dst").alias("node"), F.lit("target").alias("side")))
    return sides.groupBy("node", "side").agg(F.count(F.lit(1)).alias("weight")).orderBy(F.desc("weight"), "side", "node").limit(n)
