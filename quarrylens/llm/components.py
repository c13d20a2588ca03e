"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation (combined before the shuffle) and an equi-join that is dealt anew, so that
adaptive execution splits the edges of a hub; no neighbour list is ever gathered.  Each round is written to the shared
folder, so the lineage stays short and a lost executor costs at most one round; the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch_path, split_join

MAX_ROUNDS = 40


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b.  Large star: every larger neighbour is tied to the least neighbour; small star: every smaller one and the node itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # a's larger neighbours are those that name it as their smaller one
        out = split_join(edges.select(F.col("b").alias("a"), F.col("a").alias("v")), least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = split_join(edges, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.  ``edges``: two columns of one orderable type."""
    x, y = edges.columns
    now = (
        edges.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y)))
        .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        .distinct()
    )
    spark, path = edges.sparkSession, None

    def stage(df: DataFrame) -> DataFrame:
        nonlocal path
        last, path = path, scratch_path(spark, label)
        df.write.parquet(path)
        if last:
            remove(spark, last)
        return spark.read.schema(df.schema).parquet(path)

    now = stage(now)
    state = None
    for _ in range(MAX_ROUNDS):
        now = stage(_star(_star(now, large=True), large=False))
        # order-free fingerprint of the round's edges
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first()
        if found[0] == found[2] and tuple(found) == state or not found[0]:
            break
        state = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
