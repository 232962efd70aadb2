"""Connected components of an edge table, by rounds of joins whose results are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node that the edges (u, v) reach from node; nodes without an edge to
    another node don't appear.

    Alternates large-star and small-star steps, which keep the number of edges at most what it was, until the edges
    are stars around their roots. Minima are combined before each shuffle and written, so the joins that bring a node's
    minimum to its edges have plain exchanges on both sides, which adaptive execution splits where a node has very many."""
    e = edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u <> v").distinct()
    e = materialize(e, "edges")
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node moves to the smallest node around.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "low")
        large = both.join(low, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "low")
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        new = materialize(small, "edges")
        digest = [d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (e, new)]
        e = new
        if digest[0] == digest[1]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
