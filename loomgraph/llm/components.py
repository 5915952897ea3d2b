"""Connected components of an edge table, by large-star and small-star steps.

Every round writes its edges to the shared folder, so a lost executor costs no more than the
round it was lost in. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans import scratch

#: Rounds after which something must be wrong; 2 ** 60 nodes need fewer.
MOST_ROUNDS = 120


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join the neighbours of each node to the least of them; ``large``: only those above the node."""
    if large:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(least.select("a", F.col("low").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), the root being the least node of its component.

    Nodes may be of any ordered type. Self-loops and repeated edges change nothing; null ends
    are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    edges = scratch.materialize(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"), "pairs")
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    now, path, before = edges.where("a != b"), None, None
    for _ in range(MOST_ROUNDS):
        old, path = path, scratch.scratch_path(spark, "star")
        step = _star(_star(now, True), False)
        step.write.parquet(path)
        now = spark.read.schema(step.schema).parquet(path)
        if old:  # a round that has been read is not needed again
            scratch.remove(spark, old)
        # The edges are the same once their number and the sum of their hashes are.
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    rooted = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    every = rooted.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
    lone = loops.distinct().join(every, "node", "left_anti").select("node", F.col("node").alias("root"))
    return every.unionAll(lone)
