"""Connected components by alternating large-star and small-star rounds.

Each round is a few joins and map-side combined aggregates; no node's neighbours are ever gathered
in one row, so a node linked to a third of all others is as cheap as any. The edges of each round are
written to the shared folder, so a lost executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import release_shuffles, staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: a, b (long), in any order, repeats and self-links allowed. Returns node, root (the smallest
    node reachable) for every node that has a link to another one."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    e = staged(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    release_shuffles(edges.sparkSession)  # what the edges were found with
    was = _state(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    low = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return low.union(low.select(F.col("root").alias("node"), "root").distinct())
