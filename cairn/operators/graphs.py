"""Chains of edges with circles: strongly connected components and longest chains, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import stored

STEPS = 2


def _step(marks: DataFrame, edges: DataFrame) -> DataFrame:
    came = edges.join(marks, edges.source == marks.node).groupBy(F.col("target").alias("node")).agg(F.min("mark").alias("came"))
    brought = marks.select(F.col("node").alias("at"), F.col("mark").alias("brought"))
    both = marks.join(came, "node", "left").join(brought, F.col("mark.node") == F.col("at"), "left")
    return both.select("node", F.least("mark", F.coalesce("came", "mark"), F.coalesce("brought", "mark")).alias("mark"))


def _least_reaching(marks: DataFrame, edges: DataFrame) -> DataFrame:
    """marks: node, mark (rank, node). Each node's least mark among those of the nodes that reach it. A mark that has come to a
    node also brings what has come to the mark's own node, so long chains take few rounds; STEPS of them are one job."""
    while True:
        new = marks
        for _ in range(STEPS):
            new = _step(new, edges)
        was = marks.select("node", F.col("mark").alias("was"))
        new = stored(new.join(was, "node").select("node", "mark", (F.col("mark") != F.col("was")).alias("moved")))
        marks = new.select("node", "mark")
        if new.where("moved").isEmpty():
            return marks


def components(edges: DataFrame) -> DataFrame:
    """edges: source, target. node and component (its least node) of the strongly connected components.

    Each round takes nodes without a way in or out away (trimming), colours every other node with the least mark that reaches it, and
    a colour's nodes that reach the mark's node backwards are a component; what is left of the colours goes on. Marks rank the nodes by a hash
    that differs from round to round, so that no order of ids makes the rounds many."""
    edges = edges.where("source is not null and target is not null").select("source", "target").distinct()
    nodes = stored(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct())
    left, found, round_ = stored(edges.where("source <> target")), None, 0
    while True:
        for _ in range(2):
            within = left.select(F.col("source").alias("node")).intersect(left.select(F.col("target").alias("node")))
            left = left.join(within.withColumnRenamed("node", "source"), "source", "left_semi").join(within.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target")
        left = stored(left)
        if left.isEmpty():
            break
        mark = F.struct(F.xxhash64("node", F.lit(round_)).alias("rank"), "node").alias("mark")
        start = left.select(F.explode(F.array("source", "target")).alias("node")).distinct().select("node", mark)
        forward = _least_reaching(start, left)
        colour = forward.select("node", F.col("mark").alias("colour"))
        ends = [colour.toDF(side, f"{side}_colour") for side in ("source", "target")]
        inside = stored(left.join(ends[0], "source").join(ends[1], "target").where("source_colour = target_colour").select("source", "target"))
        backward = _least_reaching(start, inside.toDF("target", "source").select("source", "target"))
        whole = stored(colour.join(backward, "node").where("colour = mark").select("node", F.col("colour.node").alias("root")))
        found = whole if found is None else found.union(whole)
        gone = whole.select("node")
        left = inside.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target")
        round_ += 1
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    names = found.groupBy("root").agg(F.min("node").alias("component"))
    return nodes.join(found.join(names, "root").select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def longest_paths(edges: DataFrame) -> DataFrame:
    """source, target, edges (the most on a way from one to the other) for all pairs of a graph without circles. Every round puts two ways
    together, so a chain of n edges takes log2 n rounds; the rows are the pairs that are connected."""
    paths, was = stored(edges.select("source", "target").distinct().withColumn("edges", F.lit(1))), None
    while True:
        now = tuple(paths.agg(F.count("*"), F.sum("edges")).first())
        if now == was:
            return paths
        was = now
        second = paths.select(F.col("source").alias("target"), F.col("target").alias("end"), F.col("edges").alias("more"))
        longer = paths.join(second, "target").select("source", F.col("end").alias("target"), (F.col("edges") + F.col("more")).alias("edges"))
        paths = stored(paths.union(longer).groupBy("source", "target").agg(F.max("edges").alias("edges")))


def depths(edges: DataFrame) -> DataFrame:
    """node, component, members (of its component) and depth: the most edges on a chain from its component on, where a circle counts as one
    node; 0 where no chain leaves it. Null ends are left out."""
    of = stored(components(edges))
    ends = [of.select(F.col("node").alias(side), F.col("component").alias(f"{side}_of")) for side in ("source", "target")]
    between = edges.select("source", "target").distinct().join(ends[0], "source").join(ends[1], "target").where("source_of <> target_of")
    longest = longest_paths(between.select(F.col("source_of").alias("source"), F.col("target_of").alias("target"))).groupBy(F.col("source").alias("component")).agg(F.max("edges").alias("depth"))
    sizes = of.groupBy("component").agg(F.count("*").alias("members"))
    return of.join(sizes, "component").join(longest, "component", "left").select("node", "component", "members", F.coalesce("depth", F.lit(0)).alias("depth"))
