"""Reachability and connected components by repeated joins; each round is written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where it is unset and the master is local too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-checkpoints-", dir="/tmp"))
    return _own[0]


_own: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the shared folder, so that later rounds don't recompute it."""
    path = f"{shared_root(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def followed(nodes: DataFrame, owner: str = "book") -> DataFrame:
    """owner, at: all that is reached from each owner's least `at` by going to `next` again and again.

    nodes: owner, at, next (larger than at; none where the way ends). Jumps double in length from round to round, so a
    way of n steps takes log n rounds, each of them joins.
    """
    jumps = settled(nodes.select(owner, "at", "next"))
    known = settled(jumps.groupBy(owner).agg(F.min("at").alias("at")))
    while True:
        new = settled(known.join(jumps.filter("next IS NOT NULL"), [owner, "at"]).select(owner, F.col("next").alias("at")).join(jumps.select(owner, "at"), [owner, "at"], "left_semi"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        far = jumps.select(owner, F.col("at").alias("next"), F.col("next").alias("_far"))
        jumps = settled(jumps.filter("next IS NOT NULL").join(far, [owner, "next"], "left").select(owner, "at", F.col("_far").alias("next")).unionByName(jumps.filter("next IS NULL")))


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: the seeds and all that edges (source, target) lead to from them. As many rounds as the longest way has steps."""
    edges = settled(edges.select(F.col("source").alias("node"), F.col("target").alias("_next")).distinct())
    known = settled(seeds.select("node").distinct())
    front = known
    while not front.isEmpty():
        front = settled(front.join(edges, "node").select(F.col("_next").alias("node")).distinct().join(known, "node", "left_anti"))
        known = known.unionByName(front)
    return known


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it is connected with) for every node of edges (a, b).

    Every node takes the least label around it, and then the label of its label, until nothing changes; so a chain of
    n nodes takes some log n rounds.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settled(both)
    label = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")))
    while True:
        near = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        low = label.join(near, "a").select("a", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        far = low.select(F.col("a").alias("l"), F.col("l").alias("f"))
        new = settled(low.join(far, "l").select("a", F.least("l", "f").alias("l"), "was"))
        done = new.filter("l <> was").isEmpty()
        label = new.drop("was")
        if done:
            return label.select(F.col("a").alias("node"), F.col("l").alias("component"))


def resolved(links: DataFrame) -> DataFrame:
    """node, end: where links (node, target; one for each node, without a circle) lead to in the end.

    Each round doubles how far a node sees.
    """
    at = settled(links.select("node", F.col("target").alias("end")))
    while True:
        far = at.select(F.col("node").alias("end"), F.col("end").alias("_far"))
        new = settled(at.join(far, "end", "left").select("node", F.coalesce("_far", "end").alias("end"), F.col("_far").isNotNull().alias("_moved")))
        done = new.filter("_moved").isEmpty()
        at = new.drop("_moved")
        if done:
            return at
