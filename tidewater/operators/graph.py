"""Ancestors and descendants in edge tables, by rounds of joins that double the depth."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import written


def ancestors(edges: DataFrame, most_depth: int | None = None, stop_at: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, depth) of an edge table (child, parent); the least depth of each pair.

    Each round doubles the depth that is known: a path of more than n and at most 2n links is one of n links and the rest, both
    of them known, so rounds are the logarithm of the depth. With stop_at (a node column) search ends there.
    The closure is whole unless most_depth is given, which then is the greatest depth asked for.
    Rounds are written tables, since their lineage would double from round to round. Cycles end by the pairs already found.
    """
    ends = None if stop_at is None else stop_at.select(F.col("node").alias("ancestor"))
    found = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth")).distinct()
    if most_depth == 1:
        return found
    found = written(found)
    for n in (1 << i for i in count()):
        if most_depth is not None and n >= most_depth:
            break
        base = found.where(F.col("depth") == n)
        base = (base if ends is None else base.join(ends, "ancestor", "left_anti")).select("node", F.col("ancestor").alias("middle"))
        rest = found.select(F.col("node").alias("middle"), "ancestor", (F.col("depth") + n).alias("depth"))
        if most_depth is not None:
            rest = rest.where(F.col("depth") <= most_depth)
        step = base.join(rest, "middle").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        fresh = written(step.join(found, ["node", "ancestor"], "left_anti").select("node", "ancestor", "depth"))
        if not fresh.limit(1).count():
            break
        found = found.unionByName(fresh)
    return found


def descendants(edges: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(node, descendant, depth)."""
    turned = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return ancestors(turned, most_depth).withColumnRenamed("ancestor", "descendant")


def synonyms(terms: DataFrame, least_length: int = 4) -> DataFrame:
    """(name, term) of names and synonyms with their plurals; short names go, the first term in order keeps a name."""
    plain = terms.select("term", F.explode(F.array_distinct(F.concat(F.array("name"), "synonyms"))).alias("name"))
    both = plain.select("term", F.explode(F.array("name", F.concat("name", F.lit("s")))).alias("name"))
    return both.where(F.length("name") >= least_length).groupBy("name").agg(F.min("term").alias("term"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) of an undirected edge table (a, b): the smallest node reachable stands for a component; nodes adds lone ones.

    Rounds of joins over written tables: each node takes the least label among its neighbours' labels, then the label of its label,
    so chains shorten by jumps. Labels only fall, and the end is a round that changes nothing; one number a round reaches the driver.
    """
    both = edges.where("a is not null and b is not null and a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    both = written(both)
    every = both.select(F.col("a").alias("node"))
    for more in [nodes.select("node")] if nodes is not None else []:
        every = every.unionByName(more.where("node is not null"))
    labels = written(every.distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        met = written(met)
        # The label of the label, which is itself a node; it can only be smaller.
        jump = met.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = written(met.join(jump, "component").select("node", "old", F.least("component", "further").alias("component")))
        labels = after.select("node", "component")
        if not after.where("component <> old").limit(1).count():
            return labels
