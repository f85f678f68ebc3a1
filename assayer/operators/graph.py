"""Graph operators over distributed edge lists (src, dst): degrees, closure, components, cycles, reachability.

Iterations are driver loops over DataFrames; each round joins only what is new, and its result is a reliable checkpoint.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.common import checkpointed


def clean(edges: DataFrame) -> DataFrame:
    """Edges once each, without loops and nulls."""
    return edges.select("src", "dst").dropna().where("src <> dst").distinct()


def instability(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, ca, ce, instability) with I = Ce / (Ca + Ce); a node without edges counts as 1."""
    e = clean(edges)
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    deg = ends.groupBy("node").agg(F.sum("i").alias("ca"), F.sum("o").alias("ce"))
    return deg.withColumn("instability", F.when(F.col("ca") + F.col("ce") == 0, F.lit(1.0)).otherwise(F.col("ce") / (F.col("ca") + F.col("ce"))))


def unstable_dependencies(edges: DataFrame, metrics: DataFrame, gap: float = 0.3, abstract: float = 0.5) -> DataFrame:
    """Edges onto a node that is less stable by more than `gap` and not abstract, from a node that others depend on.

    metrics: node, ca, instability, abstractness.
    """
    a = metrics.select(F.col("node").alias("src"), F.col("ca").alias("src_ca"), F.col("instability").alias("src_i"))
    b = metrics.select(F.col("node").alias("dst"), F.col("instability").alias("dst_i"), F.col("abstractness").alias("dst_a"))
    return clean(edges).join(a, "src").join(b, "dst").where((F.col("dst_i") > F.col("src_i") + gap) & (F.col("dst_a") < abstract) & (F.col("src_ca") >= 1))


def main_sequence(metrics: DataFrame) -> DataFrame:
    """Adds the distance from the main sequence, |A + I - 1|."""
    return metrics.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of every pair joined by a path; doubling, so rounds grow with the logarithm of the longest path.

    The result itself grows with the pairs that it names; for reachability from given nodes use `reachable`.
    """
    known = checkpointed(edges.select("src", "dst").dropna().distinct())
    size = known.count()
    while True:
        longer = known.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        known = checkpointed(known.unionByName(longer).distinct())
        now = known.count()
        if now == size:
            return known
        size = now


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, hops) of every node reached from the start nodes, breadth first; only the frontier is joined."""
    e = edges.select("src", "dst").dropna().distinct()
    seen = checkpointed(start.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for hop in count(1):
        step = frontier.join(e, frontier.node == e.src).select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if not frontier.limit(1).count():
            return seen
        seen = checkpointed(seen.unionByName(frontier))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph; the component is its smallest node. Smallest neighbour, then the label's label."""
    e = edges.select("src", "dst").dropna()
    both = checkpointed(e.union(e.select("dst", "src")).toDF("x", "y").distinct())
    labels = checkpointed(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        after = checkpointed(step.join(jump, "to").select("node", "component", F.least("to", "beyond").alias("now")))
        moved = after.where("now < component").limit(1).count()
        labels = after.select("node", F.col("now").alias("component"))
        if not moved:
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of the cycles: sets of nodes that all reach each other, larger than one; the component is its smallest node.

    Nodes without an edge in or out are trimmed until none is left; each node then takes the smallest node that reaches it (its colour), and what reaches
    that node backwards within its colour is its component. Those leave, and the rest goes on. Work grows with edges and rounds, never with pairs of nodes.
    """
    e = checkpointed(clean(edges))
    found = None
    while True:
        while True:  # trim
            size = e.count()
            e = checkpointed(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if e.count() == size:
                break
        if not size:
            break
        colours = checkpointed(e.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            near = e.join(colours.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("m"))
            after = checkpointed(colours.join(near, "node", "left").select("node", F.least("colour", "m").alias("colour"), (F.col("m") < F.col("colour")).alias("moved")))
            moved = after.where("moved").limit(1).count()
            colours = after.select("node", "colour")
            if not moved:
                break
        a, b = colours.toDF("src", "a"), colours.toDF("dst", "b")
        within = checkpointed(e.join(a, "src").join(b, "dst").where("a = b").select("src", "dst", F.col("a").alias("colour")))
        own = frontier = checkpointed(colours.where("node = colour"))
        while True:
            step = within.join(frontier.withColumnRenamed("node", "dst"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = checkpointed(step.join(own, ["node", "colour"], "left_anti"))
            if not frontier.limit(1).count():
                break
            own = checkpointed(own.unionByName(frontier))
        found = own if found is None else checkpointed(found.unionByName(own))
        gone = own.select("node")
        e = checkpointed(e.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        kind = edges.schema["src"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}, size bigint")
    sizes = found.groupBy("colour").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return found.join(sizes, "colour").select("node", F.col("colour").alias("component"), "size")


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs a < b with edges both ways."""
    e = clean(edges)
    return e.alias("x").join(e.alias("y"), (F.col("x.src") == F.col("y.dst")) & (F.col("x.dst") == F.col("y.src")) & (F.col("x.src") < F.col("x.dst"))).select(F.col("x.src").alias("a"), F.col("x.dst").alias("b"))
