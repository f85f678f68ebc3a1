"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the component's smallest node.

    Each round takes the smallest label of a node's neighbours and then the label of its label, so chains
    halve; labels and edges stay distributed, each round is a reliable checkpoint. Duplicate edges and loops
    are allowed; no edges give no rows.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).where("x <> y").distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
        after = checkpointed(step.join(jump, "to").select("node", F.least("to", "beyond").alias("root"), (F.least("to", "beyond") < F.col("root")).alias("moved")))
        moved = after.where("moved").limit(1).count()
        labels = after.select("node", "root")
        if not moved:
            return labels
