"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import stored


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in ``edges(a, b)``.

    Each round takes the smallest label next to a node (aggregated before the shuffle, so a
    hub costs one row a task), then the label of that label.  Rounds grow with the
    logarithm of the longest chain; each is written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"))
    label = stored(label, "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = label.join(near, "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        up = step.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new = stored(step.join(up, "component").select("id", F.least("component", "top").alias("component"), (F.col("old") != F.least("component", "top")).alias("moved")), "labels")
        label = new.select("id", "component")
        if not new.where("moved").limit(1).count():
            return label
