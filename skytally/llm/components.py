"""Connected components by repeated contraction.

Every node takes the smallest node among itself and its neighbours, then that
node's own choice (pointer jump); edges are rewritten to the chosen nodes and
repeated ones merged, until none is left. The minimum is a map-side aggregate,
so a node with very many neighbours costs no single task, and the number of
rounds grows with the logarithm of the longest chain. Nothing is collected:
each round writes its node table and its remaining edges to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.lineage import stash


def components(edges: DataFrame) -> DataFrame:
    """`node, component` for every node of `edges(a, b)`; component is the smallest node reachable.

    Loops, repeated edges and either direction are allowed; rows with a NULL
    end link nothing. An empty table gives no rows.
    """
    left = stash(
        edges.filter("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
        .distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                                             F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        low = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
        low = stash(low, "low")
        up = low.select(F.col("node").alias("low"), F.col("low").alias("up"))
        step = stash(low.join(up, "low", "left").select("node", F.coalesce("up", "low").alias("root")), "roots")
        left = stash(
            left.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = step.select("node", F.col("root").alias("component"))
        else:
            labels = (labels.join(step.withColumnRenamed("node", "component"), "component", "left")
                      .select("node", F.coalesce("root", "component").alias("component")))
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stash(labels, "components")
