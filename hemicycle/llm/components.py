"""Connected components of an edge table, distributed: repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; label is the smallest node of its component.

    Each round points every node at its smallest neighbour (a hash aggregate
    with map-side partials, so a hub costs no task more than others), follows
    the pointers once, and contracts the edges. The number of nodes at least
    halves, so rounds grow with its logarithm. Rounds are written as tables; no
    edge or label passes through the driver.
    """
    live = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p"))
                             .select(F.col("a").alias("node"), "p"))
        jump = stored(point.join(point.select(F.col("node").alias("p"), F.col("p").alias("q")), "p")
                            .select("node", F.col("q").alias("p")))
        labels = jump.select("node", F.col("p").alias("label")) if labels is None else stored(
            labels.join(jump.select(F.col("node").alias("label"), "p"), "label", "left")
            .select("node", F.coalesce("p", "label").alias("label")))
        live = stored(
            live.join(jump.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a")
            .join(jump.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
            .filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("label"))
