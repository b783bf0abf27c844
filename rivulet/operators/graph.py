"""Connected components over edge frames, by contraction: every round hooks each node to its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, release, written


def _flat(parent: DataFrame) -> DataFrame:
    """(u, p) pointing at roots: pointers double until none moves. Parents are smaller than children, so there is no cycle."""
    while True:
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        step = written(parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("q"), F.when(F.col("pp").isNull(), 0).otherwise(1).alias("moved")))
        moved = step.agg(F.max("moved")).first()[0]
        drop(parent)
        parent = step.select("u", F.col("q").alias("p"))
        parent._rivulet_path = step._rivulet_path
        if not moved:
            return parent


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that an edge touches; root is one node of the component, not always its smallest.

    Rounds grow with the logarithm of the longest path; all state is in tables of the shared folder. Nulls and loops make no edge.
    """
    spark = edges.sparkSession
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") > F.col("v")).distinct())
    nodes = written(e.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    while e.limit(1).count():
        parent = _flat(written(e.groupBy("u").agg(F.min("v").alias("p"))))
        up = lambda c, n: parent.select(F.col("u").alias(c), F.col("p").alias(n))
        known = written(nodes.join(up("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        ends = e.join(up("u", "pu"), "u", "left").join(up("v", "pv"), "v", "left").select(F.coalesce("pu", "u").alias("x"), F.coalesce("pv", "v").alias("y"))
        rest = written(ends.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
        drop(e, nodes, parent)
        e, nodes = rest, known
    drop(e)
    release(spark)
    return nodes
