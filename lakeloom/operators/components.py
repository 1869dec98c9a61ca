"""Connected components of an undirected edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.tables import Scratch


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, component) of every node of an edge; a component is named by its smallest node.

    Every round takes the smallest label of the neighbours and then the label of
    that label, so labels travel distances that double.  Labels are reduced per
    node on the map side, so a hub costs its edges, not its square.  Self-loops
    make a node of its own component; edges with a null end are left out.  Stops
    when a round changes nothing; raises if that takes over ``max_rounds``.
    """
    s = Scratch(spark, "components")
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    e = s.save(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = s.save(e.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = e.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        step = s.save(step, "labels")
        changed = step.where("label <> old").limit(1).count()
        s.drop(labels)
        labels = step.select("node", "label")
        labels._lakeloom_path = step._lakeloom_path
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
