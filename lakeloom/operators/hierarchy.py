"""Parent-child links to full hierarchies by pointer doubling.

Every node starts with a pointer to its parent and the path segment it adds.
Each round joins the open nodes with the nodes they point at: a pointer to a
finished node finishes the node, any other pointer is followed, so the distance
that is covered doubles per round.  A round that finishes nothing while nodes
are open proves that the rest lead to circles; they are doubled on until the
distance covers all of them, and what their pointers then reach are the circles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.tables import Scratch

#: Rounds double the distance, so 64 cover any depth that a table can hold.
MAX_ROUNDS = 64


def blank(c) -> "F.Column":
    return F.length(F.regexp_replace(c, r"[\s ]", "")) == 0


def links(rows: DataFrame, scope: str = "repo_name", node: str = "fqn", parent: str = "parent_fqn") -> DataFrame:
    """One row (scope, node, parent) per node; parent null for roots.

    Rows with a null or blank node are no nodes.  A null, blank or missing
    parent makes a root.  Where deliveries of a node disagree, the smallest
    existing parent counts.
    """
    own = rows.select(F.col(scope).alias("scope"), F.col(node).alias("node"), F.col(parent).alias("parent"))
    own = own.where("scope is not null and node is not null").where(~blank(F.col("node")))
    own = own.withColumn("parent", F.when(~blank(F.col("parent")), F.col("parent"))).distinct()
    known = own.select("scope", F.col("node").alias("parent")).distinct().withColumn("there", F.lit(True))
    own = own.join(known, ["scope", "parent"], "left")
    return own.groupBy("scope", "node").agg(F.min(F.when(F.col("there"), F.col("parent"))).alias("parent"))


def resolve(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trees, circles) of ``links``.

    trees: scope, node, path (array from the root to the node), depth (0 for a
    root), root.  circles: scope, node of each node on a circle of parents.
    Nodes that only lead to a circle are in neither.  Empty input gives empty
    results.
    """
    s = Scratch(spark, "hierarchy")
    edges = s.save(edges, "edges")
    done = [edges.where("parent is null").select("scope", "node", F.array("node").alias("path"))]
    latest = done[0]
    todo = edges.where("parent is not null").select("scope", "node", F.col("parent").alias("ptr"), F.array("node").alias("tail"))
    n_open, reach, looping = todo.count(), 1, False
    previous = None
    for round_no in range(MAX_ROUNDS):
        if n_open == 0 or (looping and reach >= n_open):
            break
        # Open nodes whose pointer is finished take its path; the others jump on.
        ends = latest.select("scope", F.col("node").alias("ptr"), F.col("path").alias("head"))
        jumps = todo.select("scope", F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("tail").alias("mid"))
        # Tails of nodes on circles would only repeat; they are not carried on.
        head = ends.withColumns({"next": F.lit(None).cast("string"), "mid": F.lit(None).cast("array<string>")})
        both = head.unionByName(jumps.withColumn("head", F.lit(None).cast("array<string>")))
        step = todo.join(both, ["scope", "ptr"], "left")
        tail = F.col("tail") if looping else F.concat(F.coalesce("mid", F.array().cast("array<string>")), "tail")
        step = s.save(
            step.select(
                "scope", "node", F.when(F.col("head").isNotNull(), F.concat("head", "tail")).alias("path"),
                F.col("next").alias("ptr"), F.when(F.col("head").isNull(), tail).alias("tail"),
            ),
            "round",
        )
        finished = step.where("path is not null").select("scope", "node", "path")
        done.append(finished)
        # A pointer may reach any node that is finished so far.
        latest = done[0]
        for d in done[1:]:
            latest = latest.unionByName(d)
        todo = step.where("path is null").select("scope", "node", "ptr", "tail")
        counts = step.agg(F.count("path").alias("f"), F.count(F.when(F.col("path").isNull(), 1)).alias("o")).first()
        reach *= 2
        looping = looping or counts["f"] == 0
        n_open, previous = counts["o"], step  # noqa: F841
    circles = todo.select("scope", F.col("ptr").alias("node")).distinct()
    trees = latest.withColumns({"depth": F.size("path") - 1, "root": F.element_at("path", 1)})
    return trees, circles


def descendants(trees: DataFrame) -> DataFrame:
    """Closure rows (scope, ancestor, descendant, distance), each node its own at distance 0."""
    return trees.select("scope", F.posexplode("path").alias("at", "ancestor"), F.col("node").alias("descendant"), (F.size("path") - 1).alias("d")).select(
        "scope", "ancestor", "descendant", (F.col("d") - F.col("at")).alias("distance")
    )


def with_counts(trees: DataFrame) -> DataFrame:
    """trees and how many descendants each node has, itself excluded."""
    n = descendants(trees).where("distance > 0").groupBy("scope", F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
    return trees.join(n, ["scope", "node"], "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0).cast("long")))
