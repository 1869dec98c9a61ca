"""Spherical k-means of vectors and the naming of its clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.curation import cosine
from lakeloom.sources.tables import Scratch

MOST_CLUSTERS, MOST_ROUNDS = 10, 50


def cluster_count(n: int) -> int:
    """An eighth of the items, 2 at least and 10 at most; fewer than 4 items make no clusters."""
    return 0 if n < 4 else max(2, min(MOST_CLUSTERS, -(-n // 8)))


def centroids(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, centroid): the mean of a group's vectors, place by place."""
    e = rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return e.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p")).select(by, F.transform("p", lambda p: p["m"]).alias("centroid"))


def spherical_kmeans(spark: SparkSession, rows: DataFrame, key: str, vector: str, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(key, cluster): k-means by cosine.

    The first centroid is the row with the smallest key, each further one the row
    that is least similar to its nearest centroid (ties: the smallest key).  Equal
    similarities go to the last cluster.  At most ten centroids are on the driver;
    rows never are.
    """
    s = Scratch(spark, "kmeans")
    rows = s.save(rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).where("key is not null and v is not null"), "rows")
    k = cluster_count(rows.count())
    if k == 0:
        return rows.select(F.col("key").alias(key), F.lit(0).alias("cluster")).limit(0)
    seeds = [list(rows.orderBy("key").first()["v"])]

    def nearest(cs):
        """(key, v, best): the most similar centroid of every row, the last of equal ones."""
        c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(cs)], "i int, c array<double>")
        j = rows.join(F.broadcast(c), how="inner")  # ten centroids at most
        j = j.select("key", "v", F.struct(F.round(cosine(F.col("v"), F.col("c")), 9).alias("s"), "i").alias("b"))
        return j.groupBy("key").agg(F.first("v").alias("v"), F.max("b").alias("best"))

    while len(seeds) < k:
        seeds.append(list(nearest(seeds).orderBy("best.s", "key").first()["v"]))
    previous = None
    for _ in range(rounds):
        out = s.save(nearest(seeds).select("key", "v", F.col("best.i").alias("cluster")), "assigned")
        found = {r["cluster"]: list(r["centroid"]) for r in centroids(out, "cluster", "v").collect()}
        s.drop(previous)
        previous, moved = out, [found.get(i, [0.0] * len(seeds[i])) for i in range(k)]
        if all(abs(a - b) < 1e-12 for x, y in zip(moved, seeds) for a, b in zip(x, y)):
            break
        seeds = moved
    return out.select(F.col("key").alias(key), "cluster")
