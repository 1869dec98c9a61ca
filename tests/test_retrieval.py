"""Vector search against the column expression of the cosine."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import retrieval
from lakeloom.operators.curation import cosine


def _plain(rows, queries, k):
    j = rows.where("v is not null").select("key", F.col("v").alias("_v")).crossJoin(queries)
    j = j.select("query", "key", F.round(cosine(F.col("v"), F.col("_v")), 6).alias("score"))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key")) - 1).where(F.col("rank") < k)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_equals_the_column_expression_without_joining_all_pairs(spark, kind):
    """F2, F3, F6 to F9: all pairs were rows of a nested-loop join."""
    r = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in r.standard_normal((2500, 6)).round(2)]
    vectors += [vectors[3]] * 40 + [[0.0] * 6] * 30 + [[1.0, 2.0]] * 30 + [[None] + [1.0] * 5, [], None]
    odd = [[float("nan")] * 6, [float("inf")] + [0.0] * 5, [1e-30] * 6]
    rows = spark.createDataFrame([(f"k{i * 7919 % 99991:05}", v) for i, v in enumerate(vectors)], f"key string, v array<{kind}>")
    asked = [(i, v) for i, v in enumerate([vectors[0], vectors[3], [-x for x in vectors[3]], [0.0] * 6, [3.0, 1.0], [], None, [None] + [1.0] * 5, *odd])]
    queries = spark.createDataFrame(asked, f"query int, v array<{kind}>")
    for table in (rows, rows.unionByName(spark.createDataFrame([(f"o{i}", v) for i, v in enumerate(odd)], rows.schema))):
        got = retrieval.nearest(table, queries, "key", "v", 10)
        show = lambda df: sorted((x["query"], x["rank"], x["key"], str(x["score"])) for x in df.collect())
        assert show(got) == show(_plain(table, queries, 10))
    assert "NestedLoopJoin" not in got._jdf.queryExecution().toString()


def test_nearest_without_rows_or_queries(spark):
    rows, queries = spark.createDataFrame([("a", [1.0])], "key string, v array<float>"), spark.createDataFrame([(1, [1.0])], "query int, v array<float>")
    assert retrieval.nearest(rows.limit(0), queries, "key", "v", 3).count() == 0
    assert retrieval.nearest(rows, queries.where("false"), "key", "v", 3).count() == 0
    assert [tuple(x) for x in retrieval.nearest(rows, queries, "key", "v", 3).collect()] == [(1, "a", 1.0, 0)]
