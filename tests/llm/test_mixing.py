import numpy as np
from pyspark.sql import functions as F

from lakeloom.llm import mixing
from lakeloom.sources.tables import Scratch


def test_given_ends_near_the_expected_tokens():
    r = np.random.default_rng(3)
    n = np.sort(r.integers(1, 3000, 60))[::-1].astype(float)
    for w in (0.07, 0.4, 1.3, 2.0):
        weight = np.full(len(n), w)
        copies = mixing._given(n, weight, np.full(len(n), 3.0))
        assert abs((copies * n).sum() - (weight * n).sum()) <= n.mean() / 4 and copies.max() <= 3


def test_raking_in_spark_equals_raking_on_the_driver(spark):
    cells = [(f"s{i % 3}", f"l{i % 20}", f"t{i % 37}", 10.0 + i * 7 % 91) for i in range(740)]
    targets, caps = np.array([9000.0, 14000.0, 8000.0]), np.array([3.0, 3.0, 2.0])
    ids = [{v: i for i, v in enumerate(sorted({c[k] for c in cells}))} for k in range(3)]
    want, change = mixing.rake([(*(ids[k][c[k]] for k in range(3)), c[3]) for c in cells], targets, caps)
    assert change < 1e-3
    plan = spark.createDataFrame([(f"s{i}", int(caps[i]), float(targets[i])) for i in range(3)], "source string, cap int, target double")
    df = spark.createDataFrame(cells, "source string, lang string, topic string, n double")
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in mixing.rake_table(df, plan, Scratch(spark, "test"), rounds=6).collect()}
    assert all(abs(got[c[:3]] - w) < 0.02 for c, w in zip(cells, want)) and len(got) == len(cells)


def test_every_language_and_topic_is_a_margin(spark):
    rows = [(i, f"text number {i} " * (3 + i % 5), "a" if i % 3 else "b", f"l{i % 25}", f"x-t{i % 40}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, repo_name string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    m = mixing.mixed(spark, docs, targets).margins.collect()
    assert {r["margin"]: sum(1 for x in m if x["margin"] == r["margin"]) for r in m} == {"source": 2, "lang": 25, "topic": 40}
    assert all(abs(r["asked_share"] - r["raked_share"]) < 1e-6 for r in m) and m[0]["last_change"] < 1e-6
    assert all(abs(r["reached_share"] - r["asked_share"]) < 0.001 for r in m if r["margin"] == "source")


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, repo_name string")
    targets = spark.createDataFrame([("a", 0.5, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mixed(spark, docs, targets)
    assert m.drawn.count() == 0 and m.margins.where("margin <> 'source'").count() == 0


def test_where_cells_are_raked_changes_no_copy(spark):
    """on tables, 24 rounds without a look at the last change gave other weights; a language of a source without share ended the job."""
    r = np.random.default_rng(4)
    data = [(i, "abc"[i % 3], f"l{r.integers(5)}", f"t{r.integers(6)}", int(r.integers(1, 900))) for i in range(600)] + [(600 + i, "d", "only", "t0", 50) for i in range(9)]
    rows = spark.createDataFrame(data, "doc_id long, source string, lang string, topic string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.55, 1), ("b", 0.25, 2), ("c", 0.2, 3), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    found = []
    for most in (mixing.MOST_CELLS, 0):
        weighted, plan, change = mixing.weights(spark, rows, targets, most)
        caps = spark.createDataFrame([(p[0], p[2]) for p in plan], "source string, cap int")
        found.append(([tuple(x) for x in weighted.select("doc_id", "weight").orderBy("doc_id").collect()], [tuple(x) for x in mixing.draw(weighted, caps).orderBy("doc_id").collect()]))
        assert change < mixing.CLOSE
    assert found[0] == found[1] and len(found[0][0]) == len(data)
