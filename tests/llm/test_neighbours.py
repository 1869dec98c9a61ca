import numpy as np
from pyspark.sql import functions as F

from lakeloom.llm import neighbours as N


def _data(n=400, d=24, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[50:80] = x[:30] + 0.05 * rng.standard_normal((30, d))  # near copies
    x[100:112] = x[99] * np.arange(1, 13)[:, None]  # scaled copies
    x[200:215] = x[199]  # exact copies
    return [f"k{i:04d}" for i in range(n)], x.astype(np.float32)


def _frame(spark, ids, x):
    rows = [(i, [float(v) for v in r], "e") for i, r in zip(ids, x)]
    rows += [("null", None, "e"), ("zero", [0.0] * x.shape[1], "e"), ("wide", [1.0] * 9, "e"), (None, [1.0] * x.shape[1], "e"), ("nan", [float("nan")] * x.shape[1], "e"), rows[0]]
    return spark.createDataFrame(rows, "id string, vec array<float>, cosine string")


def test_mutual_pairs_equal_brute_force(spark, monkeypatch):
    ids, x = _data()
    want = N.brute_force(ids, x.astype(np.float64), 5, 0.95)
    pairs = {(a, b) for a, bs in want.items() for b in bs if a < b and a in want[b]}
    for block in (4096, 7):
        monkeypatch.setattr(N, "BLOCK", block), monkeypatch.setattr(N, "QUERY_BLOCK", block)
        got = N.mutual(N.neighbours(spark, {"f": (_frame(spark, ids, x), "id", "vec")}, N.Search(least=0.95, probes=6)))
        assert {(r["id_a"], r["id_b"]) for r in got.collect()} == pairs


def test_recall_without_threshold(spark):
    ids, x = _data(600)
    want = N.brute_force(ids, x.astype(np.float64), 5)
    got = N.neighbours(spark, {"f": (_frame(spark, ids, x), "id", "vec")}, N.Search(probes=30)).collect()
    have = {}
    for r in got:
        have.setdefault(r["id"], set()).add(r["other"])
    keys = [k for k in want if k in have]
    assert np.mean([len(have[k] & set(want[k])) / 5 for k in keys]) >= 0.9


def test_empty(spark):
    df = spark.createDataFrame([], "id string, vec array<float>")
    assert N.neighbours(spark, {"f": (df, "id", "vec")}, N.Search()).count() == 0


def test_every_copy_asked_is_answered(spark):
    ids, x = _data()
    want = N.brute_force(ids, x.astype(np.float64), 5)
    df = _frame(spark, ids, x)
    for asked in (None, F.substring("id", 5, 1).isin("7", "3"), F.col("id") == "k0214"):
        # All lists are visited, so the answers are exact.
        got = {}
        for r in N.neighbours(spark, {"f": (df, "id", "vec")}, N.Search(probes=1, share=1.0), asked).orderBy("id", "place").collect():
            got.setdefault(r["id"], []).append(r["other"])
        keys = set(ids) if asked is None else {r["id"] for r in df.where(asked).collect()} & set(ids)
        assert got == {k: want[k] for k in keys}


def test_numbers_of_any_size(spark):
    """Vectors are as similar at 1e200 or 1e-200 as at 1; infinite ones are in no pair."""
    base = [[1.0, 2.0, 3.0, -1.0], [1.0, 2.0, 3.0, -1.001], [-3.0, 1.0, 0.0, 2.0]]
    rows = [("a", base[0]), ("b", [x * 1e200 for x in base[1]]), ("c", [x * 1e-200 for x in base[2]]), ("d", [x * 1e35 for x in base[0]]), ("e", [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    found = N.neighbours(spark, {"f": (df, "id", "vec")}, N.Search(k=2, least=0.95))
    assert {(r["id"], r["other"]) for r in found.collect()} == {("a", "b"), ("a", "d"), ("b", "a"), ("b", "d"), ("d", "a"), ("d", "b")}
