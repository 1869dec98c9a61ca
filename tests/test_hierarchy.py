"""Pointer doubling against a plain walk."""

import random

from lakeloom.operators import hierarchy


def _walk(parent):
    circles, trees = set(), {}
    for n in parent:
        path, at = [n], parent[n]
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            trees[n] = path[::-1]
        elif at == n:
            circles.add(n)
    return trees, circles


def _run(spark, rows):
    df = spark.createDataFrame(rows, "repo_name string, fqn string, parent_fqn string, other int")
    trees, circles = hierarchy.resolve(spark, hierarchy.links(df))
    return trees, {(r["scope"], r["node"]) for r in circles.collect()}


def test_random_forests_with_circles(spark):
    rng = random.Random(5)
    parent = {}
    for i in range(60):
        parent[f"n{i}"] = f"n{rng.randrange(60)}" if rng.random() < 0.6 else None
    chain = {f"c{i}": f"c{i - 1}" if i else None for i in range(37)}
    ring = {f"z{i}": f"z{(i + 1) % 7}" for i in range(7)} | {"t0": "t1", "t1": "t2", "t2": "z0", "self": "self"}
    parent |= chain | ring
    rows = [("r", k, v, 1) for k, v in parent.items()] * 2 + [("r", None, "n1", 0), ("r", " ", "n1", 0), (None, "n1", None, 0), ("q", "lone", "n1", 0), ("q", "blank", " ", 0)]
    trees, circles = _run(spark, rows)
    want_trees, want_circles = _walk(parent)
    assert circles == {("r", n) for n in want_circles}
    got = {(r["scope"], r["node"]): (list(r["path"]), r["depth"], r["root"]) for r in trees.collect()}
    want = {("r", n): (p, len(p) - 1, p[0]) for n, p in want_trees.items()} | {("q", "lone"): (["lone"], 0, "lone"), ("q", "blank"): (["blank"], 0, "blank")}
    assert got == want
    below = {(r["ancestor"], r["descendant"], r["distance"]) for r in hierarchy.descendants(trees.where("scope = 'r'")).collect()}
    assert below == {(a, n, len(p) - 1 - i) for n, p in want_trees.items() for i, a in enumerate(p)}


def test_empty_and_single_circle(spark):
    trees, circles = _run(spark, [])
    assert trees.count() == 0 and circles == set()
    trees, circles = _run(spark, [("r", "a", "b", 1), ("r", "b", "a", 1)])
    assert trees.count() == 0 and circles == {("r", "a"), ("r", "b")}
