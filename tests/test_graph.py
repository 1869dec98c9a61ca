"""Graph operators on small graphs with known results."""

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import components, graph

EDGE = "src long, dst long, confidence double, method string"


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0, "m") for a, b in pairs], EDGE)


def test_trails_repeat_no_edge_but_may_repeat_nodes(spark):
    e = _edges(spark, [(1, 2), (2, 1), (2, 3)])
    t = graph.trails(e, spark.createDataFrame([(1,)], "id long"), 9)
    assert sorted((r["node"], r["depth"]) for r in t.collect()) == [(1, 2), (2, 1), (3, 2)]


@pytest.mark.parametrize("kind,hops,conf,score", [("CalledBy", 1, 1.0, 0.60), ("CalledBy", 2, 1.0, 0.36), ("ExplainedBy", 1, 0.85, 0.153), ("NotedBy", 1, 1.0, 0.12)])
def test_path_scores(spark, kind, hops, conf, score):
    df = spark.createDataFrame([(1, kind, hops, conf)], "node long, kind string, hops int, confidence double")
    assert graph.impact(df).first()["score"] == pytest.approx(score)


def test_two_paths_add_a_tenth(spark):
    df = spark.createDataFrame([(1, "CalledBy", 2, 1.0), (1, "ImportedBy", 1, 1.0)], "node long, kind string, hops int, confidence double")
    assert graph.impact(df).first()["score"] == pytest.approx(0.52)


def test_components_and_closure(spark):
    e = _edges(spark, [(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 30), (40, 40)])
    got = {r["node"]: r["component"] for r in components.components(spark, e, "src", "dst").collect()}
    assert got == {i: 1 for i in range(1, 21)} | {30: 30, 31: 30, 40: 40}
    pairs = {(r["a"], r["b"]): r["hops"] for r in graph.closure(spark, _edges(spark, [(1, 2), (2, 3), (3, 4), (1, 4)])).collect()}
    assert pairs == {(1, 2): 1, (2, 3): 1, (3, 4): 1, (1, 3): 2, (2, 4): 2, (1, 4): 1}
    assert components.components(spark, _edges(spark, []), "src", "dst").count() == 0


def test_links_by_template(spark):
    calls = spark.createDataFrame([(1, "get", "/users/7/"), (2, "POST", "/users/7"), (3, "GET", "/users//items"), (4, "any", "/health")], "id long, method string, path string")
    routes = spark.createDataFrame([(10, "GET", "/users/:id"), (11, "GET", "/users/{id}/items"), (12, "GET", "/health"), (13, "ANY", "/:x/7")], "id long, method string, path string")
    got = {(r["call"], r["route"], r["matched_via"]) for r in graph.link_calls(calls, routes).collect()}
    assert got == {(1, 10, "param"), (4, 12, "exact"), (1, 13, "param"), (2, 13, "param")}


def test_flow_is_a_preorder_walk(spark):
    names = spark.createDataFrame([(1, "a"), (2, "c"), (3, "b"), (4, "d")], "id long, name string")
    e = _edges(spark, [(1, 2), (1, 3), (3, 4), (4, 1)])
    rows = graph.flows(names.where(F.col("id") == 1), names, e).orderBy("position").collect()
    assert [(r["node"], r["depth"], r["truncated"]) for r in rows] == [(1, 0, False), (3, 1, False), (4, 2, False), (2, 1, False)]
    cut = graph.flows(names.where(F.col("id") == 1), names, e, most=2).collect()
    assert len(cut) == 2 and all(r["truncated"] for r in cut)


def test_flows_start_at_every_entry_point(spark, monkeypatch):
    from lakeloom.plans import graph as plans

    names = spark.createDataFrame([(1, "a", "PROMO", 1), (2, "old rod b", "PROMO", 40), (3, "c", "OTHER", 1)], "id long, name string, kind string, size int")
    monkeypatch.setattr(plans, "_graph", lambda s, d: (names, _edges(spark, [(1, 3), (2, 3)])))
    run = lambda q: {r["flow"] for r in plans.QUERIES[q](spark, "").collect()}
    assert run("g33_execution_flows") == run("g36_flow_steps") == {1, 2} and run("g35_flows_by_symbol") == {2}


def test_flows_read_no_more_than_they_can_walk(spark, monkeypatch):
    """on a dense graph no stored table holds every node that a flow's depth could reach."""
    n, depth, most = 120, 8, 10
    pairs = [(a, (a * k + k) % n) for a in range(n) for k in (1, 3, 5, 7, 11)]
    out, names = {}, {i: f"n{i * 37 % n}" for i in range(n)}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = []
    for start in range(n):
        rows, stack = {}, [(start, 0)]
        while stack and len(rows) < most:
            node, d = stack.pop()
            if node not in rows:
                rows[node] = d
                if d < depth:
                    stack += [(x, d + 1) for x in sorted(out[node], key=lambda x: (names[x], x), reverse=True) if x not in rows]
        want += [(start, i, d, node, True) for i, (node, d) in enumerate(rows.items())]
    sizes, save = [], graph.Scratch.save
    monkeypatch.setattr(graph.Scratch, "save", lambda *a: sizes.append((x := save(*a)).count()) or x)
    nodes = spark.createDataFrame(list(names.items()), "id long, name string")
    got = graph.flows(nodes, nodes, _edges(spark, pairs), depth, most).collect()
    assert sorted(tuple(r[c] for c in ("flow", "position", "depth", "node", "truncated")) for r in got) == want
    assert max(sizes) <= n and len(sizes) <= most + 2
