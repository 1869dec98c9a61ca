"""Traversal, degree, closure and community operators on edge lists.

Edges are (src, dst, confidence, method).  A filter that every edge of a path
must pass is applied to the edges before they are joined, not to the paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lakeloom.sources.tables import Scratch

MOST_DEPTH = 4
#: Flows that one task walks, about.
WALKS = 500


def trails(edges: DataFrame, starts: DataFrame, depth: int, min_confidence: float = 0.0, upstream: bool = False) -> DataFrame:
    """All trails of 1 to ``depth`` edges from the starts: (start, node, depth, confidence, method, product).

    A trail repeats no edge, though it may repeat a node.  confidence and method
    are those of the edge next to the reached node, product is over the trail.
    The depth is clamped to 1..4, so the joins are unrolled.
    """
    depth = max(1, min(MOST_DEPTH, depth))
    e = edges.where(F.col("confidence") >= min_confidence)
    near, far = ("dst", "src") if upstream else ("src", "dst")
    e = e.select(F.col(near).alias("_from"), F.col(far).alias("_to"), F.col("confidence").alias("_c"), F.col("method").alias("_m"), F.struct("src", "dst").alias("_e"))
    step = starts.select(F.col("id").alias("start")).distinct()
    step = step.join(e, F.col("start") == F.col("_from")).select("start", F.col("_to").alias("node"), F.lit(1).alias("depth"), F.col("_c").alias("confidence"), F.col("_m").alias("method"), F.col("_c").alias("product"), F.array("_e").alias("trail"))
    out = step
    for k in range(2, depth + 1):
        step = step.join(e, F.col("node") == F.col("_from")).where(~F.array_contains("trail", F.col("_e")))
        step = step.select("start", F.col("_to").alias("node"), F.lit(k).alias("depth"), F.col("_c").alias("confidence"), F.col("_m").alias("method"), (F.col("product") * F.col("_c")).alias("product"), F.concat("trail", F.array("_e")).alias("trail"))
        out = out.unionByName(step)
    return out.drop("trail")


def reached(nodes: DataFrame, edges: DataFrame, symbol: str, depth: int, min_confidence: float, upstream: bool = False) -> DataFrame:
    """Distinct (name, module, kind, depth, confidence, method) reached from nodes whose name contains the symbol."""
    starts = nodes.where(F.col("name").contains(symbol))
    t = trails(edges, starts, depth, min_confidence, upstream)
    return t.join(nodes.select(F.col("id").alias("node"), "name", "module", "kind"), "node").select("name", "module", "kind", "depth", "confidence", "method").distinct()


def distances(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): the nodes within ``depth`` calls of each start, with the fewest calls to them."""
    s = Scratch(starts.sparkSession, "distances")
    e = edges.select("src", "dst").distinct()
    level = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    seen = level.withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        nxt = level.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        level = s.save(nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "level")
        seen = seen.unionByName(level.withColumn("depth", F.lit(k)))
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) of every end of an edge."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def boundary(edges: DataFrame, members: DataFrame, by: str = "module") -> DataFrame:
    """(group, src, dst, side) of the edges that leave or enter a group of nodes; side says which end is outside."""
    a = members.select(F.col("id").alias("src"), F.col(by).alias("_a"))
    b = members.select(F.col("id").alias("dst"), F.col(by).alias("_b"))
    e = edges.select("src", "dst").join(a, "src").join(b, "dst").where("_a <> _b")
    return e.select(F.col("_b").alias("group"), "src", "dst", F.lit("caller").alias("side")).unionByName(e.select(F.col("_a").alias("group"), "src", "dst", F.lit("callee").alias("side")))


def closure(spark: SparkSession, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(a, b, hops): every pair that a path joins, with the fewest hops, by doubling.

    A shortest path of more than 2^k and at most 2^(k+1) edges is one of exactly
    2^k and one of at most that, so each round joins only the pairs at exactly
    the reached distance with those found so far, and stores only new pairs.
    Circles end with the round that finds nothing.
    """
    s = Scratch(spark, "closure")
    known = s.save(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null").distinct().withColumn("hops", F.lit(1)), "pairs")
    exact, reach = known, 1
    for _ in range(max_rounds):
        more = exact.select("a", F.col("b").alias("_m"), F.col("hops").alias("_h")).join(known.select(F.col("a").alias("_m"), "b", "hops"), "_m")
        more = more.groupBy("a", "b").agg(F.min(F.col("_h") + F.col("hops")).alias("hops"))
        new = s.save(more.join(known.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if new.limit(1).count() == 0:
            return known
        reach *= 2
        known, exact = known.unionByName(new), new.where(F.col("hops") == reach)
    raise RuntimeError("closure did not settle")


#: Weights of the ways in which a change reaches a node, and what a hop leaves of it (fixed values).
WEIGHTS = {"CalledBy": 1.0, "InFlow": 0.9, "ImportedBy": 0.7, "ExplainedBy": 0.3, "NotedBy": 0.2}
DECAY = 0.6


def path_score(kind: Column, hops: Column, confidence: Column) -> Column:
    weight = F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in WEIGHTS.items()])
    return weight * F.pow(F.lit(DECAY), hops) * confidence


def impact(paths: DataFrame, min_score: float = 0.0) -> DataFrame:
    """(node, score, n_paths): the best path and a tenth for each further one."""
    p = paths.withColumn("s", path_score(F.col("kind"), F.col("hops"), F.col("confidence")))
    out = p.groupBy("node").agg((F.max("s") + 0.1 * (F.count(F.lit(1)) - 1)).alias("score"), F.count(F.lit(1)).alias("n_paths"))
    return out.where(F.col("score") >= min_score)


def risk_level(total: Column, most: Column) -> Column:
    return F.when((total > 3.0) | (most > 0.8), "HIGH").when(total > 1.0, "MEDIUM").otherwise("LOW")


def dead_code_tier(visibility: Column) -> Column:
    v = F.lower(F.coalesce(visibility, F.lit("")))
    return F.when(v.contains("private"), "high").when(v.contains("crate"), "medium").when(v.contains("public") | v.contains("export"), "low").otherwise("medium")


def normal_path(p: Column) -> Column:
    """Without one final slash, except for the root."""
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def link_calls(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call, route, matched_via): client calls and the routes that serve them.

    Only routes with as many segments as the call can match, so the number of
    segments and, for exact paths, the path itself are the keys of the join; a
    template's fixed segments are compared after that.  Methods match in any
    letter case, or when one of them is ANY.
    """
    c = calls.withColumn("_p", normal_path(F.col("path"))).withColumn("_s", F.split("_p", "/"))
    r = routes.select(F.col("id").alias("route"), F.col("method").alias("_m"), normal_path(F.col("path")).alias("_q")).withColumn("_t", F.split("_q", "/"))
    param = lambda t: t.startswith(":") | (t.startswith("{") & t.endswith("}"))
    r = r.withColumn("_template", F.exists("_t", param))
    any_method = (F.upper("method") == "ANY") | (F.upper("_m") == "ANY") | (F.upper("method") == F.upper("_m"))
    exact = c.join(r, F.col("_p") == F.col("_q")).where(any_method).select(F.col("id").alias("call"), "route", F.lit("exact").alias("matched_via"))
    fixed = F.forall(F.zip_with("_s", "_t", lambda a, b: F.when(param(b), F.length(a) > 0).otherwise(a == b)), lambda x: x)
    # The first fixed segment after the root is a key too, unless it is a parameter.
    head = F.when(param(F.coalesce(F.get("_t", F.lit(1)), F.lit(""))), F.lit("*")).otherwise(F.coalesce(F.get("_t", F.lit(1)), F.lit("")))
    t = r.where("_template").withColumn("_head", head)
    cc = c.withColumn("_head", F.explode(F.array(F.coalesce(F.get("_s", F.lit(1)), F.lit("")), F.lit("*"))))
    via = cc.join(t, (F.size("_s") == F.size("_t")) & (cc["_head"] == t["_head"])).where(any_method & fixed & (F.col("_p") != F.col("_q")))
    return exact.unionByName(via.select(F.col("id").alias("call"), "route", F.lit("param").alias("matched_via"))).distinct()


def _walk(rows: list, stack: list, known: dict, depth: int, most: int, asked: list | None = None) -> tuple[list, list]:
    """(rows, stack): a preorder walk carried on to the first node whose callees are not known.

    ``rows`` and ``stack`` hold (node, depth), the next node at the stack's end.
    A stacked node is neither visited nor stacked twice, so each is visited
    unless the walk is full; no more than it has room for, and one, are kept.
    With ``asked`` the walk goes past such nodes, and adds them to it.
    """
    rows, done = list(rows), {n for n, _ in rows}
    while stack and len(rows) < most:
        node, d = stack[-1]
        out = known.get(node) if d < depth else ()
        if out is None:
            if asked is None:
                break
            asked.append(node)
        rows.append((node, d))
        done.add(node)
        stack = stack[:-1]
        if out:
            callees = dict.fromkeys(x for x in out if x not in done)
            stack = [e for e in stack if e[0] not in callees] + [(x, d + 1) for x in reversed(callees)]
            stack = stack[-(most - len(rows) + 1) :]
    return rows, stack


def flows(starts: DataFrame, names: DataFrame, edges: DataFrame, depth: int = 8, most: int = 50) -> DataFrame:
    """(flow, position, depth, node, truncated): preorder walks of the calls from entry points.

    Callees go by name; a node is visited once per flow; ``depth`` and ``most``
    bound a flow.  All flows walk together: in a round each goes on until it
    meets a node whose callees it does not have, and asks for those of all such
    nodes that it can meet.  So a round reads the callees of ``most`` nodes a
    flow, whatever its depth could reach; about ``depth`` rounds do, and every
    one visits a node.
    """
    e = edges.select("src", "dst").distinct().join(names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    adj = e.groupBy("src").agg(F.array_sort(F.collect_set(F.struct(F.col("dst_name").alias("n"), F.col("dst").alias("i")))).alias("out"))
    adj = adj.select(F.col("src").alias("node"), F.slice(F.col("out.i"), 1, most).alias("out"))  # a walk of ``most`` nodes enters no further callee of a node
    s = Scratch(starts.sparkSession, "flows")
    adj = s.save(adj, "adjacent")
    kind = dict(starts.dtypes)["id"]
    pairs, lists = f"array<struct<node: {kind}, depth: int>>", f"array<struct<node: {kind}, out: array<{kind}>>>"
    schema = f"flow {kind}, walked {pairs}, stack {pairs}, known {lists}, asked array<{kind}>, truncated boolean"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs_of = lambda c: [[(x["node"], x["depth"]) for x in xs] for xs in c.to_pylist()]
        for b in batches:
            made = []
            for flow, walked, stack, known, asked, got in zip(b.column("flow").to_pylist(), pairs_of(b.column("walked")), pairs_of(b.column("stack")), *(b.column(c).to_pylist() for c in ("known", "asked", "got"))):
                have = dict.fromkeys(asked, ()) | {x["node"]: x["out"] for x in [*known, *(got or ())]}
                walked, stack = _walk(walked, stack, have, depth, most)
                asked = []
                ahead = _walk(walked, stack, have, depth, most, asked)[0][len(walked) :]
                made.append((flow, walked, stack, [(n, have[n]) for n, _ in ahead if n in have], asked, len(stack) > 0))
            columns = zip(*made) if made else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    state = starts.select(F.col("id").alias("flow")).distinct().select("flow", F.array().cast(pairs).alias("walked"), F.array(F.struct(F.col("flow").alias("node"), F.lit(0).alias("depth"))).cast(pairs).alias("stack"), F.array().cast(lists).alias("known"), F.array("flow").alias("asked"))
    ended, tasks = None, -(-max(1, state.count()) // WALKS)
    for _ in range(most + 1):
        asks = state.select("flow", F.explode("asked").alias("node"))
        got = asks.join(adj, "node").repartition(tasks, "flow").groupBy("flow").agg(F.collect_list(F.struct("node", "out")).alias("got"))
        step = s.save(state.repartition(tasks, "flow").join(got, "flow", "left").select("flow", "walked", "stack", "known", "asked", "got").mapInArrow(run, schema), "walks")
        done = step.where(F.size("asked") == 0).select("flow", F.posexplode("walked").alias("position", "w"), "truncated")
        done = done.select("flow", "position", F.col("w.depth").alias("depth"), F.col("w.node").alias("node"), "truncated")
        ended = done if ended is None else ended.unionByName(done)
        state = step.where(F.size("asked") > 0).drop("truncated")
        if state.isEmpty():
            break
    return ended


def local_moves(spark: SparkSession, edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, community): communities by weighted label propagation with a fixed order of ties.

    Every round a node takes the label with the greatest weight among its
    neighbours and itself, the smallest of equal ones; nodes of one parity move
    at a time, so two neighbours don't swap labels for ever.
    """
    s = Scratch(spark, "communities")
    w = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight")).where("a <> b")
    w = s.save(w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")), "edges")
    label = s.save(w.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")), "labels")
    for k in range(rounds):
        near = w.join(label.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("w"))
        best = near.groupBy("node").agg(F.min_by("community", F.struct(-F.round("w", 9), F.col("community"))).alias("best"))
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        step = s.save(label.join(best, "node").select("node", F.when(moves, F.col("best")).otherwise(F.col("community")).alias("community")), "labels")
        s.drop(label)
        label = step
    return label


def labelled(communities: DataFrame, modules: DataFrame) -> DataFrame:
    """(community, size, label): the most frequent module of the members names it, the smallest of equal ones."""
    m = communities.join(modules.select(F.col("id").alias("node"), "module"), "node")
    k = m.groupBy("community", "module").agg(F.count(F.lit(1)).alias("k"))
    return k.groupBy("community").agg(F.sum("k").alias("size"), F.min_by("module", F.struct(-F.col("k"), "module")).alias("label"))
