"""G, C: call graph, impact, dead code, lineage, links, flows and communities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import components as cc
from lakeloom.operators import graph as op
from lakeloom.operators import lookups
from lakeloom.plans import domain as D
from lakeloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SYMBOL = "old rod"


def _trail_ctes(depth: int, conf: float, up: bool, e: str = "e", tr: str = "tr") -> str:
    a, b = ("dst", "src") if up else ("src", "dst")
    return f"""{e} AS (SELECT {a} AS f, {b} AS t, confidence, method, [src, dst] AS k FROM ca WHERE confidence >= {conf}),
{tr} AS (SELECT nd.id AS start, {e}.t AS node, 1 AS depth, {e}.confidence, {e}.method, {e}.confidence AS product, [{e}.k] AS trail FROM nd JOIN {e} ON {e}.f = nd.id WHERE contains(nd.name, '{SYMBOL}')
UNION ALL SELECT {tr}.start, {e}.t, {tr}.depth + 1, {e}.confidence, {e}.method, {tr}.product * {e}.confidence, list_append({tr}.trail, {e}.k) FROM {tr} JOIN {e} ON {e}.f = {tr}.node WHERE {tr}.depth < {depth} AND NOT list_contains({tr}.trail, {e}.k))"""


def _trails(depth: int, conf: float, up: bool) -> str:
    return f"WITH RECURSIVE {D.ND}, {D.CA}, " + _trail_ctes(depth, conf, up)


def _graph(s, d):
    return D.nodes(s, d), D.calls(s, d)


def _traverse(name, up, depth, conf):
    sql = _trails(depth, conf, up) + " SELECT DISTINCT nd.name, nd.module, nd.kind, tr.depth, round(tr.confidence, 6) AS confidence, tr.method FROM tr JOIN nd ON nd.id = tr.node"

    @query(name, sql)
    def _(s, d):
        n, e = _graph(s, d)
        return op.reached(n, e, SYMBOL, depth, conf, up).withColumn("confidence", F.round("confidence", 6))


_traverse("g1_downstream_calls", False, 3, 0.97)
_traverse("g2_upstream_calls", True, 3, 0.97)


_REACHED = "nd.name, nd.module, nd.kind, t.depth, round(t.confidence, 6) AS confidence, t.method"


@query(
    "g3_traverse_both_depth4",
    f"WITH RECURSIVE {D.ND}, {D.CA}, {_trail_ctes(4, 0.99, False)}, {_trail_ctes(4, 0.99, True, 'eu', 'tu')} SELECT DISTINCT 'down' AS direction, {_REACHED} FROM tr t JOIN nd ON nd.id = t.node UNION SELECT DISTINCT 'up', {_REACHED} FROM tu t JOIN nd ON nd.id = t.node",
)
def _(s, d):
    n, e = _graph(s, d)
    both = [op.reached(n, e, SYMBOL, 4, 0.99, up).withColumn("direction", F.lit("up" if up else "down")) for up in (False, True)]
    return both[0].unionByName(both[1]).withColumn("confidence", F.round("confidence", 6))


@query("g4_impact_callers", _trails(2, 0.9, True) + " SELECT * FROM (SELECT DISTINCT tr.node, nd.name, nd.module, tr.depth, round(tr.product, 6) AS confidence FROM tr JOIN nd ON nd.id = tr.node) ORDER BY depth, node, confidence LIMIT 200")
def _(s, d):
    n, e = _graph(s, d)
    t = op.trails(e, n.where(F.col("name").contains(SYMBOL)), 2, 0.9, True)
    t = t.join(n.select(F.col("id").alias("node"), "name", "module"), "node").select("node", "name", "module", "depth", F.round("product", 6).alias("confidence")).distinct()
    return t.orderBy("depth", "node", "confidence").limit(200)  # the reference's cap of a traversal


@query("g5_references", f"WITH {D.ND}, {D.CA} SELECT x.id AS target, y.id AS source, round(ca.confidence, 6) AS confidence, 'call' AS ref_kind FROM ca JOIN nd x ON x.id = ca.dst JOIN nd y ON y.id = ca.src WHERE ca.confidence >= 0.7")
def _(s, d):
    n, e = _graph(s, d)
    e = e.where("confidence >= 0.7").join(n.select(F.col("id").alias("dst")), "dst").join(n.select(F.col("id").alias("src")), "src")
    return e.select(F.col("dst").alias("target"), F.col("src").alias("source"), F.round("confidence", 6).alias("confidence"), F.lit("call").alias("ref_kind"))


@query("g6_module_imports_of", f"WITH {D.ND}, {D.CA} SELECT DISTINCT ca.dst AS target, y.module FROM ca JOIN nd x ON x.id = ca.dst JOIN nd y ON y.id = ca.src WHERE x.module <> y.module")
def _(s, d):
    n, e = _graph(s, d)
    j = e.join(n.select(F.col("id").alias("dst"), F.col("module").alias("m")), "dst").join(n.select(F.col("id").alias("src"), "module"), "src")
    return j.where("m <> module").select(F.col("dst").alias("target"), "module").distinct()


@query("g7_implementations", f"WITH {D.CH}, t AS (SELECT repo_name, fqn, name, chunk_type FROM ch WHERE chunk_type IN ('interface', 'trait')) SELECT t.repo_name, t.fqn AS interface, c.id AS implementor FROM t JOIN ch c ON c.repo_name = t.repo_name AND c.parent_fqn = t.fqn WHERE c.chunk_type = 'method'")
def _(s, d):
    ch = D.chunks(s, d, ["repo_name", "fqn", "parent_fqn", "chunk_type", "ingested_at"])
    t = ch.where("chunk_type in ('interface', 'trait')").select("repo_name", F.col("fqn").alias("interface"))
    m = ch.where("chunk_type = 'method'").select("repo_name", F.col("parent_fqn").alias("interface"), F.col("id").alias("implementor"))
    return t.join(m, ["repo_name", "interface"])


_NF = "nf AS (SELECT DISTINCT id, repo_name, unnest(related_files) AS path FROM no)"


def _note_files(s, d):
    return D.notes(s, d, ["repo_name", "related_files", "updated_at"]).select("id", "repo_name", F.explode("related_files").alias("path")).distinct()


@query("g8_module_note_counts", f"WITH {D.MO}, {D.NO}, {_NF} SELECT mo.repo_name, mo.path, count(nf.id) AS n_notes FROM mo LEFT JOIN nf ON nf.repo_name = mo.repo_name AND nf.path = mo.path GROUP BY ALL")
def _(s, d):
    m = D.modules(D.chunks(s, d)).select("repo_name", "path")
    k = lookups.counts(_note_files(s, d), "repo_name", "path", name="n_notes")
    return m.join(k, ["repo_name", "path"], "left").withColumn("n_notes", F.coalesce("n_notes", F.lit(0)))


@query("g9_intra_module_calls", f"WITH {D.ND}, {D.CA} SELECT x.module, ca.src, ca.dst FROM ca JOIN nd x ON x.id = ca.src JOIN nd y ON y.id = ca.dst WHERE x.module = y.module")
def _(s, d):
    n, e = _graph(s, d)
    a, b = n.select(F.col("id").alias("src"), "module"), n.select(F.col("id").alias("dst"), F.col("module").alias("m"))
    return e.join(a, "src").join(b, "dst").where("module = m").select("module", "src", "dst")


@query("g10_calls_count", f"WITH {D.ND}, {D.CA} SELECT nd.module, count(*) AS n FROM ca JOIN nd ON nd.id = ca.src GROUP BY 1")
def _(s, d):
    n, e = _graph(s, d)
    return lookups.counts(e.join(n.select(F.col("id").alias("src"), "module"), "src"), "module")


@query("g11_module_god_nodes", f"WITH {D.IM}, dg AS (SELECT m, sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT src AS m, 0 AS i, 1 AS o FROM im UNION ALL SELECT dst, 1, 0 FROM im) GROUP BY 1), k AS (SELECT module, count(*) AS n_chunks FROM nd GROUP BY 1) SELECT m AS module, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, n_chunks FROM dg JOIN k ON k.module = dg.m WHERE in_degree + out_degree > 0 ORDER BY in_degree + out_degree DESC, m LIMIT 10")
def _(s, d):
    deg = op.degrees(D.imports(s, d)).where("degree > 0").withColumnRenamed("id", "module")
    n = lookups.counts(D.nodes(s, d), "module", name="n_chunks")
    return deg.join(n, "module").orderBy(F.desc("degree"), "module").limit(10).drop("degree")


_CG = "dg AS (SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM ca UNION ALL SELECT dst, 1, 0 FROM ca) GROUP BY 1)"


@query("g12_chunk_god_nodes", f"WITH {D.ND}, {D.CA}, {_CG} SELECT dg.id, nd.name, in_degree, out_degree, degree FROM dg JOIN nd ON nd.id = dg.id WHERE degree >= 3 ORDER BY degree DESC, dg.id LIMIT 10")
def _(s, d):
    n, e = _graph(s, d)
    return op.degrees(e).where("degree >= 3").join(n.select("id", "name"), "id").orderBy(F.desc("degree"), "id").limit(10)


@query("g13_ghost_nodes", f"WITH {D.ND}, {D.CA}, b AS (SELECT ca.src, ca.dst, x.module AS a, y.module AS b FROM ca JOIN nd x ON x.id = ca.src JOIN nd y ON y.id = ca.dst WHERE x.module <> y.module) SELECT b AS module, src AS ghost FROM b UNION SELECT a, dst FROM b")
def _(s, d):
    n, e = _graph(s, d)
    b = op.boundary(e, n)
    return b.select(F.col("group").alias("module"), F.when(F.col("side") == "caller", F.col("src")).otherwise(F.col("dst")).alias("ghost")).distinct()


@query("g14_boundary_edges", f"WITH {D.ND}, {D.CA}, b AS (SELECT ca.src, ca.dst, x.module AS a, y.module AS b FROM ca JOIN nd x ON x.id = ca.src JOIN nd y ON y.id = ca.dst WHERE x.module <> y.module) SELECT m AS module, side, count(*) AS n FROM (SELECT b AS m, 'caller' AS side FROM b UNION ALL SELECT a, 'callee' FROM b) GROUP BY ALL")
def _(s, d):
    n, e = _graph(s, d)
    return lookups.counts(op.boundary(e, n).withColumnRenamed("group", "module"), "module", "side")


@query("g15_god_node_report", f"WITH {D.IM}, {_CG}, t AS (SELECT nd.name || '#' || nd.id AS name, degree, 'chunk' AS kind FROM dg JOIN nd ON nd.id = dg.id WHERE degree >= 3 UNION ALL SELECT m, count(*), 'module' FROM (SELECT src AS m FROM im UNION ALL SELECT dst FROM im) GROUP BY 1), n AS (SELECT count(*) AS total FROM nd) SELECT name, degree, kind, total FROM t, n ORDER BY degree DESC, name LIMIT 10")
def _(s, d):
    n, e = _graph(s, d)
    c = op.degrees(e).where("degree >= 3").join(n.select("id", "name"), "id").select(F.concat_ws("#", "name", "id").alias("name"), "degree", F.lit("chunk").alias("kind"))
    m = op.degrees(D.imports(s, d)).select(F.col("id").alias("name"), "degree", F.lit("module").alias("kind"))
    total = n.agg(F.count(F.lit(1)).alias("total"))
    return c.unionByName(m).orderBy(F.desc("degree"), "name").limit(10).join(F.broadcast(total), how="inner")  # one row


@query("g16_community_edges", f"WITH {D.ND}, {D.CA} SELECT x.module AS src, y.module AS dst, round(sum(coalesce(ca.confidence, 1)), 6) AS weight FROM ca JOIN nd x ON x.id = ca.src JOIN nd y ON y.id = ca.dst WHERE coalesce(ca.confidence, 1) >= 0.95 GROUP BY ALL")
def _(s, d):
    n, e = _graph(s, d)
    a, b = n.select(F.col("id").alias("src"), F.col("module").alias("a")), n.select(F.col("id").alias("dst"), F.col("module").alias("b"))
    j = e.where(F.coalesce("confidence", F.lit(1.0)) >= 0.95).join(a, "src").join(b, "dst")
    return j.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.round(F.sum("confidence"), 6).alias("weight"))


_VIS = "CASE WHEN size <= 10 THEN 'private' WHEN size <= 25 THEN 'crate' WHEN size <= 40 THEN 'public' ELSE '' END"
_TIER = "CASE WHEN contains(v, 'private') THEN 'high' WHEN contains(v, 'crate') THEN 'medium' WHEN contains(v, 'public') OR contains(v, 'export') THEN 'low' ELSE 'medium' END"
_ZERO = f"WITH {D.ND}, {D.CA}, z AS (SELECT id, name, module, {_VIS} AS v, kind = 'PROMO' AS is_entry_point FROM nd WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.dst = nd.id AND ca.confidence >= 0.97))"


def _zero_callers(s, d):
    n, e = _graph(s, d)
    v = F.when(F.col("size") <= 10, "private").when(F.col("size") <= 25, "crate").when(F.col("size") <= 40, "public").otherwise("")
    z = n.join(e.where("confidence >= 0.97").select(F.col("dst").alias("id")), "id", "left_anti")
    return z.select("id", "name", "module", v.alias("v"), (F.col("kind") == "PROMO").alias("is_entry_point"))


@query("g17_zero_caller_functions", _ZERO + " SELECT id, name, module, v AS visibility, is_entry_point FROM z")
def _(s, d):
    return _zero_callers(s, d).withColumnRenamed("v", "visibility")


@query("g18_dead_code_ranking", _ZERO + f" SELECT id, {_TIER} AS tier, row_number() OVER (PARTITION BY module ORDER BY CASE {_TIER} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, name, id) AS place, module FROM z WHERE NOT is_entry_point")
def _(s, d):
    z = _zero_callers(s, d).where("not is_entry_point").withColumn("tier", op.dead_code_tier(F.col("v")))
    order = F.when(F.col("tier") == "high", 0).when(F.col("tier") == "medium", 1).otherwise(2)
    return z.withColumn("place", F.row_number().over(Window.partitionBy("module").orderBy(order, "name", "id"))).select("id", "tier", "place", "module")


@query("g19_dead_code_report", _ZERO + f", t AS (SELECT {_TIER} AS tier FROM z WHERE NOT is_entry_point) SELECT (SELECT count(*) FROM nd) AS total_functions, count(*) FILTER (WHERE tier = 'high') AS high, count(*) FILTER (WHERE tier = 'medium') AS medium, count(*) FILTER (WHERE tier = 'low') AS low FROM t")
def _(s, d):
    z = _zero_callers(s, d).where("not is_entry_point").withColumn("tier", op.dead_code_tier(F.col("v")))
    total = D.nodes(s, d).agg(F.count(F.lit(1)).alias("total_functions"))
    k = z.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium", "low")])
    return total.join(F.broadcast(k), how="inner")  # one row each


_CHAIN = f"WITH RECURSIVE {D.SU}, cl AS (SELECT newer AS a, older AS b, 1 AS hops FROM su UNION ALL SELECT cl.a, su.older, cl.hops + 1 FROM cl JOIN su ON su.newer = cl.b)"


def _chain(s, d):
    e = D.supersedes(s, d).select(F.col("newer").alias("src"), F.col("older").alias("dst"))
    return op.closure(s, e)


@query("g20_supersede_chain", _CHAIN + " SELECT note_id AS note, note_id AS member, 'self' AS direction, 0 AS hops FROM sn UNION ALL SELECT a, b, 'ancestor', hops FROM cl UNION ALL SELECT b, a, 'descendant', hops FROM cl")
def _(s, d):
    c = _chain(s, d)
    own = D.saga_notes(s, d).select(F.col("note_id").alias("note"), F.col("note_id").alias("member"), F.lit("self").alias("direction"), F.lit(0).alias("hops"))
    up = c.select(F.col("a").alias("note"), F.col("b").alias("member"), F.lit("ancestor").alias("direction"), "hops")
    down = c.select(F.col("b").alias("note"), F.col("a").alias("member"), F.lit("descendant").alias("direction"), "hops")
    return own.unionByName(up).unionByName(down)


@query("g21_decision_timeline", _CHAIN + ", m AS (SELECT a AS note, b AS member, hops, 1 AS r FROM cl UNION ALL SELECT b, a, hops, 2 FROM cl), g AS (SELECT note, member, min(hops * 10 + r) AS k FROM m GROUP BY ALL) SELECT note, member, CAST(k // 10 AS INTEGER) AS hops, CASE k % 10 WHEN 1 THEN 'ancestor' ELSE 'descendant' END AS direction, row_number() OVER (PARTITION BY note ORDER BY k // 10, member) AS place FROM g")
def _(s, d):
    c = _chain(s, d)
    m = c.select(F.col("a").alias("note"), F.col("b").alias("member"), F.struct("hops", F.lit(1).alias("r")).alias("k")).unionByName(c.select(F.col("b").alias("note"), F.col("a").alias("member"), F.struct("hops", F.lit(2).alias("r")).alias("k")))
    g = m.groupBy("note", "member").agg(F.min("k").alias("k"))
    w = Window.partitionBy("note").orderBy("k.hops", "member")
    return g.select("note", "member", F.col("k.hops").alias("hops"), F.when(F.col("k.r") == 1, "ancestor").otherwise("descendant").alias("direction"), F.row_number().over(w).alias("place"))


_SITES = """cs AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'ANY' WHEN event_id % 2 = 0 THEN 'get' ELSE 'POST' END AS method,
  '/' || event_type || '/' || user_id || CASE WHEN event_id % 3 = 0 THEN '/' WHEN event_id % 3 = 1 THEN '/items' ELSE '' END AS path, 'svc' || (user_id % 5) AS repo FROM events),
rs AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
  CASE n_nationkey % 5 WHEN 0 THEN '/click/:id' WHEN 1 THEN '/view/{id}/items' WHEN 2 THEN '/purchase/' || n_nationkey WHEN 3 THEN '/:kind/' || n_nationkey || '/items' ELSE '/error/{id}/' END AS path, 'svc' || (n_nationkey % 3) AS repo FROM nation)"""


def _call_sites(s, d):
    e = table(s, d, "events")
    i = F.col("event_id")
    tail = F.when(i % 3 == 0, "/").when(i % 3 == 1, "/items").otherwise("")
    method = F.when(i % 7 == 0, "ANY").when(i % 2 == 0, "get").otherwise("POST")
    return e.select(i.alias("id"), method.alias("method"), F.concat(F.lit("/"), "event_type", F.lit("/"), "user_id", tail).alias("path"), F.concat(F.lit("svc"), F.col("user_id") % 5).alias("repo"))


def _routes(s, d):
    n = table(s, d, "nation")
    k = F.col("n_nationkey")
    path = F.when(k % 5 == 0, "/click/:id").when(k % 5 == 1, "/view/{id}/items").when(k % 5 == 2, F.concat(F.lit("/purchase/"), k)).when(k % 5 == 3, F.concat(F.lit("/:kind/"), k, F.lit("/items"))).otherwise("/error/{id}/")
    return n.select(k.alias("id"), F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"), path.alias("path"), F.concat(F.lit("svc"), k % 3).alias("repo"))


_LINK = _SITES + r""", c1 AS (SELECT *, CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END AS p FROM cs), r1 AS (SELECT *, CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END AS q FROM rs),
lk AS (SELECT c1.id AS call, r1.id AS route, CASE WHEN p = q THEN 'exact' ELSE 'param' END AS matched_via, c1.repo <> r1.repo AS cross_repo FROM c1 JOIN r1 ON len(string_split(p, '/')) = len(string_split(q, '/'))
  AND (upper(c1.method) = 'ANY' OR upper(r1.method) = 'ANY' OR upper(c1.method) = upper(r1.method))
  AND (p = q OR regexp_full_match(p, regexp_replace(regexp_replace(q, ':[^/]+', '[^/]+', 'g'), '\{[^/]*\}', '[^/]+', 'g'))))"""


def _links(s, d):
    c, r = _call_sites(s, d), _routes(s, d)
    k = op.link_calls(c, r).join(c.select(F.col("id").alias("call"), F.col("repo").alias("a")), "call").join(F.broadcast(r.select(F.col("id").alias("route"), F.col("repo").alias("b"))), "route")
    return k.select("call", "route", "matched_via", (F.col("a") != F.col("b")).alias("cross_repo"))


@query("g22_cross_service_links", f"WITH {_LINK} SELECT * FROM lk")
def _(s, d):
    return _links(s, d)


@query("g23_dangling_calls", f"WITH {_LINK} SELECT DISTINCT repo, upper(method) AS method, path FROM cs WHERE id NOT IN (SELECT call FROM lk)")
def _(s, d):
    c = _call_sites(s, d).join(_links(s, d).select(F.col("call").alias("id")), "id", "left_anti")
    return c.select("repo", F.upper("method").alias("method"), "path").distinct()


@query("g24_call_sites", f"WITH {_SITES} SELECT id, coalesce(method, 'ANY') AS method, path FROM cs WHERE path <> ''")
def _(s, d):
    return _call_sites(s, d).where("path <> ''").select("id", F.coalesce("method", F.lit("ANY")).alias("method"), "path")


@query("g25_link_report", f"WITH {_LINK} SELECT matched_via, count(*) AS n, count(*) FILTER (WHERE cross_repo) AS n_cross, count(*) FILTER (WHERE NOT cross_repo) AS n_intra FROM lk GROUP BY 1")
def _(s, d):
    return _links(s, d).groupBy("matched_via").agg(F.count(F.lit(1)).alias("n"), F.count_if("cross_repo").alias("n_cross"), F.count_if(~F.col("cross_repo")).alias("n_intra"))


@query("g26_communities")
def _(s, d):
    """Weighted label propagation, an approximation of the reference's modularity search."""
    e = D.calls(s, d).select("src", "dst", F.col("confidence").alias("weight"))
    return op.local_moves(s, e)


@query("g28_components", f"WITH RECURSIVE {D.CA}, e AS (SELECT src AS a, dst AS b FROM ca UNION SELECT dst, src FROM ca), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY 1")
def _(s, d):
    return cc.components(s, D.calls(s, d), "src", "dst")


@query("g29_code_communities")
def _(s, d):
    e = D.calls(s, d).select("src", "dst", F.col("confidence").alias("weight"))
    return op.labelled(op.local_moves(s, e), D.nodes(s, d))


@query("g31_community_graph", f"WITH {D.IM} SELECT 'CALLS' AS kind, count(*) AS n, round(sum(confidence), 4) AS weight FROM ca UNION ALL SELECT 'IMPORTS_FROM', count(*), round(sum(0.5), 4) FROM im UNION ALL SELECT 'HAS_CHUNK', count(*), round(sum(0.3), 4) FROM nd")
def _(s, d):
    c = D.calls(s, d).select(F.lit("CALLS").alias("kind"), F.col("confidence").alias("w"))
    i = D.imports(s, d).select(F.lit("IMPORTS_FROM").alias("kind"), F.lit(0.5).alias("w"))
    h = D.nodes(s, d).select(F.lit("HAS_CHUNK").alias("kind"), F.lit(0.3).alias("w"))
    return c.unionByName(i).unionByName(h).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("weight"))


def _flow_starts(n):
    return n.where("kind = 'PROMO'")


@query("g33_execution_flows")
def _(s, d):
    n, e = _graph(s, d)
    return op.flows(_flow_starts(n), n, e.where("confidence >= 0.97"))


@query("g34_flow_list", f"WITH {D.ND} SELECT id AS flow, name, kind AS entry_type, row_number() OVER (ORDER BY kind, name, id) AS place FROM nd WHERE kind = 'PROMO'")
def _(s, d):
    n = _flow_starts(D.nodes(s, d)).select(F.col("id").alias("flow"), "name", F.col("kind").alias("entry_type"))
    return lookups.ranked(n, ["entry_type", "name", "flow"], "place")


@query("g35_flows_by_symbol")
def _(s, d):
    n, e = _graph(s, d)
    f = op.flows(_flow_starts(n), n, e.where("confidence >= 0.97"))
    return f.join(n.where(F.col("name").contains(SYMBOL)).select(F.col("id").alias("node")), "node", "left_semi").select("flow").distinct()


@query("g36_flow_steps")
def _(s, d):
    n, e = _graph(s, d)
    return op.flows(_flow_starts(n), n, e.where("confidence >= 0.97")).orderBy("flow", "position")


def _impact_paths(s, d):
    """CalledBy trails of the symbol, modules that import its modules, sections and notes that name it."""
    n, e = _graph(s, d)
    hit = n.where(F.col("name").contains(SYMBOL))
    called = op.trails(e, hit, 2, 0.97, True).join(n.select(F.col("id").alias("node")), "node", "left_semi").select(F.concat(F.lit("c"), "node").alias("node"), F.lit("CalledBy").alias("kind"), F.col("depth").alias("hops"), F.round("product", 6).alias("confidence")).distinct()
    mods = hit.select(F.col("module").alias("dst")).distinct()
    imported = D.imports(s, d).join(mods, "dst", "left_semi").select(F.concat(F.lit("m"), "src").alias("node"), F.lit("ImportedBy").alias("kind"), F.lit(1).alias("hops"), F.lit(1.0).alias("confidence")).distinct()
    return called.unionByName(imported)


_IMPACT = (
    _trails(2, 0.97, True).replace(D.ND + ", " + D.CA, D.IM)
    + """, ip AS (SELECT DISTINCT 'c' || tr.node AS node, 'CalledBy' AS kind, tr.depth AS hops, round(tr.product, 6) AS confidence FROM tr
UNION ALL SELECT DISTINCT 'm' || im.src, 'ImportedBy', 1, 1.0 FROM im WHERE im.dst IN (SELECT module FROM nd WHERE contains(name, 'old rod'))),
sc AS (SELECT node, max(w * pow(0.6, hops) * confidence) + 0.1 * (count(*) - 1) AS score, count(*) AS n_paths FROM (SELECT *, CASE kind WHEN 'CalledBy' THEN 1.0 ELSE 0.7 END AS w FROM ip) GROUP BY 1)"""
)


@query("g38_impact_importers", f"WITH {D.IM} SELECT DISTINCT im.src AS module FROM im WHERE im.dst IN (SELECT module FROM nd WHERE contains(name, 'old rod'))")
def _(s, d):
    hit = D.nodes(s, d).where(F.col("name").contains(SYMBOL)).select(F.col("module").alias("dst")).distinct()
    return D.imports(s, d).join(hit, "dst", "left_semi").select(F.col("src").alias("module")).distinct()


@query("g39_impact_explains", f"WITH {D.SE}, {D.CH}, t AS (SELECT DISTINCT doc_id, position, unnest(regexp_extract_all(content, '`([A-Za-z_][A-Za-z0-9_:.]*)`', 1)) AS ref FROM se) SELECT DISTINCT t.doc_id, t.position, ch.id FROM t JOIN ch ON ch.name = t.ref")
def _(s, d):
    t = D.sections(s, d).select("doc_id", "position", F.explode(F.regexp_extract_all("content", F.lit("`([A-Za-z_][A-Za-z0-9_:.]*)`"), F.lit(1))).alias("name")).distinct()
    return t.join(D.chunks(s, d, ["name", "ingested_at"]).select("id", "name"), "name").select("doc_id", "position", "id").distinct()


@query("g40_impact_notes", f"WITH {D.NO}, {D.CH}, r AS (SELECT DISTINCT id AS note, repo_name, trim(unnest(related_symbols)) AS name FROM no) SELECT r.note, ch.id AS chunk FROM r JOIN ch ON ch.repo_name = r.repo_name AND ch.name = r.name")
def _(s, d):
    return _attached(s, d).select("note", "chunk")


def _attached(s, d):
    r = D.notes(s, d, ["repo_name", "category", "related_symbols", "updated_at"]).select(F.col("id").alias("note"), "repo_name", "category", F.explode("related_symbols").alias("x"))
    r = r.select("note", "repo_name", "category", F.trim("x").alias("name")).distinct()
    return r.join(D.chunks(s, d, ["repo_name", "name", "fqn", "module_path", "ingested_at"]).withColumnRenamed("id", "chunk"), ["repo_name", "name"])


@query("g42_path_scores", _IMPACT + " SELECT node, kind, hops, round(CASE kind WHEN 'CalledBy' THEN 1.0 ELSE 0.7 END * pow(0.6, hops) * confidence, 6) AS score FROM ip")
def _(s, d):
    p = _impact_paths(s, d)
    return p.select("node", "kind", "hops", F.round(op.path_score(F.col("kind"), F.col("hops"), F.col("confidence")), 6).alias("score"))


@query("g43_impact_scores", _IMPACT + " SELECT node, round(score, 5) AS score, n_paths FROM sc")
def _(s, d):
    return op.impact(_impact_paths(s, d)).withColumn("score", F.round("score", 5))


@query("g44_risk_level", _IMPACT + " SELECT CASE WHEN sum(score) > 3 OR max(score) > 0.8 THEN 'HIGH' WHEN sum(score) > 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS n_nodes FROM sc")
def _(s, d):
    return op.impact(_impact_paths(s, d)).agg(op.risk_level(F.sum("score"), F.max("score")).alias("risk"), F.count(F.lit(1)).alias("n_nodes"))


@query("g45_change_impact", _IMPACT + ", x AS (SELECT 'c' || id AS node FROM nd WHERE contains(name, 'old rod')) SELECT node, round(score, 5) AS score FROM sc WHERE node NOT IN (SELECT node FROM x) AND score >= 0.1 ORDER BY round(score, 5) DESC, node LIMIT 100")
def _(s, d):
    own = D.nodes(s, d).where(F.col("name").contains(SYMBOL)).select(F.concat(F.lit("c"), "id").alias("node"))
    i = op.impact(_impact_paths(s, d), 0.1).join(own, "node", "left_anti")
    return i.select("node", F.round("score", 5).alias("score")).orderBy(F.desc("score"), "node").limit(100)  # the report's size


@query("g49_decisions_for_symbol", f"WITH {D.NO}, {D.CH}, r AS (SELECT DISTINCT id AS note, repo_name, category, trim(unnest(related_symbols)) AS name FROM no) SELECT r.note, ch.fqn FROM r JOIN ch ON ch.repo_name = r.repo_name AND ch.name = r.name WHERE upper(trim(r.category)) = 'DECISION'")
def _(s, d):
    return _attached(s, d).where(F.upper(F.trim("category")) == "DECISION").select("note", "fqn")


@query("g50_chunks_of_note", f"WITH {D.NO}, {D.CH}, r AS (SELECT DISTINCT id AS note, repo_name, trim(unnest(related_symbols)) AS name FROM no) SELECT r.note, count(*) AS n_chunks FROM r JOIN ch ON ch.repo_name = r.repo_name AND ch.name = r.name GROUP BY 1")
def _(s, d):
    return lookups.counts(_attached(s, d), "note", name="n_chunks")


@query("g51_decision_history", f"WITH RECURSIVE {D.NO}, su AS (SELECT id AS older, superseded_by AS newer FROM no WHERE superseded_by IS NOT NULL), w AS (SELECT older AS note, newer AS here, 1 AS hops FROM su UNION SELECT w.note, su.newer, w.hops + 1 FROM w JOIN su ON su.older = w.here WHERE w.hops < 60) SELECT note, here AS successor, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY ALL")
def _(s, d):
    n = D.notes(s, d, ["superseded_by", "updated_at"]).where("superseded_by is not null")
    return op.closure(s, n.select(F.col("id").alias("src"), F.col("superseded_by").alias("dst"))).select(F.col("a").alias("note"), F.col("b").alias("successor"), "hops")


@query("g52_graph_overview", f"WITH {D.NO}, {D.MO} SELECT repo_name, count(*) AS n_modules, CAST(sum(n_chunks) AS BIGINT) AS n_chunks, coalesce(max(n.k), 0) AS n_notes, coalesce(max(n.b), 0) AS n_branches FROM mo LEFT JOIN (SELECT repo_name AS r, count(*) AS k, count(DISTINCT branch) AS b FROM no GROUP BY 1) n ON n.r = mo.repo_name GROUP BY 1")
def _(s, d):
    m = D.modules(D.chunks(s, d)).groupBy("repo_name").agg(F.count(F.lit(1)).alias("n_modules"), F.sum("n_chunks").alias("n_chunks"))
    n = D.notes(s, d, ["repo_name", "branch", "updated_at"]).groupBy("repo_name").agg(F.count(F.lit(1)).alias("n_notes"), F.countDistinct("branch").alias("n_branches"))
    return m.join(n, "repo_name", "left").fillna(0, ["n_notes", "n_branches"])


@query("g53_module_graph", f"WITH {D.IM}, k AS (SELECT module, count(*) AS n_chunks FROM nd GROUP BY 1), o AS (SELECT src, count(*) AS n_imports FROM im GROUP BY 1) SELECT k.module, k.n_chunks, coalesce(o.n_imports, 0) AS n_imports FROM k LEFT JOIN o ON o.src = k.module")
def _(s, d):
    k = lookups.counts(D.nodes(s, d), "module", name="n_chunks")
    o = lookups.counts(D.imports(s, d).withColumnRenamed("src", "module"), "module", name="n_imports")
    return k.join(o, "module", "left").withColumn("n_imports", F.coalesce("n_imports", F.lit(0)))


@query("g54_saga_groups", f"WITH {D.SN} SELECT saga_id, string_agg(DISTINCT category, ',' ORDER BY category) AS modules FROM sn GROUP BY 1")
def _(s, d):
    return D.saga_notes(s, d).groupBy("saga_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("modules"))


@query("g55_module_call_graph", f"WITH {D.ND}, {D.CA}, j AS (SELECT ca.src, ca.dst, x.module AS a, y.module AS b FROM ca JOIN nd x ON x.id = ca.src JOIN nd y ON y.id = ca.dst) SELECT a AS module, count(*) FILTER (WHERE a = b) AS internal, count(*) FILTER (WHERE a <> b) AS outgoing, count(DISTINCT CASE WHEN a <> b THEN dst END) AS ghosts FROM j GROUP BY 1")
def _(s, d):
    n, e = _graph(s, d)
    j = e.join(n.select(F.col("id").alias("src"), F.col("module").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("module").alias("b")), "dst")
    return j.groupBy(F.col("a").alias("module")).agg(F.count_if(F.col("a") == F.col("b")).alias("internal"), F.count_if(F.col("a") != F.col("b")).alias("outgoing"), F.countDistinct(F.when(F.col("a") != F.col("b"), F.col("dst"))).alias("ghosts"))


@query("g56_doc_graph", f"WITH {D.SE}, t AS (SELECT DISTINCT doc_id, position, unnest(regexp_extract_all(content, '`([A-Za-z_][A-Za-z0-9_:.]*)`', 1)) AS ref FROM se) SELECT coalesce(trim(lower(d.source)), '') AS source, count(DISTINCT t.doc_id) AS n_docs, count(*) AS n_refs FROM t JOIN documents d ON d.doc_id = t.doc_id GROUP BY 1")
def _(s, d):
    t = D.sections(s, d).select("doc_id", "position", F.explode(F.regexp_extract_all("content", F.lit("`([A-Za-z_][A-Za-z0-9_:.]*)`"), F.lit(1))).alias("ref")).distinct()
    j = t.join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy(F.coalesce(F.trim(F.lower("source")), F.lit("")).alias("source")).agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_refs"))


@query("g59_chunk_note_ids", f"WITH {D.NO}, {D.CH}, r AS (SELECT DISTINCT id AS note, repo_name, trim(unnest(related_symbols)) AS name FROM no), a AS (SELECT ch.id AS chunk, r.note FROM r JOIN ch ON ch.repo_name = r.repo_name AND ch.name = r.name) SELECT ch.id, coalesce(string_agg(a.note, ',' ORDER BY a.note), '') AS notes FROM ch LEFT JOIN a ON a.chunk = ch.id GROUP BY 1")
def _(s, d):
    a = _attached(s, d).select(F.col("chunk").alias("id"), "note").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("note")), ",").alias("notes"))
    return D.chunks(s, d, ["ingested_at"]).select("id").join(a, "id", "left").withColumn("notes", F.coalesce("notes", F.lit("")))


@query("g60_branches", f"WITH {D.NO} SELECT repo_name, branch, count(*) AS n_notes, count(DISTINCT trim(lower(category))) AS n_categories FROM no GROUP BY ALL")
def _(s, d):
    return D.notes(s, d, ["repo_name", "branch", "category", "updated_at"]).groupBy("repo_name", "branch").agg(F.count(F.lit(1)).alias("n_notes"), F.countDistinct(F.trim(F.lower("category"))).alias("n_categories"))
