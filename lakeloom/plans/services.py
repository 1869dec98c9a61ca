"""V, R, L, G, C, N, M, O, S: composed services over the relations of the other modules."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import text as fn
from lakeloom.operators import curation as cur
from lakeloom.operators import graph as gop
from lakeloom.operators import lookups
from lakeloom.operators import retrieval as op
from lakeloom.plans import domain as D
from lakeloom.plans import graph, more, retrieval
from lakeloom.sources import snapshots
from lakeloom.sources.tables import shared_dir, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_COS = "CASE WHEN list_inner_product(x, x) > 0 AND list_inner_product(q.v, q.v) > 0 THEN list_inner_product(x, q.v) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(q.v, q.v))) ELSE 0 END"
_ASKED = "qv AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0)"


def _asked(s, d):
    return table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))


# --- vectors and links ----------------------------------------------------------


@query("v8_scout_sections", f"WITH {D.SE}, {_ASKED}, r AS (SELECT q.query, e.vec_id AS doc_id, round({_COS}, 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) e, qv q), b AS (SELECT * FROM r JOIN (SELECT doc_id, source FROM documents) USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) <= 5) SELECT b.query, b.doc_id, se.position, b.score, b.source FROM b JOIN se ON se.doc_id = b.doc_id")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    e = table(s, d, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    best = op.nearest(e, _asked(s, d), "vec_id", "embedding", 5).select("query", F.col("key").alias("doc_id"), "score")
    return best.join(docs, "doc_id").join(D.sections(s, d).select("doc_id", "position"), "doc_id").select("query", "doc_id", "position", "score", "source")


#: Communities are the embeddings' labels, on three levels; every second one has a summary.
_COMM = "cm AS (SELECT label, CAST(label AS BIGINT) % 3 AS level, CAST(label AS BIGINT) % 2 = 0 AS summarised, list(m ORDER BY i) AS x FROM (SELECT label, i, avg(u) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS u, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1)"


def _communities(s, d):
    from lakeloom.operators import clustering

    c = clustering.centroids(table(s, d, "embeddings"), "label", "embedding")
    k = F.col("label").cast("long")
    return c.select("label", (k % 3).alias("level"), (k % 2 == 0).alias("summarised"), F.col("centroid"))


@query("v12_community_vectors", f"WITH {_COMM}, {_ASKED} SELECT query, label, score FROM (SELECT q.query, cm.label, round(round({_COS}, 6), 4) AS score FROM cm, qv q WHERE cm.level = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, label) <= 3")
def _(s, d):
    near = op.nearest(_communities(s, d).where("level = 0"), _asked(s, d), "label", "centroid", 20)
    near = near.withColumn("score", F.round("score", 4))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return near.withColumn("r", F.row_number().over(w)).where("r <= 3").select("query", F.col("key").alias("label"), "score")


_EXPLAIN = f"{D.NO}, {D.CH}, qn AS (SELECT id AS query, embedding::DOUBLE[] AS v FROM no WHERE len(embedding) = 48 AND {retrieval.ASKED}), ex AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM (SELECT q.query, c.id, round({_COS}, 6) AS score FROM (SELECT id, embedding::DOUBLE[] AS x FROM ch WHERE len(embedding) = 48) c, qn q) QUALIFY place <= 8)"


def _explain_candidates(s, d):
    """The eight chunks of all repositories that are most similar to each asked text."""
    n = D.notes(s, d, ["embedding", "updated_at"]).where((F.size("embedding") == 48) & op.every_hundredth(F.col("id"))).select(F.col("id").alias("query"), F.col("embedding").alias("v"))
    c = D.chunks(s, d, ["embedding", "ingested_at"]).where(F.size("embedding") == 48)
    return op.nearest(c, n, "id", "embedding", 8).select("query", F.col("key").alias("id"), "score", (F.col("rank") + 1).alias("place"))


@query("v13_explains_candidates", f"WITH {_EXPLAIN} SELECT * FROM ex")
def _(s, d):
    return _explain_candidates(s, d)


_L2 = f"{_EXPLAIN}, l2 AS (SELECT query, id, CASE WHEN score > 0.5 THEN 0.85 ELSE 0.7 END AS confidence, CASE WHEN score > 0.5 THEN 'embedding' ELSE 'to_verify' END AS method FROM ex WHERE score > 0.4 AND place <= 3)"


def _similarity_links(s, d):
    c = _explain_candidates(s, d).where("score > 0.4 and place <= 3")
    sure = F.col("score") > 0.5
    return c.select("query", "id", F.when(sure, 0.85).otherwise(0.7).alias("confidence"), F.when(sure, "embedding").otherwise("to_verify").alias("method"))


@query("l2_similarity_links", f"WITH {_L2} SELECT query, id, confidence, method FROM l2")
def _(s, d):
    """Links by similarity: over a half certain, down to 0.4 left to a verifier; three a text at most."""
    return _similarity_links(s, d)


@query("l4_relink_report", f"WITH {_L2} SELECT method, count(*) AS n_links, count(DISTINCT query) AS n_sections FROM l2 GROUP BY 1")
def _(s, d):
    return _similarity_links(s, d).groupBy("method").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("query").alias("n_sections"))


# --- retrieval ------------------------------------------------------------------

_AXES = "sqrt(list_inner_product(x, x)) AS n, x[1] AS a, x[2] AS b"
_ARCH = f"ar AS (SELECT id, title, CASE WHEN greatest(a, 0) + greatest(b, 0) > 0 THEN greatest(a, 0) / (greatest(a, 0) + greatest(b, 0)) ELSE 0.5 END AS archetype FROM (SELECT id, title, {_AXES} FROM (SELECT id, title, embedding::DOUBLE[] AS x FROM no WHERE len(embedding) = 48 AND title IS NOT NULL)))"


def _archetype(s, d):
    """The two archetypes are the first two axes, so a similarity is a number over the norm, which cancels out."""
    n = D.notes(s, d, ["title", "embedding", "updated_at"]).where((F.size("embedding") == 48) & F.col("title").isNotNull())
    at = lambda i: F.greatest(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0))
    return n.select("id", "title", op.archetype_signal(at(0), at(1)).alias("archetype"))


@query("r7_archetype_signal", f"WITH {D.NO}, {_ARCH} SELECT id, round(archetype, 5) AS archetype FROM ar")
def _(s, d):
    return _archetype(s, d).select("id", F.round("archetype", 5).alias("archetype"))


_R6 = retrieval.SQL["r6_query_signals"]


@query("r5_query_weights", f"WITH {D.NO}, {_ARCH}, r6 AS ({_R6}) SELECT ar.id, round(greatest(0.05, least(0.95, lean * confidence + archetype * (1 - confidence))), 4) AS symbol FROM ar JOIN r6 USING (id)")
def _(s, d):
    conf, lean = op.rule_signal(F.col("title"))
    symbol, _ = op.query_weights(F.round(conf, 6), F.round(lean, 6), F.col("archetype"))
    return _archetype(s, d).select("id", F.round(symbol, 4).alias("symbol"))


_ATT = "r AS (SELECT DISTINCT id AS note, repo_name, trim(unnest(related_symbols)) AS name FROM no), att AS (SELECT r.note, ch.id AS chunk FROM r JOIN ch ON ch.repo_name = r.repo_name AND ch.name = r.name)"


def _attached(s, d):
    return graph._attached(s, d).select("note", "chunk")


@query("r10_chunk_neighbours", f"WITH {D.NO}, {D.CH}, {_ATT} SELECT id AS chunk, 'module' AS kind, md5(repo_name || '/' || module_path) AS neighbour FROM ch UNION ALL SELECT chunk, 'note', note FROM att")
def _(s, d):
    ch = D.chunks(s, d, ["repo_name", "module_path", "ingested_at"])
    m = ch.select(F.col("id").alias("chunk"), F.lit("module").alias("kind"), F.md5(F.concat_ws("/", "repo_name", "module_path")).alias("neighbour"))
    return m.unionByName(_attached(s, d).select("chunk", F.lit("note").alias("kind"), F.col("note").alias("neighbour")))


@query("r11_flow_indirection", f"WITH {D.ND}, {D.CA} SELECT ca.dst AS node, nd.id AS entry FROM ca JOIN nd ON nd.id = ca.src WHERE nd.kind = 'PROMO' AND ca.confidence >= 0.97")
def _(s, d):
    """A node's flows stand for their entry points."""
    n, e = graph._graph(s, d)
    return e.where("confidence >= 0.97").join(graph._flow_starts(n).select(F.col("id").alias("src")), "src").select(F.col("dst").alias("node"), F.col("src").alias("entry"))


_PARENT = "pa AS (SELECT a.doc_id, a.position, (SELECT max(b.position) FROM se b WHERE b.doc_id = a.doc_id AND b.position < a.position AND b.depth < a.depth) AS parent FROM se a)"


@query("r12_section_neighbours", f"WITH {D.SE}, {_PARENT} SELECT doc_id, position, 'parent' AS kind, parent AS neighbour FROM pa WHERE parent IS NOT NULL")
def _(s, d):
    """The parent of a section is the last one before it that is less deep."""
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    sec = D.sections(s, d).select("doc_id", "position", "depth")
    # A heading has six depths, so the last section of each depth is a column.
    last = [F.last(F.when(F.col("depth") == k, F.col("position")), ignorenulls=True).over(w) for k in range(6)]
    sec = sec.withColumns({f"_l{k}": c for k, c in enumerate(last)})
    parent = F.greatest(*[F.when(F.col("depth") > k, F.col(f"_l{k}")) for k in range(6)])
    return sec.select("doc_id", "position", F.lit("parent").alias("kind"), parent.alias("neighbour")).where("neighbour is not null")


@query("r13_note_neighbours", f"WITH {D.NO}, {D.CH}, {_ATT} SELECT note, chunk FROM att")
def _(s, d):
    return _attached(s, d)


@query("r14_flow_entry_points", f"WITH {D.ND} SELECT id AS flow, id AS entry, name FROM nd WHERE kind = 'PROMO'")
def _(s, d):
    return graph._flow_starts(D.nodes(s, d)).select(F.col("id").alias("flow"), F.col("id").alias("entry"), "name")


_TOK = retrieval._TOK


@query("r17_graph_rag", f"{retrieval._BUDGET} SELECT query, array_to_string(kept, ',') AS context, len(kept) AS n_sources FROM kp")
def _(s, d):
    """Search, fuse, keep what fits the budget, and assemble the context in order."""
    kept = retrieval.QUERIES["r15_budget_prune"](s, d)
    g = kept.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("k"))
    return g.select("query", F.array_join(F.transform("k", lambda x: x["key"].cast("string")), ",").alias("context"), F.size("k").cast("long").alias("n_sources"))


def _layer(s, d, name):
    return retrieval.QUERIES[name](s, d).select("query", "id", "score", F.lit("code" if name.startswith("v1") else "notes").alias("layer"))


def _layer_sql(name, layer):
    body = retrieval.SQL[name]
    return f"SELECT query, id, score, '{layer}' AS layer FROM ({body})"


@query("r18_layered_search", f"SELECT * FROM ({_layer_sql('v1_chunk_vectors', 'code')} UNION ALL {_layer_sql('v7_scout_notes', 'notes')}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10")
def _(s, d):
    u = _layer(s, d, "v1_chunk_vectors").unionByName(_layer(s, d, "v7_scout_notes"))
    return u.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where("r <= 10").drop("r")


@query("r19_mode_routing", f"WITH {D.NO} SELECT id, CASE WHEN len(string_split(trim(title), ' ')) < 3 OR regexp_matches(lower(title), 'overview|summary') THEN 'explore' WHEN lower(trim(category)) = 'decision' THEN 'decisions' ELSE 'search' END AS mode FROM no WHERE title IS NOT NULL")
def _(s, d):
    t = D.notes(s, d, ["title", "category", "updated_at"]).where("title is not null")
    few = (F.size(F.split(F.trim("title"), " ")) < 3) | F.lower("title").rlike("overview|summary")
    return t.select("id", F.when(few, "explore").when(F.lower(F.trim("category")) == "decision", "decisions").otherwise("search").alias("mode"))


@query("r20_global_query", f"WITH {_COMM}, {_ASKED}, b AS (SELECT query, label, score FROM (SELECT q.query, cm.label, round(round({_COS}, 6), 4) AS score FROM cm, qv q WHERE cm.level = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, label) <= 3), e AS (SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3) SELECT b.query, b.label, e.vec_id AS example FROM b JOIN e USING (label)")
def _(s, d):
    best = QUERIES["v12_community_vectors"](s, d).select("query", "label")
    return best.join(QUERIES["c10_community_examples"](s, d), "label").select("query", "label", F.col("vec_id").alias("example"))


_VISR = "CASE WHEN v LIKE '%public%' OR v LIKE '%export%' THEN 4 WHEN v LIKE '%crate%' THEN 3 WHEN v LIKE '%protected%' THEN 2 WHEN v LIKE '%private%' THEN 1 ELSE 0 END"
_WANT = "w AS (SELECT DISTINCT repo_name, trim(unnest(related_symbols)) AS sym FROM no)"


@query("r22_goto_definition", f"WITH {D.NO}, {D.CH}, {_WANT}, c AS (SELECT w.repo_name, w.sym, ch.id, ch.module_path, ch.fqn, {_VISR} AS visible FROM w JOIN (SELECT *, lower(coalesce(visibility, '')) AS v FROM ch) ch ON ch.repo_name = w.repo_name AND ch.name = w.sym) SELECT repo_name, sym, id FROM c QUALIFY row_number() OVER (PARTITION BY repo_name, sym ORDER BY visible DESC, module_path, fqn NULLS FIRST, id) = 1")
def _(s, d):
    """The best definition of every symbol that a note of the repository names: the visible before the hidden."""
    w = D.notes(s, d, ["repo_name", "related_symbols", "updated_at"]).select("repo_name", F.explode("related_symbols").alias("x")).select("repo_name", F.trim("x").alias("sym")).distinct()
    c = w.join(D.chunks(s, d, ["repo_name", "name", "module_path", "fqn", "visibility", "ingested_at"]).withColumnRenamed("name", "sym"), ["repo_name", "sym"])
    best = F.min_by("id", F.struct(-lookups.visibility_rank(), "module_path", F.col("fqn").isNotNull(), "fqn", "id"))
    return c.groupBy("repo_name", "sym").agg(best.alias("id"))


@query("r23_find_references", f"WITH {D.IM} SELECT dst AS target, 'call' AS ref_kind, count(*) AS n FROM ca WHERE confidence >= 0.7 GROUP BY 1 UNION ALL SELECT ca.dst, 'import', count(DISTINCT y.module) FROM ca JOIN nd x ON x.id = ca.dst JOIN nd y ON y.id = ca.src WHERE x.module <> y.module GROUP BY 1")
def _(s, d):
    n, e = graph._graph(s, d)
    c = lookups.counts(e.where("confidence >= 0.7").withColumnRenamed("dst", "target"), "target").withColumn("ref_kind", F.lit("call"))
    j = e.join(n.select(F.col("id").alias("dst"), F.col("module").alias("m")), "dst").join(n.select(F.col("id").alias("src"), "module"), "src").where("m <> module")
    i = j.groupBy(F.col("dst").alias("target")).agg(F.countDistinct("module").alias("n")).withColumn("ref_kind", F.lit("import"))
    return c.select("target", "ref_kind", "n").unionByName(i.select("target", "ref_kind", "n"))


_IMPL = "t AS (SELECT repo_name, fqn FROM ch WHERE chunk_type IN ('interface', 'trait') AND fqn IS NOT NULL), im AS (SELECT t.repo_name, t.fqn AS type, c.id AS member FROM t JOIN ch c ON c.repo_name = t.repo_name AND c.parent_fqn = t.fqn WHERE c.chunk_type = 'method')"


@query("r24_find_implementations", f"WITH {D.CH}, {_IMPL} SELECT 'in' AS direction, repo_name, type AS symbol, member AS other, 1.0 AS confidence FROM im UNION ALL SELECT 'out', repo_name, member, type, 1.0 FROM im")
def _(s, d):
    i = graph.QUERIES["g7_implementations"](s, d)
    one = F.lit(1.0).cast("decimal(2,1)").alias("confidence")
    into = i.select(F.lit("in").alias("direction"), "repo_name", F.col("interface").alias("symbol"), F.col("implementor").alias("other"), one)
    return into.unionByName(i.select(F.lit("out").alias("direction"), "repo_name", F.col("implementor").alias("symbol"), F.col("interface").alias("other"), one))


# --- graph ----------------------------------------------------------------------


@query("g37_flow_trace", f"WITH RECURSIVE {D.ND}, {D.CA}, w AS (SELECT id AS flow, id AS node, 0 AS depth FROM nd WHERE kind = 'PROMO' UNION SELECT w.flow, ca.dst, w.depth + 1 FROM w JOIN ca ON ca.src = w.node WHERE ca.confidence >= 0.99 AND w.depth < 3) SELECT flow, node, min(depth) AS depth FROM w GROUP BY ALL")
def _(s, d):
    """Every flow's nodes with the fewest calls to them, three at most."""
    n, e = graph._graph(s, d)
    return gop.distances(graph._flow_starts(n), e.where("confidence >= 0.99"), 3).select(F.col("start").alias("flow"), "node", "depth")


@query("g41_impact_flows", f"WITH {D.ND}, {D.CA}, t AS (SELECT id FROM nd WHERE contains(name, '{graph.SYMBOL}')) SELECT DISTINCT ca.src AS flow, ca.dst AS target FROM ca JOIN t ON t.id = ca.dst JOIN nd ON nd.id = ca.src WHERE nd.kind = 'PROMO' AND ca.confidence >= 0.97")
def _(s, d):
    n, e = graph._graph(s, d)
    t = n.where(F.col("name").contains(graph.SYMBOL)).select(F.col("id").alias("dst"))
    return e.where("confidence >= 0.97").join(t, "dst", "left_semi").join(graph._flow_starts(n).select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("flow"), F.col("dst").alias("target")).distinct()


@query("g46_impact_fan_in", graph._IMPACT + " SELECT kind, hops, count(*) AS n FROM ip GROUP BY ALL")
def _(s, d):
    return lookups.counts(graph._impact_paths(s, d), "kind", "hops")


_REFS = "t AS (SELECT DISTINCT doc_id, position, unnest(regexp_extract_all(content, '`([A-Za-z_][A-Za-z0-9_:.]*)`', 1)) AS ref FROM se)"


@query("g57_document_explains", f"WITH {D.SE}, {_REFS} SELECT doc_id, count(DISTINCT ref) AS n_refs FROM t GROUP BY 1")
def _(s, d):
    t = D.sections(s, d).select("doc_id", F.explode(F.regexp_extract_all("content", F.lit("`([A-Za-z_][A-Za-z0-9_:.]*)`"), F.lit(1))).alias("ref"))
    return t.groupBy("doc_id").agg(F.countDistinct("ref").alias("n_refs"))


@query("g58_section_explains", f"WITH {D.SE}, {_REFS} SELECT doc_id, position, string_agg(ref, ',' ORDER BY ref) AS refs FROM t GROUP BY ALL")
def _(s, d):
    t = D.sections(s, d).select("doc_id", "position", F.explode(F.regexp_extract_all("content", F.lit("`([A-Za-z_][A-Za-z0-9_:.]*)`"), F.lit(1))).alias("ref")).distinct()
    return t.groupBy("doc_id", "position").agg(F.array_join(F.array_sort(F.collect_list("ref")), ",").alias("refs"))


# --- clusters and communities ---------------------------------------------------


@query("c6_section_embeddings", f"WITH {D.SE} SELECT se.doc_id, se.position, se.heading, len(e.embedding) AS width FROM se JOIN embeddings e ON e.vec_id = se.doc_id")
def _(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("width"))
    return D.sections(s, d).join(e, "doc_id").select("doc_id", "position", "heading", "width")


@query("c7_cluster_store", "SELECT 'cluster ' || label AS name, count(*) AS n_sections, min(vec_id) AS first FROM embeddings GROUP BY 1")
def _(s, d):
    """Clusters by name: a second delivery of a name replaces the first."""
    e = table(s, d, "embeddings").select(F.concat(F.lit("cluster "), "label").alias("name"), "vec_id")
    now = e.groupBy("name").agg(F.count(F.lit(1)).alias("n_sections"), F.min("vec_id").alias("first")).withColumn("at", F.lit(1))
    old = e.select("name").distinct().select("name", F.lit(0).cast("long").alias("n_sections"), F.lit(-1).cast("long").alias("first"), F.lit(0).alias("at"))
    return old.unionByName(now).groupBy("name").agg(F.max_by(F.struct("n_sections", "first"), "at").alias("r")).select("name", "r.*")


@query("c8_community_of_member", "SELECT vec_id AS member, CAST(label AS BIGINT) % 3 AS level, label AS community FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("member"), (F.col("label").cast("long") % 3).alias("level"), F.col("label").alias("community"))


@query("c9_max_summarised_level", "SELECT max(CAST(label AS BIGINT) % 3) FILTER (WHERE CAST(label AS BIGINT) % 2 = 0) AS level FROM embeddings")
def _(s, d):
    k = F.col("label").cast("long")
    return table(s, d, "embeddings").agg(F.max(F.when(k % 2 == 0, k % 3)).alias("level"))


@query("c10_community_examples", "SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3")
def _(s, d):
    return lookups.page(table(s, d, "embeddings").select("label", "vec_id"), ["vec_id"], 3, per=["label"]).select("label", "vec_id")


@query("c12_module_detail", f"WITH {D.MO}, {D.NO}, {graph._NF} SELECT mo.module_id, mo.path, mo.n_chunks, count(nf.id) AS n_notes FROM mo LEFT JOIN nf ON nf.repo_name = mo.repo_name AND nf.path = mo.path GROUP BY ALL")
def _(s, d):
    m = D.modules(D.chunks(s, d)).select("module_id", "repo_name", "path", "n_chunks")
    k = lookups.counts(graph._note_files(s, d), "repo_name", "path", name="n_notes")
    return m.join(k, ["repo_name", "path"], "left").select("module_id", "path", "n_chunks", F.coalesce("n_notes", F.lit(0)).alias("n_notes"))


# --- notes ----------------------------------------------------------------------


@query("n21_saga_card", f"WITH {D.SN} SELECT saga_id, string_agg(strftime(valid_at, '%Y-%m-%d') || ' ' || category, chr(10) ORDER BY valid_at, note_id) AS card FROM sn GROUP BY 1")
def _(s, d):
    line = F.concat_ws(" ", F.date_format("valid_at", "yyyy-MM-dd"), "category")
    g = D.saga_notes(s, d).groupBy("saga_id").agg(F.array_sort(F.collect_list(F.struct("valid_at", "note_id", line.alias("l")))).alias("ls"))
    return g.select("saga_id", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("card"))


_CRUD = f"{D.NO}, cd AS (SELECT id, title, substr(md5(id), 1, 1) AS h FROM no)"


@query("n24_note_changes", f"WITH {_CRUD} SELECT id, CASE WHEN h = '1' THEN 'new title' ELSE title END AS title FROM cd WHERE h <> '0' UNION ALL SELECT id || '-copy', title FROM cd WHERE h = '2'")
def _(s, d):
    """A change set on the notes: some deleted, some updated, some inserted; the last change of an id counts."""
    n = D.notes(s, d, ["title", "updated_at"]).select("id", "title")
    h = F.substring(F.md5("id"), 1, 1)
    changes = n.where(h == "0").select("id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("title"))
    changes = changes.unionByName(n.where(h == "1").select("id", F.lit("update").alias("op"), F.lit("new title").alias("title"))).unionByName(n.where(h == "2").select(F.concat("id", F.lit("-copy")).alias("id"), F.lit("insert").alias("op"), "title"))
    return cur.changed(n, changes, "id")


@query("n25_save_notes", more._NEAREST + " SELECT query AS id, CASE WHEN score >= 0.9 THEN 'rejected' WHEN score >= 0.7 THEN 'saved_with_warning' ELSE 'saved' END AS outcome FROM c")
def _(s, d):
    """Every hundredth note as if it were saved now: near copies are rejected."""
    v = more.QUERIES["n2_dedup_verdict"](s, d)
    return v.select(F.col("query").alias("id"), F.when(F.col("verdict") == "block", "rejected").when(F.col("verdict") == "warn", "saved_with_warning").otherwise("saved").alias("outcome"))


@query("n26_supersede", f"WITH {D.SU} SELECT sn.note_id, CAST(su.newer AS VARCHAR) AS superseded_by, su.newer IS NOT NULL AS invalid FROM sn LEFT JOIN su ON su.older = sn.note_id")
def _(s, d):
    n, e = D.saga_notes(s, d).select("note_id"), D.supersedes(s, d).select(F.col("older").alias("note_id"), F.col("newer").cast("string").alias("superseded_by"))
    return n.join(e, "note_id", "left").withColumn("invalid", F.col("superseded_by").isNotNull())


@query("n6_staleness_job", f"WITH {D.NO}, {D.CH}, r AS (SELECT DISTINCT id AS note, repo_name, trim(unnest(related_symbols)) AS name FROM no), m AS (SELECT note, count(*) AS missing FROM r WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.repo_name = r.repo_name AND ch.name = r.name) GROUP BY 1) SELECT no.id, coalesce(m.missing, 0) AS missing, least(1.0, 0.5 * coalesce(m.missing, 0)) AS score, coalesce(archived, false) OR (least(1.0, 0.5 * coalesce(m.missing, 0)) > 0.9 AND coalesce(access_count, 0) = 0) AS archived FROM no LEFT JOIN m ON m.note = no.id")
def _(s, d):
    """Scores all notes by their missing symbols, then archives what is stale and never read."""
    n = D.notes(s, d, ["repo_name", "related_symbols", "archived", "access_count", "updated_at"])
    r = n.select(F.col("id").alias("note"), "repo_name", F.explode("related_symbols").alias("x")).select("note", "repo_name", F.trim("x").alias("name")).where("name <> ''").distinct()
    m = r.join(D.chunks(s, d, ["repo_name", "name", "ingested_at"]).select("repo_name", "name"), ["repo_name", "name"], "left_anti").groupBy(F.col("note").alias("id")).agg(F.count(F.lit(1)).alias("missing"))
    j = n.join(m, "id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    j = j.withColumn("score", cur.staleness(F.col("missing"), F.lit(0.0)))
    return j.select("id", "missing", "score", (F.coalesce("archived", F.lit(False)) | ((F.col("score") > 0.9) & (F.coalesce("access_count", F.lit(0)) == 0))).alias("archived"))


@query("n29_staleness_reasons", f"WITH {D.NO}, {D.CH}, r AS (SELECT DISTINCT id AS note, repo_name, trim(unnest(related_symbols)) AS name FROM no) SELECT note AS id, string_agg('missing: ' || name, ',' ORDER BY name) AS reasons FROM r WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.repo_name = r.repo_name AND ch.name = r.name) GROUP BY 1")
def _(s, d):
    r = D.notes(s, d, ["repo_name", "related_symbols", "updated_at"]).select("id", "repo_name", F.explode("related_symbols").alias("x")).select("id", "repo_name", F.trim("x").alias("name")).where("name <> ''").distinct()
    m = r.join(D.chunks(s, d, ["repo_name", "name", "ingested_at"]).select("repo_name", "name"), ["repo_name", "name"], "left_anti")
    return m.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("missing: "), "name"))), ",").alias("reasons"))


# --- evaluation, snapshots, scalars ----------------------------------------------


@query("m2_provider_ranks", f"WITH {_ASKED}, o AS (SELECT q.query, round({_COS}, 6) AS own FROM qv q JOIN (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) e ON e.vec_id = q.query + 1), r AS (SELECT q.query, round({_COS}, 6) AS score FROM (SELECT embedding::DOUBLE[] AS x FROM embeddings) e, qv q) SELECT o.query, count(*) FILTER (WHERE r.score > o.own) AS rank FROM o JOIN r USING (query) GROUP BY 1")
def _(s, d):
    """Rank of every asked vector's own target, the next id: how many are strictly more similar."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    q = _asked(s, d)
    own = q.withColumn("vec_id", F.col("query") + 1).join(e, "vec_id").select("query", "v", F.round(cur.cosine(F.col("v"), F.col("embedding")), 6).alias("own"))
    r = e.join(F.broadcast(own), how="inner").select("query", (F.round(cur.cosine(F.col("v"), F.col("embedding")), 6) > F.col("own")).alias("better"))  # the stated query set
    return r.groupBy("query").agg(F.count_if("better").alias("rank"))


@query("m4_item_metrics", "SELECT doc_id, strlen(text) AS bytes, " + _TOK.replace("(t)", "(text)").replace("(t,", "(text,").replace(" + 50", "") + " AS tokens FROM documents WHERE text IS NOT NULL")
def _(s, d):
    t = table(s, d, "documents").where("text is not null")
    return t.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), fn.estimate_tokens(F.col("text")).alias("tokens"))


@query("o20_graph_snapshot", f"WITH {D.ND}, {D.CA} SELECT 'nodes' AS part, count(*) AS n FROM nd UNION ALL SELECT 'edges', count(*) FROM ca UNION ALL SELECT 'flows', count(*) FROM nd WHERE kind = 'PROMO'")
def _(s, d):
    """Exports nodes, edges and flows, and reads them again."""
    path = f"{shared_dir(s)}/lakeloom/graph-{uuid.uuid4().hex}"
    n, e = graph._graph(s, d)
    parts = {"nodes": n.withColumnRenamed("module", "repo_name"), "edges": e.withColumn("repo_name", F.col("method")), "flows": graph._flow_starts(n).withColumnRenamed("module", "repo_name")}
    snapshots.export(parts, path)
    out = None
    for p in parts:
        k = snapshots.restore(s, path, p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n")
        out = k if out is None else out.unionByName(k)
    return out


@query("s23_cosine_single", f"WITH {D.NO}, x AS (SELECT id, embedding::DOUBLE[] AS x FROM no WHERE len(embedding) = 48) SELECT id, round(CASE WHEN n * 1 < 1e-10 THEN 0 ELSE s / n END, 4) AS cosine FROM (SELECT id, list_inner_product(x, list_reverse(x)) AS s, list_inner_product(x, x) AS n FROM x)")
def _(s, d):
    """Each vector against itself reversed; a product of norms below 1e-10 gives 0."""
    n = D.notes(s, d, ["embedding", "updated_at"]).where(F.size("embedding") == 48)
    return n.select("id", F.round(cur.cosine(F.col("embedding"), F.reverse("embedding")), 4).alias("cosine"))


@query("s24_path_match", f"WITH {graph._LINK}, p AS (SELECT DISTINCT c1.path, q AS route, CASE WHEN p = q THEN 'exact' ELSE 'param' END AS via FROM c1 JOIN r1 ON len(string_split(p, '/')) = len(string_split(q, '/')) AND (p = q OR regexp_full_match(p, regexp_replace(regexp_replace(q, ':[^/]+', '[^/]+', 'g'), '\\{{[^/]*\\}}', '[^/]+', 'g')))) SELECT * FROM p")
def _(s, d):
    any_ = F.lit("ANY").alias("method")
    c = graph._call_sites(s, d).select("path").distinct().select(F.col("path").alias("id"), any_, "path")
    r = graph._routes(s, d).select(gop.normal_path(F.col("path")).alias("path")).distinct().select(F.col("path").alias("id"), any_, "path")
    return gop.link_calls(c, r).select(F.col("call").alias("path"), "route", F.col("matched_via").alias("via"))


@query("s25_method_match", f"WITH {graph._SITES}, a AS (SELECT DISTINCT method FROM cs), b AS (SELECT DISTINCT method AS route FROM rs) SELECT method, route, upper(method) = 'ANY' OR upper(route) = 'ANY' OR upper(method) = upper(route) AS fits FROM a, b")
def _(s, d):
    a, b = graph._call_sites(s, d).select("method").distinct(), graph._routes(s, d).select(F.col("method").alias("route")).distinct()
    up = F.upper("method"), F.upper("route")
    return a.join(F.broadcast(b), how="inner").withColumn("fits", (up[0] == "ANY") | (up[1] == "ANY") | (up[0] == up[1]))  # the methods of HTTP
