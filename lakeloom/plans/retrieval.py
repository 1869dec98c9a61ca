"""V, R, L: lexical and vector search, fusion, expansion, budget and links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import retrieval as op
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


_COS = "round(CASE WHEN list_inner_product(x, x) > 0 AND list_inner_product(q.v, q.v) > 0 THEN list_inner_product(x, q.v) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(q.v, q.v))) ELSE 0 END, 6)"


#: The stated query set: every hundredth note, by its digest.
ASKED = "substr(md5(id), 1, 2) < '03'"


def _vector(name: str, cte: str, rel: str, key: str, col: str, cond: str, rows, k: int = 10) -> None:
    """The vectors of every hundredth note, each against all rows."""
    ctes = D.NO if cte == D.NO else f"{D.NO}, {cte}"
    sql = f"""WITH {ctes}, q AS (SELECT id AS query, embedding::DOUBLE[] AS v FROM no WHERE len(embedding) = 48 AND {ASKED}),
r AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM (SELECT q.query, e.id, {_COS} AS score FROM (SELECT {key} AS id, {col}::DOUBLE[] AS x FROM {rel} WHERE len({col}) = 48 AND {cond}) e, q)) SELECT * FROM r WHERE rank < {k}"""

    @query(name, sql)
    def _(s, d):
        q = D.notes(s, d, ["embedding", "updated_at"]).where((F.size("embedding") == 48) & op.every_hundredth(F.col("id"))).select(F.col("id").alias("query"), F.col("embedding").alias("v"))
        r = rows(s, d).where(F.size(col) == 48)
        return op.nearest(r, q, key, col, k).select("query", F.col("key").alias("id"), "score", "rank")


_vector("v1_chunk_vectors", D.CH, "ch", "id", "embedding", "true", lambda s, d: D.chunks(s, d, ["embedding", "ingested_at"]))
_vector("v2_chunk_vectors_in_repo", D.CH, "ch", "id", "embedding", "repo_name = 'atlas-hub'", lambda s, d: D.chunks(s, d, ["repo_name", "embedding", "ingested_at"]).where("repo_name = 'atlas-hub'"))
_vector("v3_signature_vectors", D.CH, "ch", "id", "signature_embedding", "signature_embedding IS NOT NULL", lambda s, d: D.chunks(s, d, ["signature_embedding", "ingested_at"]))
_vector("v4_large_chunk_vectors", D.LC, "lc", "id", "embedding", "true", lambda s, d: D.large_chunks(s, d))
_vector("v5_note_vectors", D.NO, "no", "id", "embedding", "(archived IS NULL OR archived = false)", lambda s, d: D.notes(s, d, ["embedding", "archived", "updated_at"]).where("archived is null or archived = false"))
_vector("v7_scout_notes", D.NO, "no", "id", "embedding", "true", lambda s, d: D.notes(s, d, ["embedding", "updated_at"]))


def _terms(n: int = 8):
    return f"(VALUES {', '.join(f'({i}, {chr(39)}{t}{chr(39)})' for i, ts in enumerate(_QUERIES[:n]) for t in ts)}) AS t(query, term)"


#: Queries of the flagship search, as terms that must all occur (fixed values).
_QUERIES = [("chunk", "store"), ("rank", "fusion"), ("call", "graph"), ("token", "budget"), ("version", "compares"), ("note", "index"), ("cold", "start"), ("alert", "loop")]


def _query_terms(s):
    return s.createDataFrame([(i, t) for i, ts in enumerate(_QUERIES) for t in ts], "query int, term string")


def _lexical_sql(rel: str, key: str, text: str) -> str:
    return f"""qt AS (SELECT query, term FROM {_terms()}), tk AS (SELECT {key} AS key, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {rel}),
ln AS (SELECT key, count(*) AS len FROM tk GROUP BY 1), tf AS (SELECT key, term, count(*) AS tf FROM tk WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
ht AS (SELECT query, key, count(*) AS got, sum(1 + ln(tf)) AS s FROM tf JOIN qt ON qt.term = tf.term GROUP BY ALL),
lx AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) - 1 AS rank FROM (SELECT ht.query, ht.key, round(s / (1 + ln(len)), 6) AS score FROM ht JOIN ln ON ln.key = ht.key WHERE got = (SELECT count(*) FROM qt z WHERE z.query = ht.query)))"""


@query("v9_section_lexical", f"WITH {D.SE}, sx AS (SELECT doc_id * 10000 + position AS key, heading || ' ' || content AS body FROM se), {_lexical_sql('sx', 'key', 'body')} SELECT query, key, rank FROM lx WHERE rank < 10")
def _(s, d):
    x = D.sections(s, d).select((F.col("doc_id") * 10000 + F.col("position")).alias("key"), F.concat_ws(" ", "heading", "content").alias("body"))
    return op.lexical(x, _query_terms(s), "key", "body", 10).select("query", "key", "rank")


@query("v10_chunk_lexical", f"WITH {D.CH}, {_lexical_sql('ch', 'id', 'content')} SELECT query, key, rank FROM lx WHERE rank < 10")
def _(s, d):
    return op.lexical(D.chunks(s, d, ["content", "ingested_at"]), _query_terms(s), "id", "content", 10).select("query", "key", "rank")


@query("v11_note_lexical", f"WITH {D.NO}, nx AS (SELECT id, concat_ws(' ', title, summary, content, array_to_string(list_filter(facts, lambda x: x IS NOT NULL), ' '), array_to_string(list_filter(tags, lambda x: x IS NOT NULL), ' ')) AS body FROM no), {_lexical_sql('nx', 'id', 'body')} SELECT query, key, rank FROM lx WHERE rank < 10")
def _(s, d):
    n = D.notes(s, d).select("id", F.concat_ws(" ", "title", "summary", "content", F.array_join("facts", " "), F.array_join("tags", " ")).alias("body"))
    return op.lexical(n, _query_terms(s), "id", "body", 10).select("query", "key", "rank")


_HYBRID = f"""{_lexical_sql('documents', 'doc_id', 'text')}, q AS (SELECT CAST(vec_id AS INTEGER) AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 8),
vs AS (SELECT query, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) - 1 AS rank FROM (SELECT q.query, e.vec_id AS key, {_COS} AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) e, q)) WHERE rank < 10),
fu AS (SELECT query, key, round(sum(w), 9) AS rrf FROM (SELECT query, key, 0.4 / (60 + rank + 1) AS w FROM lx WHERE rank < 10 UNION ALL SELECT query, key, 0.6 / (60 + rank + 1) FROM vs) GROUP BY ALL)"""


def _fused(s, d):
    lx = op.lexical(table(s, d, "documents").select("doc_id", "text"), _query_terms(s), "doc_id", "text", 10)
    e = table(s, d, "embeddings")
    q = e.where("vec_id < 8").select(F.col("vec_id").cast("int").alias("query"), F.col("embedding").alias("v"))
    return op.fuse([(lx, 0.4), (op.nearest(e, q, "vec_id", "embedding", 10), 0.6)])


@query("r2_weighted_rrf", f"WITH {_HYBRID} SELECT query, key, rrf FROM fu")
def r2_weighted_rrf(s, d):
    """Documents by words and vectors, fused with weights 0.4 and 0.6."""
    return _fused(s, d)


@query("r8_hybrid_search", f"WITH {_HYBRID} SELECT query, key, rrf, rnk FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, key) AS rnk FROM fu) WHERE rnk <= 5")
def r8_hybrid_search(s, d):
    """The flagship: the five best documents of every query."""
    w = Window.partitionBy("query").orderBy(F.desc("rrf"), "key")
    return _fused(s, d).withColumn("rnk", F.row_number().over(w)).where("rnk <= 5")


@query("r4_cross_space", f"WITH {_HYBRID} SELECT f.query, f.key, round(CASE WHEN d.lang = 'de' THEN f.rrf * 1.5 ELSE f.rrf END, 9) AS rrf FROM fu f JOIN documents d ON d.doc_id = f.key")
def _(s, d):
    j = _fused(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("key"), "lang"), "key")
    return op.boosted(j, F.coalesce("lang", F.lit("")), "de").select("query", "key", F.round("rrf", 9).alias("rrf"))


@query("r6_query_signals", r"SELECT id, round(CASE WHEN n + dt + tk + ak = 0 THEN 0.1 ELSE least(1.0, 0.6 * n + 0.3 * dt + 0.5 * tk + 0.3 * ak) END, 6) AS confidence, round(CASE WHEN n + dt + tk + ak = 0 THEN 0.4 ELSE 0.6 * n + 0.3 * dt + 0.4 * tk - 0.3 * ak END, 6) AS lean FROM (SELECT id, CAST(regexp_matches(title, '[A-Z][a-z]+[A-Z]|[a-z]+_[a-z]+') AS INTEGER) AS n, CAST(regexp_matches(title, '\w(?:\.|::)\w') AS INTEGER) AS dt, CAST(contains(title, '`') AS INTEGER) AS tk, CAST(regexp_matches(title, '(?i)^(?:how|what|why|when|where|who|which)\b|\?\s*$') AS INTEGER) AS ak FROM " + f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM notes) WHERE rn = 1 AND title IS NOT NULL))")
def _(s, d):
    n = D.notes(s, d, ["title", "updated_at"]).where("title is not null")
    c, lean = op.rule_signal(F.col("title"))
    return n.select("id", F.round(c, 6).alias("confidence"), F.round(lean, 6).alias("lean"))


_TOK = "(CAST(length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) // 4 AS BIGINT) + 2 * (length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'))) + 50)"
_BUDGET = f"""WITH {_HYBRID}, co AS (SELECT fu.query, fu.key, fu.rrf, {_TOK} AS tokens FROM fu JOIN (SELECT doc_id, coalesce(text, '') AS t FROM documents) d ON d.doc_id = fu.key),
xs AS (SELECT query, list({{'c': tokens::BIGINT, 'k': key::BIGINT}} ORDER BY rrf DESC, key) AS l FROM co GROUP BY 1),
kp AS (SELECT query, list_reduce(l, lambda a, x: CASE WHEN a.used + x.c <= 600 THEN {{'used': a.used + x.c, 'kept': list_append(a.kept, x.k)}} ELSE a END, {{'used': 0::BIGINT, 'kept': []::BIGINT[]}}).kept AS kept FROM xs)"""


@query("r15_budget_prune", f"{_BUDGET} SELECT query, CAST(generate_subscripts(kept, 1) - 1 AS INTEGER) AS place, unnest(kept) AS key FROM kp")
def _(s, d):
    """The fused documents that fit 600 estimated tokens per query, greedily, skipping what does not fit."""
    from lakeloom.functions.text import estimate_tokens

    j = _fused(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("key"), (estimate_tokens(F.coalesce("text", F.lit(""))) + 50).alias("tokens")), "key")
    return op.within_budget(j, "query", [(-F.col("rrf")).alias("o"), F.col("key").alias("k")], "tokens", 600)


@query("r16_context", f"WITH {_HYBRID} SELECT query, string_agg(CAST(key AS VARCHAR), ',' ORDER BY rrf DESC, key) AS context FROM fu GROUP BY 1")
def _(s, d):
    g = _fused(s, d).groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("rrf")).alias("o"), "key"))).alias("xs"))
    return g.select("query", F.array_join(F.transform("xs", lambda x: x["key"].cast("string")), ",").alias("context"))


@query("r9_graph_expansion", f"""WITH {D.ND}, {D.CA}, s0 AS (SELECT id, 0 AS hop FROM nd WHERE contains(name, 'old rod')), h1 AS (SELECT DISTINCT ca.dst AS id FROM ca JOIN s0 ON s0.id = ca.src WHERE ca.confidence >= 0.97 AND ca.dst NOT IN (SELECT id FROM s0)),
h2 AS (SELECT DISTINCT ca.dst AS id FROM ca JOIN h1 ON h1.id = ca.src WHERE ca.confidence >= 0.97 AND ca.dst NOT IN (SELECT id FROM s0 UNION ALL SELECT id FROM h1)) SELECT id, hop FROM s0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def _(s, d):
    e = D.calls(s, d).where("confidence >= 0.97")
    seen = D.nodes(s, d).where(F.col("name").contains("old rod")).select("id", F.lit(0).alias("hop"))
    level = seen
    for hop in (1, 2):
        level = level.select(F.col("id").alias("src")).join(e, "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(level)
    return seen


@query("l1_explains_links", f"WITH {D.SE}, {D.CH}, t AS (SELECT DISTINCT doc_id, position, unnest(regexp_extract_all(content, '`([A-Za-z_][A-Za-z0-9_:.]*)`', 1)) AS ref FROM se) SELECT doc_id, position, id, 1.0 AS confidence FROM (SELECT t.doc_id, t.position, ch.id, row_number() OVER (PARTITION BY t.doc_id, t.position, t.ref ORDER BY ch.id) AS r FROM t JOIN ch ON ch.name = t.ref WHERE length(t.ref) >= 5) WHERE r <= 3")
def _(s, d):
    t = D.sections(s, d).select("doc_id", "position", F.explode(F.regexp_extract_all("content", F.lit("`([A-Za-z_][A-Za-z0-9_:.]*)`"), F.lit(1))).alias("name")).distinct().where(F.length("name") >= 5)
    j = t.join(D.chunks(s, d, ["name", "ingested_at"]).select("id", "name"), "name")
    r = F.row_number().over(Window.partitionBy("doc_id", "position", "name").orderBy("id"))
    return j.withColumn("r", r).where("r <= 3").select("doc_id", "position", "id", F.lit(1.0).cast("decimal(2,1)").alias("confidence"))


@query("l3_note_chunk_links", f"WITH {D.NO}, {D.CH}, r AS (SELECT DISTINCT id AS note, repo_name, trim(unnest(related_symbols)) AS sym FROM no) SELECT note, sym, id FROM (SELECT r.note, r.sym, ch.id, row_number() OVER (PARTITION BY r.note, r.sym ORDER BY ch.id) AS k FROM r JOIN ch ON ch.repo_name = r.repo_name AND ch.name = CASE WHEN contains(r.sym, '::') THEN regexp_extract(r.sym, '^(.*)::(.*?)$', 2) ELSE r.sym END WHERE NOT contains(r.sym, '::') OR contains(ch.module_path, regexp_extract(r.sym, '^(.*)::(.*?)$', 1))) WHERE k <= 10")
def _(s, d):
    r = D.notes(s, d, ["repo_name", "related_symbols", "updated_at"]).select(F.col("id").alias("note"), "repo_name", F.explode("related_symbols").alias("x")).select("note", "repo_name", F.trim("x").alias("sym")).distinct()
    scoped = F.col("sym").contains("::")
    r = r.withColumns({"name": F.when(scoped, F.regexp_extract("sym", "^(.*)::(.*?)$", 2)).otherwise(F.col("sym")), "scope": F.when(scoped, F.regexp_extract("sym", "^(.*)::(.*?)$", 1)).otherwise("")})
    j = r.join(D.chunks(s, d, ["repo_name", "name", "module_path", "ingested_at"]), ["repo_name", "name"]).where(F.col("module_path").contains(F.col("scope")))
    return j.withColumn("k", F.row_number().over(Window.partitionBy("note", "sym").orderBy("id"))).where("k <= 10").select("note", "sym", "id")
