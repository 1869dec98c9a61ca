"""Q: projections, filters, point and batch lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import lookups as op
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


@query("q1_chunk_detail", f"WITH {D.CH} SELECT id, repo_name, module_path, chunk_type, name, signature, fqn, start_line, end_line, strftime(ingested_at, '%Y-%m-%dT%H:%M:%SZ') AS ingested FROM ch")
def _(s, d):
    cols = ["repo_name", "module_path", "chunk_type", "name", "signature", "fqn", "start_line", "end_line", "ingested_at"]
    return D.chunks(s, d, cols).withColumn("ingested", op.iso("ingested_at")).drop("ingested_at")


@query("q2_module_chunks_page", f"WITH {D.CH} SELECT repo_name, module_path, id, chunk_type, name FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, module_path ORDER BY chunk_type, name, id) AS n FROM ch) WHERE n > 2 AND n <= 5")
def _(s, d):
    ch = D.chunks(s, d, ["repo_name", "module_path", "chunk_type", "name", "ingested_at"]).drop("ingested_at")
    return op.page(ch, ["chunk_type", "name", "id"], 3, 2, per=["repo_name", "module_path"])


@query("q3_module_chunks", f"WITH {D.CH} SELECT id, chunk_type, name FROM ch WHERE repo_name = 'atlas-hub' AND module_path = (SELECT min(module_path) FROM chunks WHERE repo_name = 'atlas-hub') ORDER BY chunk_type, name, id")
def _(s, d):
    ch = op.only(D.chunks(s, d, ["repo_name", "module_path", "chunk_type", "name", "ingested_at"]), repo_name="atlas-hub")
    first = ch.agg(F.min("module_path")).first()[0]
    return op.only(ch, module_path=first).orderBy("chunk_type", "name", "id").select("id", "chunk_type", "name")


@query("q4_count_chunks", "SELECT repo_name, count(DISTINCT id) AS n FROM chunks GROUP BY 1")
def _(s, d):
    return op.counts(table(s, d, "chunks").select("repo_name", "id").distinct(), "repo_name")


@query("q5_language_distribution", f"WITH {D.CH}, g AS (SELECT repo_name, language, count(*) AS n FROM ch WHERE language IS NOT NULL GROUP BY ALL) SELECT repo_name, language, n FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY n DESC, language) AS r FROM g) WHERE r <= 3")
def _(s, d):
    ch = D.chunks(s, d, ["repo_name", "language", "ingested_at"]).where("language is not null")
    return op.largest(op.counts(ch, "repo_name", "language"), ["repo_name"], "n", "language", 3)


@query("q6_max_ingested_at", "SELECT repo_name, strftime(max(ingested_at), '%Y-%m-%dT%H:%M:%SZ') AS newest FROM chunks GROUP BY 1")
def _(s, d):
    return table(s, d, "chunks").groupBy("repo_name").agg(op.iso(F.max("ingested_at")).alias("newest"))


@query("q7_symbol_counts", f"WITH {D.CH} SELECT repo_name, name, count(*) AS n FROM ch GROUP BY ALL")
def _(s, d):
    return op.counts(D.chunks(s, d, ["repo_name", "name", "ingested_at"]), "repo_name", "name")


_REF = "(SELECT DISTINCT lower(trim(x)) AS id FROM (SELECT unnest(chunk_ids) AS x FROM large_chunks) WHERE x IS NOT NULL)"


def _refs(s, d):
    return table(s, d, "large_chunks").select(F.explode("chunk_ids").alias("x")).select(F.lower(F.trim("x")).alias("id")).where("id is not null").distinct()


def _batch(name: str, cols: list[str]):
    sql = f"WITH {D.CH} SELECT id, {', '.join(cols)} FROM ch WHERE id IN (SELECT id FROM {_REF})"

    @query(name, sql)
    def _(s, d):
        ch = table(s, d, "chunks").select("id", "ingested_at", *cols)
        return op.latest(op.among(ch, _refs(s, d)), ["id"], "ingested_at", "id").select("id", *cols)


_batch("q8_definitions", ["name", "signature", "fqn", "module_path"])
_batch("q9_chunk_content", ["content"])
_batch("q15_chunk_module_batch", ["repo_name", "module_path"])
_batch("q16_chunk_meta_batch", ["name", "chunk_type", "module_path"])
_batch("q17_chunk_full_batch", ["repo_name", "module_path", "chunk_type", "name", "signature", "content", "language", "fqn", "doc"])


@query("q10_large_chunk_content", f"WITH {D.LC} SELECT id, repo_name, module_path, content, CAST(len(chunk_ids) AS INTEGER) AS n_parts FROM lc")
def _(s, d):
    return D.large_chunks(s, d).select("id", "repo_name", "module_path", "content", F.size("chunk_ids").alias("n_parts"))


@query("q11_resolution_scan", f"WITH {D.CH} SELECT id, repo_name, name, module_path, chunk_type, fqn, parent_fqn, signature FROM ch")
def _(s, d):
    return D.chunks(s, d, ["repo_name", "name", "module_path", "chunk_type", "fqn", "parent_fqn", "signature", "ingested_at"]).drop("ingested_at")


@query("q12_go_chunks", f"WITH {D.CH} SELECT id, repo_name, name, chunk_type, module_path FROM ch WHERE language = 'go' AND chunk_type IN ('type', 'struct', 'interface', 'method')")
def _(s, d):
    ch = D.chunks(s, d, ["repo_name", "name", "chunk_type", "module_path", "language", "ingested_at"])
    return op.only(ch, language="go").where(F.col("chunk_type").isin("type", "struct", "interface", "method")).drop("language", "ingested_at")


@query("q13_entry_point_scan", f"WITH {D.CH} SELECT id, name, module_path, content, language FROM ch WHERE chunk_type IN ('function', 'method')")
def _(s, d):
    return D.chunks(s, d, ["name", "module_path", "content", "language", "chunk_type", "ingested_at"]).where("chunk_type in ('function', 'method')").drop("chunk_type", "ingested_at")


@query("q14_chunks_per_module", f"WITH {D.CH} SELECT repo_name, module_path, count(*) AS n FROM ch WHERE (repo_name, module_path) IN (SELECT repo_name, module_path FROM large_chunks) GROUP BY ALL")
def _(s, d):
    wanted = table(s, d, "large_chunks").select("repo_name", "module_path").distinct()
    ch = table(s, d, "chunks").select("repo_name", "module_path", "id").distinct().join(wanted, ["repo_name", "module_path"], "left_semi")
    return op.counts(ch, "repo_name", "module_path")


_SYMBOL = "(SELECT min(name) FROM (SELECT name FROM chunks WHERE chunk_type = 'method' GROUP BY name HAVING count(DISTINCT id) > 1))"


def _symbol(s, d):
    many = table(s, d, "chunks").where("chunk_type = 'method'").groupBy("name").agg(F.countDistinct("id").alias("n"))
    return many.where("n > 1").agg(F.min("name")).first()[0] or ""


@query("q18_symbol_candidates", f"WITH {D.CH}, p AS (SELECT {_SYMBOL} AS name) SELECT ch.id, ch.name, ch.fqn, ch.module_path FROM ch, p WHERE ch.fqn = p.name OR ends_with(ch.fqn, '.' || p.name) OR ch.name = p.name ORDER BY id LIMIT 50")
def _(s, d):
    return op.symbol_candidates(D.chunks(s, d), _symbol(s, d)).select("id", "name", "fqn", "module_path")


@query("r21_goto_definition", f"""WITH {D.CH}, p AS (SELECT {_SYMBOL} AS name), c AS (SELECT ch.*, p.name AS wanted FROM ch, p WHERE ch.fqn = p.name OR ends_with(ch.fqn, '.' || p.name) OR ch.name = p.name ORDER BY id LIMIT 50),
r AS (SELECT *, CASE WHEN fqn = wanted THEN 3 WHEN ends_with(fqn, '.' || wanted) THEN 2 WHEN name = wanted THEN 1 ELSE 0 END AS precision,
 CASE WHEN contains(lower(coalesce(visibility, '')), 'public') OR contains(lower(coalesce(visibility, '')), 'export') THEN 4 WHEN contains(lower(coalesce(visibility, '')), 'crate') THEN 3 WHEN contains(lower(coalesce(visibility, '')), 'protected') THEN 2 WHEN contains(lower(coalesce(visibility, '')), 'private') THEN 1 ELSE 0 END AS visible FROM c)
SELECT id, fqn, module_path, precision, visible, row_number() OVER (ORDER BY precision DESC, visible DESC, module_path, fqn NULLS FIRST, id) AS place FROM r""")
def _(s, d):
    name = _symbol(s, d)
    return op.rank_candidates(op.symbol_candidates(D.chunks(s, d), name), name).select("id", "fqn", "module_path", "precision", "visible", "place")


@query("q19_enrich_by_fqn", f"WITH {D.CH} SELECT DISTINCT n.id AS note_id, r.s AS fqn, first(ch.id ORDER BY ch.id DESC) OVER (PARTITION BY n.id, r.s) AS chunk_id FROM no n, LATERAL (SELECT unnest(n.related_symbols) AS s) r JOIN ch ON ch.fqn = r.s".replace("WITH ", f"WITH {D.NO}, "))
def _(s, d):
    refs = D.notes(s, d).select(F.col("id").alias("note_id"), F.explode("related_symbols").alias("fqn")).distinct()
    last = D.chunks(s, d, ["fqn", "ingested_at"]).groupBy("fqn").agg(F.max("id").alias("chunk_id"))
    return refs.join(last, "fqn").select("note_id", "fqn", "chunk_id")


@query("q20_enrich_by_fqn_and_repo", f"WITH {D.NO}, {D.CH}, m AS (SELECT repo_name, fqn, max(id) AS chunk_id FROM ch GROUP BY ALL), r AS (SELECT DISTINCT id AS note_id, repo_name, unnest(related_symbols) AS fqn FROM no) SELECT r.note_id, r.repo_name, r.fqn, m.chunk_id FROM r LEFT JOIN m ON m.repo_name = r.repo_name AND m.fqn = r.fqn")
def _(s, d):
    refs = D.notes(s, d).select(F.col("id").alias("note_id"), "repo_name", F.explode("related_symbols").alias("fqn")).distinct()
    last = D.chunks(s, d, ["repo_name", "fqn", "ingested_at"]).groupBy("repo_name", "fqn").agg(F.max("id").alias("chunk_id"))
    return refs.join(last, ["repo_name", "fqn"], "left").select("note_id", "repo_name", "fqn", "chunk_id")


@query("q21_ids_by_name", f"WITH {D.CH} SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM ch WHERE length(name) >= 5) WHERE r <= 3")
def _(s, d):
    ch = D.chunks(s, d, ["name", "ingested_at"]).where(F.length("name") >= 5)
    return op.page(ch, ["id"], 3, per=["name"]).select("name", "id")


@query("q22_ids_by_name_and_module", f"WITH {D.NO}, {D.CH}, r AS (SELECT DISTINCT n.repo_name, regexp_extract(trim(x), '^(.*)::(.*?)$', 1) AS parent, regexp_extract(trim(x), '^(.*)::(.*?)$', 2) AS name FROM (SELECT repo_name, unnest(related_symbols) AS x FROM no) n WHERE contains(x, '::')) SELECT r.repo_name, r.parent, r.name, ch.id FROM r JOIN ch ON ch.repo_name = r.repo_name AND ch.name = r.name AND contains(ch.module_path, r.parent)")
def _(s, d):
    sym = F.trim(F.col("x"))
    refs = D.notes(s, d).select("repo_name", F.explode("related_symbols").alias("x")).where(F.col("x").contains("::"))
    refs = refs.select("repo_name", F.regexp_extract(sym, r"^(.*)::(.*?)$", 1).alias("parent"), F.regexp_extract(sym, r"^(.*)::(.*?)$", 2).alias("name")).distinct()
    ch = D.chunks(s, d, ["repo_name", "name", "module_path", "ingested_at"])
    return refs.join(ch, ["repo_name", "name"]).where(F.col("module_path").contains(F.col("parent"))).select("repo_name", "parent", "name", "id")


@query("q23_ids_by_name_in_repo", f"WITH {D.CH} SELECT repo_name, name, min(id) AS id, count(*) AS n FROM ch GROUP BY repo_name, name")
def _(s, d):
    return D.chunks(s, d, ["repo_name", "name", "ingested_at"]).groupBy("repo_name", "name").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


@query("q24_modules_by_fragment", f"WITH {D.MO} SELECT path, module_id FROM mo WHERE contains(path, 'services/') ORDER BY path, module_id LIMIT 20")
def _(s, d):
    return D.modules(D.chunks(s, d)).where(F.col("path").contains("services/")).orderBy("path", "module_id").limit(20).select("path", "module_id")


@query("q25_list_modules", f"WITH {D.MO} SELECT repo_name, path, language, n_chunks, exports_count FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY path) AS r FROM mo) WHERE r > 5 AND r <= 15")
def _(s, d):
    return op.page(D.modules(D.chunks(s, d)), ["path"], 10, 5, per=["repo_name"]).drop("module_id")


@query("q26_module_count", f"WITH {D.MO} SELECT repo_name, count(*) AS n FROM mo GROUP BY 1")
def _(s, d):
    return op.counts(D.modules(D.chunks(s, d)), "repo_name")


@query("q27_module_detail", f"WITH {D.MO} SELECT * FROM mo")
def _(s, d):
    return D.modules(D.chunks(s, d))


@query("q28_module_summary", f"WITH {D.MO} SELECT module_id, path || ' (' || exports_count || ' exports)' AS summary FROM mo")
def _(s, d):
    return D.modules(D.chunks(s, d)).select("module_id", F.format_string("%s (%d exports)", "path", "exports_count").alias("summary"))


@query("q29_resolve_module_paths", f"WITH {D.MO}, {D.NO}, r AS (SELECT DISTINCT repo_name, unnest(related_files) AS path FROM no) SELECT r.repo_name, r.path, mo.module_id FROM r JOIN mo ON mo.repo_name = r.repo_name AND mo.path = r.path")
def _(s, d):
    refs = D.notes(s, d).select("repo_name", F.explode("related_files").alias("path")).distinct()
    return refs.join(D.modules(D.chunks(s, d)).select("repo_name", "path", "module_id"), ["repo_name", "path"])


@query("q30_module_meta_batch", f"WITH {D.MO}, {D.LC} SELECT module_id, path, language FROM mo WHERE (repo_name, path) IN (SELECT repo_name, module_path FROM lc)")
def _(s, d):
    wanted = table(s, d, "large_chunks").select("repo_name", F.col("module_path").alias("path")).distinct()
    return D.modules(D.chunks(s, d)).join(wanted, ["repo_name", "path"], "left_semi").select("module_id", "path", "language")


@query("q32_module_path_and_repo", f"WITH {D.MO} SELECT module_id, path, repo_name FROM mo")
def _(s, d):
    return D.modules(D.chunks(s, d)).select("module_id", "path", "repo_name")


@query("q33_upsert_module", f"WITH {D.MO}, nw AS (SELECT repo_name, module_path AS path, count(*) AS n_chunks FROM lc GROUP BY ALL) SELECT repo_name, path, n_chunks FROM nw UNION ALL SELECT repo_name, path, n_chunks FROM mo WHERE (repo_name, path) NOT IN (SELECT repo_name, path FROM nw)".replace("WITH ", f"WITH {D.LC}, "))
def _(s, d):
    new = D.large_chunks(s, d).groupBy("repo_name", F.col("module_path").alias("path")).agg(F.count(F.lit(1)).alias("n_chunks"))
    return op.upsert(D.modules(D.chunks(s, d)).select("repo_name", "path", "n_chunks"), new, ["repo_name", "path"])


@query("q34_document_by_id", "SELECT doc_id, source, doc_path, repo_name, coalesce(n_chars, -1) AS n_chars FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", "source", "doc_path", "repo_name", F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))


@query("q35_document_by_source", "SELECT repo_name, doc_path, max(doc_id) AS doc_id FROM documents WHERE doc_path IS NOT NULL GROUP BY ALL")
def _(s, d):
    return table(s, d, "documents").where("doc_path is not null").groupBy("repo_name", "doc_path").agg(F.max("doc_id").alias("doc_id"))


@query("q36_sections_by_doc", f"WITH {D.SE} SELECT doc_id, position, depth, heading, length(content) AS n_chars FROM se")
def _(s, d):
    return D.sections(s, d).select("doc_id", "position", "depth", "heading", F.length("content").cast("long").alias("n_chars"))


@query("q37_sections_by_topic", f"WITH {D.SE}, k AS (SELECT doc_id, position, heading, split_part(heading, ' ', 1) AS topic FROM se) SELECT topic, doc_id, position, heading FROM k WHERE topic IN (SELECT topic FROM k GROUP BY 1 HAVING count(*) > 1)")
def _(s, d):
    k = D.sections(s, d).select("doc_id", "position", "heading", F.split_part("heading", F.lit(" "), F.lit(1)).alias("topic"))
    return k.join(op.counts(k, "topic").where("n > 1").select("topic"), "topic", "left_semi").select("topic", "doc_id", "position", "heading")


@query("q38_sections_per_doc", f"WITH {D.SE} SELECT doc_id, count(*) AS n FROM se GROUP BY 1")
def _(s, d):
    return op.counts(D.sections(s, d), "doc_id")


@query("q39_source_urls", "SELECT id, repo_name, coalesce(seed_url, git_url) AS url FROM sources")
def _(s, d):
    return table(s, d, "sources").select("id", "repo_name", F.coalesce("seed_url", "git_url").alias("url"))


@query("q40_section_detail", f"WITH {D.SE} SELECT se.doc_id, se.position, se.heading, t.source, t.repo_name FROM se JOIN documents t ON t.doc_id = se.doc_id")
def _(s, d):
    return D.sections(s, d).join(table(s, d, "documents").select("doc_id", "source", "repo_name"), "doc_id").select("doc_id", "position", "heading", "source", "repo_name")


@query("q41_section_content", f"WITH {D.SE} SELECT doc_id, position, content FROM se")
def _(s, d):
    return D.sections(s, d).select("doc_id", "position", "content")


@query("q42_sections_for_relink", f"WITH {D.SE} SELECT t.repo_name, count(*) AS n_sections, count(DISTINCT se.doc_id) AS n_docs FROM se JOIN documents t ON t.doc_id = se.doc_id GROUP BY 1")
def _(s, d):
    j = D.sections(s, d).join(table(s, d, "documents").select("doc_id", "repo_name"), "doc_id")
    return j.groupBy("repo_name").agg(F.count(F.lit(1)).alias("n_sections"), F.countDistinct("doc_id").alias("n_docs"))


@query("q43_unified_details", f"""WITH {D.CH}, {D.LC}, {D.NO}, rq AS (SELECT row_number() OVER (ORDER BY lc.id, g.i) AS pos, lc.chunk_ids[g.i] AS id FROM lc, LATERAL (SELECT unnest(range(1, len(chunk_ids) + 1)) AS i) g),
f AS (SELECT id, min(pos) AS first FROM rq GROUP BY 1), k AS (SELECT id, 'chunk' AS kind, name AS title FROM ch UNION ALL SELECT id, 'note', title FROM no)
SELECT rq.pos, rq.id, CASE WHEN rq.pos = f.first AND k.id IS NOT NULL THEN k.kind ELSE 'Not found' END AS kind, CASE WHEN rq.pos = f.first AND k.id IS NOT NULL THEN k.title END AS title
FROM rq JOIN f ON f.id IS NOT DISTINCT FROM rq.id LEFT JOIN k ON k.id = rq.id WHERE rq.id IS NOT NULL""")
def _(s, d):
    parts = D.large_chunks(s, d).select("id", F.posexplode("chunk_ids").alias("i", "x"))
    # Ranks without one sorted task: counts per id first, then a window over the counts' running sum.
    sizes = parts.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    start = _running(s, sizes)
    rq = parts.join(start, "id").select((F.col("start") + F.col("i") + 1).alias("pos"), F.col("x").alias("id")).where("id is not null")
    ch = D.chunks(s, d, ["name", "ingested_at"]).select("id", F.lit("chunk").alias("kind"), F.col("name").alias("title"))
    no = D.notes(s, d, ["title", "updated_at"]).select("id", F.lit("note").alias("kind"), "title")
    return op.details(rq, ch, no)


def _running(s, sizes, buckets: int = 256):
    """Sum of ``n`` over all smaller ids, by ranges of ids: only one row per range is in one task."""
    w = sizes.withColumn("range", F.substring("id", 1, 2))
    from pyspark.sql import Window

    per = w.groupBy("range").agg(F.sum("n").alias("total"))
    base = per.withColumn("base", F.sum("total").over(Window.orderBy("range")) - F.col("total")).select("range", "base")
    inner = F.sum("n").over(Window.partitionBy("range").orderBy("id")) - F.col("n")
    return w.withColumn("inner", inner).join(F.broadcast(base), "range").select("id", (F.col("base") + F.col("inner")).alias("start"))


@query("q44_notes_page", f"WITH {D.NO}, t AS (SELECT repo_name, count(*) AS total FROM no GROUP BY 1) SELECT p.repo_name, p.id, t.total FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY created_at DESC, id) AS r FROM no) p JOIN t ON t.repo_name = p.repo_name WHERE r <= 5")
def _(s, d):
    n = D.notes(s, d, ["repo_name", "created_at", "updated_at"])
    return op.page(n, [F.desc("created_at"), "id"], 5, per=["repo_name"]).join(op.counts(n, "repo_name", name="total"), "repo_name").select("repo_name", "id", "total")


@query("q45_note_by_id", f"WITH {D.NO} SELECT id, title, category, invalid_at IS NOT NULL AS is_superseded, superseded_by FROM no")
def _(s, d):
    return D.notes(s, d).select("id", "title", "category", F.col("invalid_at").isNotNull().alias("is_superseded"), "superseded_by")


@query("q46_notes_full_batch", f"WITH {D.NO} SELECT id, title, content, author FROM no WHERE id IN (SELECT superseded_by FROM notes WHERE superseded_by IS NOT NULL)")
def _(s, d):
    n = D.notes(s, d)
    return op.among(n, table(s, d, "notes").where("superseded_by is not null"), "id", "superseded_by").select("id", "title", "content", "author")


@query("q47_latest_notes", f"WITH {D.NO} SELECT repo_name, id, left(content, 120) AS brief FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY created_at DESC, id) AS r FROM no) WHERE r <= 3")
def _(s, d):
    return op.page(D.notes(s, d), [F.desc("created_at"), "id"], 3, per=["repo_name"]).select("repo_name", "id", F.substring("content", 1, 120).alias("brief"))
