"""S, X, E: scalar functions, extraction and edge resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import text as fn
from lakeloom.operators import extract, lookups
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


_SLUG = r"replace(regexp_replace(lower(heading), '[^\p{L}\p{N}\p{M}_\- ]', '', 'g'), ' ', '-')"


@query("s1_github_slug", f"WITH {D.SE} SELECT doc_id, position, {_SLUG} AS slug FROM se")
def _(s, d):
    return D.sections(s, d).select("doc_id", "position", fn.github_slug(F.col("heading")).alias("slug"))


@query("s2_slug_counter", f"WITH {D.SE}, g AS (SELECT doc_id, position, {_SLUG} AS slug FROM se), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY position) - 1 AS k FROM g) SELECT doc_id, position, CASE WHEN k = 0 THEN slug ELSE slug || '-' || k END AS slug FROM r")
def _(s, d):
    g = D.sections(s, d).withColumn("slug", fn.github_slug(F.col("heading")))
    k = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("position")) - 1
    return g.withColumn("k", k).select("doc_id", "position", F.when(F.col("k") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", "k")).alias("slug"))


@query("s14_skill_name", "SELECT repo_name, regexp_replace(left(regexp_replace(regexp_replace(lower(repo_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), '-+$', '') AS skill FROM sources")
def _(s, d):
    return table(s, d, "sources").select("repo_name", fn.skill_name(F.col("repo_name")).alias("skill"))


@query("s17_stamp", "SELECT DISTINCT id, left(git_ref, 7) AS stamp FROM chunks WHERE git_ref IS NOT NULL")
def _(s, d):
    return table(s, d, "chunks").where("git_ref is not null").select("id", F.substring("git_ref", 1, 7).alias("stamp")).distinct()


@query("s18_issue_of_branch", f"WITH {D.NO} SELECT id, CASE WHEN regexp_full_match(branch, 'wp/[A-Z]+/[0-9]+') THEN regexp_replace(substr(branch, 4), '/', '-') END AS issue FROM no")
def _(s, d):
    from lakeloom.operators.curation import issue_of_branch

    return D.notes(s, d).select("id", issue_of_branch(F.col("branch")).alias("issue"))


@query("s19_reingest_ref", f"WITH {D.NO} SELECT id, coalesce(nullif(trim(branch), ''), nullif(trim(author), ''), '') AS ref FROM no")
def _(s, d):
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return D.notes(s, d).select("id", F.coalesce(blank("branch"), blank("author"), F.lit("")).alias("ref"))


@query("s20_array_to_string", f"WITH {D.NO} SELECT id, array_to_string(list_filter(tags, lambda x: x IS NOT NULL), ' ') AS tags FROM no")
def _(s, d):
    return D.notes(s, d).select("id", F.array_join("tags", " ").alias("tags"))


@query("s21_token_estimate", r"SELECT doc_id, CAST(floor(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 4.0) + 2 * (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", fn.estimate_tokens(F.col("text")).alias("tokens"))


@query("s27_visibility_rank", f"WITH {D.CH} SELECT id, CASE WHEN contains(lower(coalesce(visibility, '')), 'public') OR contains(lower(coalesce(visibility, '')), 'export') THEN 4 WHEN contains(lower(coalesce(visibility, '')), 'crate') THEN 3 WHEN contains(lower(coalesce(visibility, '')), 'protected') THEN 2 WHEN contains(lower(coalesce(visibility, '')), 'private') THEN 1 ELSE 0 END AS rank FROM ch")
def _(s, d):
    return D.chunks(s, d, ["visibility", "ingested_at"]).select("id", lookups.visibility_rank().alias("rank"))


@query("s28_iso_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", lookups.iso("ts").alias("iso"))


@query("s29_split_part", "SELECT repo_name, split_part(repo_name, '-', 1) AS head, left(repo_name, 3) AS three, length(repo_name) AS n FROM sources")
def _(s, d):
    return table(s, d, "sources").select("repo_name", F.split_part("repo_name", F.lit("-"), F.lit(1)).alias("head"), F.substring("repo_name", 1, 3).alias("three"), F.length("repo_name").cast("long").alias("n"))


@query("s30_answer_recall", f"WITH {D.NO}, f AS (SELECT DISTINCT id, unnest(facts) AS fact FROM no), g AS (SELECT f.id, avg(CASE WHEN contains(trim(regexp_replace(lower(coalesce(no.content, '')), '\\s+', ' ', 'g')), trim(regexp_replace(lower(f.fact), '\\s+', ' ', 'g'))) THEN 1.0 ELSE 0 END) AS r FROM f JOIN no ON no.id = f.id WHERE f.fact IS NOT NULL GROUP BY 1) SELECT no.id, round(coalesce(g.r, 1.0), 6) AS recall FROM no LEFT JOIN g ON g.id = no.id")
def _(s, d):
    n = D.notes(s, d)
    f = n.select("id", "content", F.explode("facts").alias("fact")).where("fact is not null").distinct()
    has = fn.normal_text(F.coalesce("content", F.lit(""))).contains(fn.normal_text(F.col("fact")))
    g = f.groupBy("id").agg(F.avg(F.when(has, 1.0).otherwise(0.0)).alias("r"))
    return n.select("id").join(g, "id", "left").select("id", F.round(F.coalesce("r", F.lit(1.0)), 6).alias("recall"))


# --- extraction -----------------------------------------------------------------


_BASE = "lower(regexp_extract(path, '([^/]*)$', 1))"
_PRIORITY = f"CASE WHEN {_BASE} IN {fn.MANIFESTS} OR {_BASE} LIKE '%.md' OR {_BASE} LIKE '%.rst' THEN 1 WHEN {_BASE} LIKE '%.h' OR {_BASE} LIKE '%.hpp' OR {_BASE} LIKE '%.d.ts' THEN 2 WHEN {_BASE} IN {fn.ENTRIES} THEN 3 ELSE 4 END"


@query("x2_file_priority", f"WITH {D.MO} SELECT repo_name, path, {_PRIORITY} AS priority FROM mo")
def _(s, d):
    return D.modules(D.chunks(s, d)).select("repo_name", "path", fn.file_priority(F.col("path")).alias("priority"))


@query("x3_extractor", f"WITH {D.MO} SELECT repo_name, path, CASE " + " ".join(f"WHEN ends_with(lower(path), '{e}') THEN '{x}'" for e, x in fn.EXTRACTORS) + " ELSE 'fallback' END AS extractor FROM mo")
def _(s, d):
    return D.modules(D.chunks(s, d)).select("repo_name", "path", fn.extractor(F.col("path")).alias("extractor"))


@query("x4_directories", f"WITH {D.MO} SELECT repo_name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, count(*) AS n_files FROM mo GROUP BY ALL")
def _(s, d):
    m = D.modules(D.chunks(s, d)).withColumn("directory", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    return lookups.counts(m, "repo_name", "directory", name="n_files")


@query("x5_size_filter", f"WITH {D.CH} SELECT id, strlen(content) AS bytes FROM ch WHERE strlen(content) >= 50")
def _(s, d):
    return D.chunks(s, d, ["content", "ingested_at"]).where(F.octet_length("content") >= 50).select("id", F.octet_length("content").cast("long").alias("bytes"))


@query("x7_prefix_groups", f"WITH {D.MO}, p AS (SELECT repo_name, path, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^[^_.-]*', 0) AS prefix FROM mo), k AS (SELECT repo_name, prefix, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT repo_name, prefix AS big FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY n DESC, prefix) AS r FROM k) WHERE r = 1) SELECT p.repo_name, p.path, CASE WHEN k.n > 1 THEN p.prefix ELSE b.big END AS grp FROM p JOIN k ON k.repo_name = p.repo_name AND k.prefix = p.prefix JOIN b ON b.repo_name = p.repo_name")
def _(s, d):
    p = D.modules(D.chunks(s, d)).select("repo_name", "path", F.regexp_extract(F.regexp_extract("path", "([^/]*)$", 1), "^[^_.-]*", 0).alias("prefix"))
    k = lookups.counts(p, "repo_name", "prefix")
    b = k.groupBy("repo_name").agg(F.min_by("prefix", F.struct(-F.col("n"), "prefix")).alias("big"))
    return p.join(k, ["repo_name", "prefix"]).join(b, "repo_name").select("repo_name", "path", F.when(F.col("n") > 1, F.col("prefix")).otherwise(F.col("big")).alias("grp"))


@query("x9_python_chunks")
def _(s, d):
    """Functions and classes of the Python sources, by their syntax tree."""
    return extract.python_chunks(table(s, d, "chunks").where("chunk_type = 'file' and module_path like '%.py'").select("id", "content").distinct())


_IMPORT = extract.IMPORT.replace("'", "''")
_IM = "(SELECT DISTINCT id, module_path, content FROM chunks WHERE chunk_type = 'file')"
_TARGET = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{_IMPORT}', {i}), '')" for i in range(1, 8)) + ")"
_IMPORTS = f"im AS (SELECT DISTINCT id, module_path, {_TARGET} AS target FROM (SELECT id, module_path, unnest(regexp_extract_all(content, '{_IMPORT}', 0)) AS line FROM {_IM}) WHERE {_TARGET} IS NOT NULL)"


@query("x13_import_edges", f"WITH {_IMPORTS} SELECT * FROM im")
def _(s, d):
    return extract.imports(table(s, d, "chunks").where("chunk_type = 'file'").select("id", "module_path", "content").distinct())


_CALL = r"(?:[A-Za-z_]\w*(?:\.|::|->))?[A-Za-z_]\w*\s?\("
_CALL_OF = r"^(?:([A-Za-z_]\w*)(?:\.|::|->))?([A-Za-z_]\w*)\s?\($"
_CALLS = f"""cl AS (SELECT id, callee, receiver, count(*) AS n FROM (SELECT id, name, regexp_extract(c, '{_CALL_OF}', 2) AS callee, regexp_extract(c, '{_CALL_OF}', 1) AS receiver
  FROM (SELECT id, name, unnest(regexp_extract_all(content, '{_CALL}')) AS c FROM (SELECT DISTINCT id, name, content FROM chunks WHERE chunk_type IN ('function', 'method')))) WHERE callee NOT IN {extract.NO_CALL} AND callee <> coalesce(name, '') GROUP BY ALL)"""


@query("x14_call_edges", f"WITH {_CALLS} SELECT * FROM cl")
def _(s, d):
    return extract.calls(table(s, d, "chunks").where("chunk_type in ('function', 'method')").select("id", "name", "content").distinct())


@query("x20_enclosing_chunk", f"WITH {D.CH}, p AS (SELECT repo_name, module_path, start_line AS line, id FROM ch) SELECT p.id, first(c.id ORDER BY c.end_line - c.start_line, c.id) AS enclosing FROM p JOIN ch c ON c.repo_name = p.repo_name AND c.module_path = p.module_path AND c.start_line <= p.line AND p.line < c.end_line GROUP BY p.id")
def _(s, d):
    c = D.chunks(s, d, ["repo_name", "module_path", "start_line", "end_line", "ingested_at"]).drop("ingested_at")
    p = c.select("repo_name", "module_path", F.col("start_line").alias("line"), F.col("id").alias("point"))
    j = p.join(c, ["repo_name", "module_path"]).where("start_line <= line and line < end_line")
    return j.groupBy(F.col("point").alias("id")).agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), "id")).alias("enclosing"))


@query("x21_section_tree", f"WITH {D.SE} SELECT a.doc_id, a.position, a.depth, (SELECT max(b.position) FROM se b WHERE b.doc_id = a.doc_id AND b.position < a.position AND b.depth < a.depth) IS NOT NULL AS has_parent FROM se a")
def _(s, d):
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return D.sections(s, d).select("doc_id", "position", "depth", F.coalesce(F.min("depth").over(w) < F.col("depth"), F.lit(False)).alias("has_parent"))


_BACK = "list_transform(regexp_extract_all(content, '`([A-Za-z_][A-Za-z0-9_:]*)`', 1), lambda x: lower(x))"


@query("x22_section_tags", f"WITH {D.SE}, t AS (SELECT doc_id, position, {_BACK} AS l FROM se) SELECT doc_id, position, list_filter(l, lambda x, i: list_position(l, x) = i)[1:10] AS tags FROM t WHERE len(l) > 0")
def _(s, d):
    return D.sections(s, d).select("doc_id", "position", fn.section_tags(F.col("content")).alias("tags")).where(F.size("tags") > 0)


_SPLIT = r"regexp_replace(regexp_replace(name, '[_-]', ' ', 'g'), '(\p{Lu})', ' \1', 'g')"


@query("x23_chunk_tags", f"WITH {D.CH} SELECT id, CASE WHEN name IS NOT NULL AND chunk_type IS NOT NULL THEN list_sort(list_distinct(list_concat(list_filter(string_split_regex(lower({_SPLIT}), '\\s+'), lambda w: strlen(w) > 2), [lower(chunk_type)])))[1:10] END AS tags FROM ch")
def _(s, d):
    return D.chunks(s, d, ["name", "chunk_type", "ingested_at"]).select("id", fn.chunk_tags(F.col("name"), F.col("chunk_type")).alias("tags"))


@query("x24_camel_split", f"WITH {D.CH} SELECT id, left(name, 1) || regexp_replace(substr(name, 2), '(\\p{{Lu}})', ' \\1', 'g') AS words FROM ch WHERE name IS NOT NULL")
def _(s, d):
    return D.chunks(s, d, ["name", "ingested_at"]).where("name is not null").select("id", fn.camel_split(F.col("name")).alias("words"))


@query("x25_embed_text", f"WITH {D.CH} SELECT id, concat(repo_name, ' ', module_path, ' ', coalesce(language, ''), ' ', chunk_type, ' ', coalesce(fqn, ''), chr(10), CASE WHEN trim(doc) <> '' THEN left(doc, 500) || chr(10) || coalesce(signature, '') ELSE left(content, 300) END) AS text FROM ch")
def _(s, d):
    ch = D.chunks(s, d)
    body = F.when(F.trim("doc") != "", F.concat(F.substring("doc", 1, 500), F.lit("\n"), F.coalesce("signature", F.lit("")))).otherwise(F.substring("content", 1, 300))
    return ch.select("id", F.concat("repo_name", F.lit(" "), "module_path", F.lit(" "), F.coalesce("language", F.lit("")), F.lit(" "), "chunk_type", F.lit(" "), F.coalesce("fqn", F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))).alias("text"))


@query("x29_normalize_url", "SELECT repo_name, regexp_replace(regexp_replace(coalesce(seed_url, git_url), '#.*$', ''), '/$', '') AS url FROM sources")
def _(s, d):
    return table(s, d, "sources").select("repo_name", fn.normalize_url(F.coalesce("seed_url", "git_url")).alias("url"))


_URL = "coalesce(seed_url, git_url)"


@query("x39_url_title", f"SELECT repo_name, coalesce(list_filter(string_split(regexp_replace({_URL}, '^[a-z]+://[^/]*', ''), '/'), lambda p: p <> '')[-1], 'index') AS title, nullif(regexp_extract({_URL}, '(?:^|[/\\-])(v\\d+(?:\\.\\d+)*)(?:$|[/\\-])', 1), '') AS version FROM sources")
def _(s, d):
    return table(s, d, "sources").select("repo_name", fn.url_title(F.coalesce("seed_url", "git_url")).alias("title"), fn.version_of_url(F.coalesce("seed_url", "git_url")).alias("version"))


@query("x28_glob_match", f"WITH {D.MO} SELECT repo_name, path FROM mo WHERE path GLOB 'src/*/*.rs'")
def _(s, d):
    return D.modules(D.chunks(s, d)).where(F.col("path").rlike(fn.glob_to_regex("src/*/*.rs"))).select("repo_name", "path")


@query("x40_completeness", f"WITH {D.MO}, k AS (SELECT repo_name, count(*) AS total, count(*) FILTER (WHERE language IS NULL) AS failed FROM mo GROUP BY 1) SELECT s.repo_name, round(coalesce(1.0 * (k.total - k.failed) / k.total, 1.0), 6) AS ratio, coalesce(k.failed > 0, false) AS aborts FROM sources s LEFT JOIN k USING (repo_name)")
def _(s, d):
    """Share of a source's files that were read, files without a known language having failed; 1 without files; less than all aborts."""
    k = D.modules(D.chunks(s, d)).groupBy("repo_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("language").isNull()).alias("failed"))
    j = table(s, d, "sources").select("repo_name").join(k, "repo_name", "left")
    return j.select("repo_name", F.round(F.coalesce((F.col("total") - F.col("failed")) / F.col("total"), F.lit(1.0)), 6).alias("ratio"), F.coalesce(F.col("failed") > 0, F.lit(False)).alias("aborts"))


_ENTRY = r"""CASE WHEN lang = 'rust' AND name = 'main' THEN 'main' WHEN lang = 'rust' AND regexp_matches(content, '#\[(?:tokio::)?test') THEN 'test' WHEN lang = 'rust' AND regexp_matches(content, '#\[(?:get|post|put|delete)\(') THEN 'api_handler'
  WHEN lang IN ('typescript', 'javascript') AND regexp_matches(content, '\b(?:app|router)\.(?:get|post|put|delete)\(') THEN 'api_handler' WHEN lang IN ('typescript', 'javascript') AND regexp_matches(content, '\.(?:on|addEventListener)\(') THEN 'event_listener'
  WHEN lang IN ('typescript', 'javascript') AND starts_with(content, 'export default') THEN 'module_entry' WHEN lang = 'python' AND name = 'main' THEN 'main' WHEN lang = 'python' AND starts_with(name, 'test_') THEN 'test' WHEN lang = 'go' AND name = 'main' THEN 'main' END"""


@query("x41_entry_points", f"WITH {D.CH}, t AS (SELECT id, {_ENTRY} AS kind FROM (SELECT *, lower(coalesce(language, '')) AS lang FROM ch)) SELECT * FROM t WHERE kind IS NOT NULL")
def _(s, d):
    ch = D.chunks(s, d, ["name", "content", "language", "ingested_at"])
    return ch.select("id", fn.entry_point(F.col("content"), F.col("name"), F.col("language")).alias("kind")).where("kind is not null")


@query("x43_path_safety", f"WITH {D.MO} SELECT repo_name, path, NOT (starts_with(path, '/') OR regexp_matches(path, '(^|/)\\.\\.(/|$)') OR regexp_matches(path, '^[A-Za-z]:') OR path = '') AS safe FROM mo")
def _(s, d):
    return D.modules(D.chunks(s, d)).select("repo_name", "path", fn.safe_path(F.col("path")).alias("safe"))


@query("x44_page_title", f"WITH {D.SE} SELECT d.doc_id, coalesce(min_by(se.heading, se.position), regexp_extract(any_value(d.doc_path), '([^/]*)[.][a-z]+$', 1)) AS title FROM documents d LEFT JOIN se ON se.doc_id = d.doc_id AND se.depth = 0 AND se.heading <> 'Content' GROUP BY 1")
def _(s, d):
    first = D.sections(s, d).where("depth = 0 and heading <> 'Content'").groupBy("doc_id").agg(F.min_by("heading", "position").alias("h"))
    j = table(s, d, "documents").select("doc_id", "doc_path").join(first, "doc_id", "left")
    return j.select("doc_id", F.coalesce("h", F.regexp_extract("doc_path", "([^/]*)[.][a-z]+$", 1)).alias("title"))


# --- resolution -----------------------------------------------------------------


@query("e1_chunk_index", f"WITH {D.CH} SELECT repo_name, name, count(DISTINCT id) AS n, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS unique_id FROM ch WHERE name IS NOT NULL GROUP BY ALL")
def _(s, d):
    g = D.chunks(s, d, ["repo_name", "name", "ingested_at"]).where("name is not null").groupBy("repo_name", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return g.select("repo_name", "name", "n", F.when(F.col("n") == 1, F.col("first")).alias("unique_id"))


_RETURN = r"nullif(trim(regexp_extract(signature, '^[^\n]*?\)\s*->\s*([^\n]+?)\s*(?:\{|:|where\b|$)', 1)), '')"
_BASE_TYPE = r"regexp_replace(trim(regexp_replace(regexp_replace(trim(t), '^(?:&\s*)?(?:''\w+\s+)?(?:mut\s+)?(?:dyn\s+)?', ''), '<.*$', '')), '^.*::', '')"


@query("e2_base_type", f"WITH {D.CH}, r AS (SELECT id, {_RETURN} AS t FROM ch) SELECT id, t AS return_type, {_BASE_TYPE} AS base FROM r WHERE t IS NOT NULL")
def _(s, d):
    sig = D.chunks(s, d, ["signature", "ingested_at"]).select("id", fn.return_type(F.col("signature")).alias("t")).where("t is not null")
    return sig.select("id", F.col("t").alias("return_type"), fn.base_type(F.col("t")).alias("base"))


@query("e6_resolve_calls")
def _(s, d):
    ch = D.chunks(s, d)
    return extract.resolve_calls(extract.calls(ch.where("chunk_type in ('function', 'method')").select("id", "name", "content")), ch)


@query("e14_edge_dedup", f"WITH {D.LC} SELECT src, dst, max(c) AS confidence FROM (SELECT lower(chunk_ids[1]) AS src, lower(chunk_ids[2]) AS dst, round(length(content) % 10 / 10.0, 2) AS c FROM lc WHERE len(chunk_ids) >= 2) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL")
def _(s, d):
    e = D.large_chunks(s, d).where(F.size("chunk_ids") >= 2).select(F.lower(F.col("chunk_ids")[0]).alias("src"), F.lower(F.col("chunk_ids")[1]).alias("dst"), F.round(F.length("content") % 10 / 10.0, 2).alias("c"))
    return e.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.max("c").alias("confidence"))


@query("e17_go_implements", f"WITH {D.CH}, m AS (SELECT DISTINCT repo_name, parent_fqn AS t, name FROM ch WHERE language = 'go' AND chunk_type = 'method' AND parent_fqn IS NOT NULL), r AS (SELECT repo_name, t, count(*) AS n FROM m GROUP BY ALL) SELECT a.repo_name, a.t AS iface, b.t AS impl FROM m a JOIN m b ON b.repo_name = a.repo_name AND b.name = a.name AND b.t <> a.t JOIN r ON r.repo_name = a.repo_name AND r.t = a.t GROUP BY a.repo_name, a.t, b.t, r.n HAVING count(DISTINCT a.name) = r.n")
def _(s, d):
    ch = D.chunks(s, d, ["repo_name", "parent_fqn", "name", "language", "chunk_type", "ingested_at"])
    return extract.structural_implements(ch.where("language = 'go' and chunk_type = 'method' and parent_fqn is not null").select("repo_name", F.col("parent_fqn").alias("t"), "name"))


@query("e20_content_reuse", f"WITH {D.CH}, v AS (SELECT module_path, name, content, count(DISTINCT id) AS n FROM ch GROUP BY ALL) SELECT module_path, name, count(*) FILTER (WHERE n > 1) AS reused, count(*) AS versions FROM v GROUP BY ALL")
def _(s, d):
    ch = D.chunks(s, d, ["module_path", "name", "content", "ingested_at"])
    v = ch.groupBy("module_path", "name", F.sha2("content", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("module_path", "name").agg(F.count_if(F.col("n") > 1).alias("reused"), F.count(F.lit(1)).alias("versions"))


@query("e21_large_chunks", f"WITH {D.CH} SELECT id, lead(id) OVER (PARTITION BY repo_name, module_path ORDER BY start_line, id) AS next_id FROM ch QUALIFY next_id IS NOT NULL")
def _(s, d):
    ch = D.chunks(s, d, ["repo_name", "module_path", "start_line", "ingested_at"])
    nxt = F.lead("id").over(Window.partitionBy("repo_name", "module_path").orderBy(F.asc_nulls_last("start_line"), "id"))
    return ch.select("id", nxt.alias("next_id")).where("next_id is not null")
