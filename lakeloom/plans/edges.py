"""X, E: scanning, crawling, types, imports and inherited calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import text as fn
from lakeloom.operators import edges as op
from lakeloom.operators import extract
from lakeloom.plans import contract, graph
from lakeloom.plans import domain as D
from lakeloom.plans import text as text_plans
from lakeloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- files and pages ------------------------------------------------------------


@query("x1_file_scan", f"WITH {D.CH}, f AS (SELECT repo_name, module_path AS path, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM ch GROUP BY ALL) SELECT repo_name, path, bytes, {text_plans._PRIORITY} AS priority FROM f WHERE bytes <= 102400 AND NOT contains(path, 'node_modules') AND NOT contains(path, 'vendor/') AND NOT regexp_matches(path, '(^|/)[.]')")
def _(s, d):
    f = D.chunks(s, d, ["repo_name", "module_path", "content", "ingested_at"]).groupBy("repo_name", F.col("module_path").alias("path")).agg(F.sum(F.octet_length("content")).alias("bytes"))
    keep = ~F.col("path").contains("node_modules") & ~F.col("path").contains("vendor/") & ~F.col("path").rlike(r"(^|/)[.]")
    return f.where((F.col("bytes") <= 102400) & keep).select("repo_name", "path", "bytes", fn.file_priority(F.col("path")).alias("priority"))


_ROUTE = "CASE p_partkey % 4 WHEN 0 THEN 'src/routes/(app)/shop/[id]/+page.svelte' WHEN 1 THEN 'src/routes/api/v' || p_size || '/+server.ts' WHEN 2 THEN 'pages/blog/index.vue' ELSE 'pages/docs/p' || p_size || '.vue' END"


@query("x6_file_routes", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '/shop/[id]' WHEN 1 THEN '/api/v' || p_size WHEN 2 THEN '/blog' ELSE '/docs/p' || p_size END AS route FROM part")
def _(s, d):
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, "src/routes/(app)/shop/[id]/+page.svelte").when(k == 1, F.format_string("src/routes/api/v%d/+server.ts", "p_size")).when(k == 2, "pages/blog/index.vue").otherwise(F.format_string("pages/docs/p%d.vue", "p_size"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), fn.file_route(path).alias("route"))


_MEMBERS = r"\{([^{}]*)\}"


@query("x12_enum_members", f"WITH {D.CH} SELECT id, fqn AS parent_fqn, m AS member FROM (SELECT id, fqn, unnest(list_transform(string_split(regexp_extract(content, '{_MEMBERS}', 1), ','), lambda x: regexp_extract(x, '\\w+', 0))) AS m FROM ch WHERE chunk_type = 'enum') WHERE m <> ''")
def _(s, d):
    e = D.chunks(s, d, ["fqn", "chunk_type", "content", "ingested_at"]).where("chunk_type = 'enum'")
    names = F.transform(F.split(F.regexp_extract("content", _MEMBERS, 1), ","), lambda x: F.regexp_extract(x, r"\w+", 0))
    return e.select("id", F.col("fqn").alias("parent_fqn"), F.explode(names).alias("member")).where("member <> ''")


_TYPE = r"[A-Z]\w*"


@query("x16_type_references", f"WITH {D.CH} SELECT DISTINCT id, t AS type_name, 'type' AS ref_kind FROM (SELECT id, name, unnest(regexp_extract_all(signature, '\\b{_TYPE}')) AS t FROM ch WHERE chunk_type IN ('function', 'method')) WHERE t <> name")
def _(s, d):
    f = D.chunks(s, d, ["name", "signature", "chunk_type", "ingested_at"]).where("chunk_type in ('function', 'method')")
    t = f.select("id", "name", F.explode(F.regexp_extract_all("signature", F.lit(rf"\b{_TYPE}"), F.lit(0))).alias("type_name"))
    return t.where("type_name <> name").select("id", "type_name", F.lit("type").alias("ref_kind")).distinct()


_SUPER = r"(?:(extends|implements)\s+([A-Z]\w*)|class\s+\w+\s*\(\s*([A-Z]\w*)|(?:class|struct|record)\s+\w+\s*:\s*([A-Z]\w*)|impl\s+([A-Z]\w*)\s+for)"


@query("x17_supertypes", f"""WITH {D.CH}, h AS (SELECT id, unnest(regexp_extract_all(split_part(content, chr(10), 1), '{_SUPER}')) AS m FROM ch WHERE chunk_type IN ('class', 'struct', 'trait', 'interface'))
SELECT DISTINCT id, coalesce(nullif(regexp_extract(m, '{_SUPER}', 2), ''), nullif(regexp_extract(m, '{_SUPER}', 3), ''), nullif(regexp_extract(m, '{_SUPER}', 4), ''), regexp_extract(m, '{_SUPER}', 5)) AS super, CASE WHEN contains(m, 'impl') THEN 'implements' ELSE 'extends' END AS kind FROM h""")
def _(s, d):
    c = D.chunks(s, d, ["chunk_type", "content", "ingested_at"]).where("chunk_type in ('class', 'struct', 'trait', 'interface')")
    h = c.select("id", F.explode(F.regexp_extract_all(F.split_part("content", F.lit("\n"), F.lit(1)), F.lit(_SUPER), F.lit(0))).alias("m"))
    name = F.coalesce(*[F.nullif(F.regexp_extract("m", _SUPER, i), F.lit("")) for i in (2, 3, 4, 5)])
    return h.select("id", name.alias("super"), F.when(F.col("m").contains("impl"), "implements").otherwise("extends").alias("kind")).distinct()


_LEAD = r"^\s*((?:(?:///?|#|--)[^\n]*\n\s*)+|/\*.*?\*/)"


@query("x18_leading_doc", f"WITH {D.CH} SELECT id, trim(regexp_extract(content, '(?s){_LEAD}', 1), ' ' || chr(9) || chr(10) || chr(13)) AS doc FROM ch WHERE chunk_type IN ('function', 'method') AND regexp_matches(content, '(?s){_LEAD}')")
def _(s, d):
    f = D.chunks(s, d, ["chunk_type", "content", "ingested_at"]).where("chunk_type in ('function', 'method')").where(F.col("content").rlike("(?s)" + _LEAD))
    return f.select("id", F.regexp_replace(F.regexp_extract("content", "(?s)" + _LEAD, 1), r"^[ \t\n\r]+|[ \t\n\r]+$", "").alias("doc"))


@query("x19_route_methods", f"WITH {graph._SITES} SELECT id, CASE upper(method) WHEN 'POST' THEN 'POST' WHEN 'GET' THEN 'GET' ELSE 'ANY' END AS method, CASE WHEN id % 6 = 0 THEN NULL ELSE path END AS path FROM cs")
def _(s, d):
    c = graph._call_sites(s, d)
    raw = F.when(F.upper("method") == "ANY", "RequestMapping").otherwise(F.concat("method", F.lit("Mapping")))
    url = F.when(F.col("id") % 6 == 0, F.concat(F.lit("https://h.example.invalid/${base}"), "path")).otherwise(F.concat(F.lit("https://h.example.invalid:80"), "path", F.lit("?q=1#f")))
    return c.select("id", fn.http_method(raw).alias("method"), fn.url_path(url).alias("path"))


#: Pages of HTML made of the documents: a menu, a title, two blocks, links to the next page, the root, an asset and another host.
_HTML_SQL = "ht AS (SELECT doc_id, 'h' || doc_id % 20 || '.example.invalid' AS host, CAST(doc_id AS VARCHAR) AS k FROM documents)"


def _html(s, d):
    t = table(s, d, "documents").select("doc_id", F.format_string("h%d.example.invalid", F.col("doc_id") % 20).alias("host"))
    parts = "<html><head><style>p{}</style></head><body><nav><p>menu</p><a href='/m'>m</a></nav><h1>Page %d</h1><p>First <b>bold</b>\n  text %d.</p><ul><li>one</li><li><p>two</p></li></ul><pre>a\n  b</pre>"
    links = "<p>See <a href=\"p%d\">next</a>, <a class='x' href='/p%d#top'>self</a>, <a href='/a.png'>img</a> and <a href='https://other.invalid/p1'>out</a>.</p><footer>end</footer></body></html>"
    return t.withColumn("html", F.concat(F.format_string(parts, "doc_id", "doc_id"), F.format_string(links, F.col("doc_id") + 20, "doc_id")))


_MD = "'# Page ' || k || chr(10) || chr(10) || 'First bold text ' || k || '.' || chr(10) || chr(10) || '- one' || chr(10) || chr(10) || '- two' || chr(10) || chr(10) || '```' || chr(10) || 'a' || chr(10) || '  b' || chr(10) || '```' || chr(10) || chr(10) || 'See next, self, img and out.'"


@query("x26_html_markdown", f"WITH {_HTML_SQL} SELECT doc_id, {_MD} AS markdown FROM ht")
def _(s, d):
    return op.html_to_markdown(_html(s, d), "doc_id", "html")


_LINKS_SQL = _HTML_SQL + ", ln AS (SELECT host AS site, 'https://' || host || '/p' || doc_id AS url, 'https://' || host || x AS \"to\" FROM ht, LATERAL (SELECT unnest(['/m', '/p' || (doc_id + 20), '/p' || doc_id]) AS x))"


def _links(s, d):
    h = _html(s, d).withColumn("url", F.concat(F.lit("https://"), "host", F.lit("/p"), "doc_id"))
    return h.select(F.col("host").alias("site"), "url", F.explode(op.html_links(F.col("html"), F.col("url"), F.col("host"))).alias("to")).select("site", "url", fn.normalize_url(F.col("to")).alias("to"))


@query("x27_page_links", f"WITH {_LINKS_SQL} SELECT * FROM ln")
def _(s, d):
    return _links(s, d)


@query("x30_crawl", f"WITH RECURSIVE {_LINKS_SQL}, sd AS (SELECT site, min_by(url, length(url) * 1000000 + CAST(regexp_extract(url, '/p(\\d+)$', 1) AS BIGINT)) AS url FROM ln GROUP BY 1), w AS (SELECT site, url, 0 AS depth FROM sd UNION SELECT w.site, ln.\"to\", w.depth + 1 FROM w JOIN ln ON ln.site = w.site AND ln.url = w.url WHERE w.depth < 6), b AS (SELECT site, url, min(depth) AS depth FROM w GROUP BY ALL) SELECT site, url, depth FROM b QUALIFY row_number() OVER (PARTITION BY site ORDER BY depth, url) <= 5")
def _(s, d):
    links = _links(s, d)
    seeds = links.groupBy("site").agg(F.min_by("url", F.length("url") * F.lit(1000000).cast("long") + F.regexp_extract("url", r"/p(\d+)$", 1).cast("long")).alias("url"))
    return op.crawl(s, seeds, links, depth=6, budget=5)


@query("x31_adapter", "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'pinned' WHEN p_size % 50 >= 40 OR p_partkey % 10 * 10 >= 60 THEN CASE WHEN p_partkey % 10 * 10 >= p_size % 50 + 20 THEN 'wiki' ELSE 'docs' END ELSE 'generic' END AS adapter FROM part")
def _(s, d):
    """A pinned host, else the adapter with the greatest score of at least 60 (ties: the last), else the generic one."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 50 + 20).alias("docs"), (F.col("p_partkey") % 10 * 10).alias("wiki"))
    scores = F.array(F.struct(F.col("docs").alias("s"), F.lit(0).alias("at"), F.lit("docs").alias("n")), F.struct(F.col("wiki").cast("int").alias("s"), F.lit(1).alias("at"), F.lit("wiki").alias("n")))
    best = F.array_max(F.filter(scores, lambda x: x["s"] >= 60))
    return p.select("id", F.when(F.col("id") % 7 == 0, "pinned").otherwise(F.coalesce(best["n"], F.lit("generic"))).alias("adapter"))


@query("x32_host_preset", f"WITH {_HTML_SQL}, pr AS (SELECT 'h' || n_nationkey || '.example.invalid' AS host, CASE WHEN n_regionkey = 0 THEN 'runtime' ELSE 'base' END AS preset FROM nation) SELECT doc_id, preset FROM ht JOIN pr USING (host)")
def _(s, d):
    n = table(s, d, "nation")
    base = n.select(F.format_string("h%d.example.invalid", "n_nationkey").alias("host"), F.lit("base").alias("preset"), F.lit(0).alias("rank"))
    over = n.where("n_regionkey = 0").select(F.format_string("h%d.example.invalid", "n_nationkey").alias("host"), F.lit("runtime").alias("preset"), F.lit(1).alias("rank"))
    presets = base.unionByName(over).groupBy("host").agg(F.max_by("preset", "rank").alias("preset"))
    return _html(s, d).select("doc_id", "host").join(F.broadcast(presets), "host").select("doc_id", "preset")  # a row per nation


@query("x33_probe", "SELECT doc_id, CASE WHEN coalesce(source, '') <> '' AND doc_id % 3 = 0 THEN 'good' WHEN length(text) >= 200 THEN 'generic' ELSE 'unsupported' END AS outcome FROM documents")
def _(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", F.when((F.coalesce("source", F.lit("")) != "") & (F.col("doc_id") % 3 == 0), "good").when(F.length("text") >= 200, "generic").otherwise("unsupported").alias("outcome"))


@query("x34_wikitext", "SELECT doc_id, 'Page ' || doc_id || chr(10) || 'A bold word and an item, see label or plain.' AS text FROM documents")
def _(s, d):
    w = F.format_string("<!-- c --> == Page %d ==\nA '''bold''' word<ref name=x>r</ref> and an ''item''{{tpl|a}}, see [[target|label]] or [[plain]].\n\n\n[[Category:x]]", "doc_id")
    return table(s, d, "documents").select("doc_id", fn.wikitext_to_text(F.regexp_replace(w, "^<!-- c --> ", "<!-- c -->")).alias("text"))


@query("x35_llms_full_pages", f"WITH {contract._ORDER} SELECT repo, path, trim(content) AS content FROM od")
def _(s, d):
    """The pages of the rendered full text, split at the lines that name them."""
    from lakeloom.operators import contract as c

    t = c.llms_full(contract.files(s, d))
    parts = F.split("text", r"(?m)(?:^|\n\n)(?=--- \S+ ---\n)")
    one = t.select("repo", F.explode(parts).alias("p")).where("p <> ''")
    return one.select("repo", F.regexp_extract("p", r"^--- (\S+) ---\n", 1).alias("path"), F.regexp_replace("p", r"^--- \S+ ---\n", "").alias("content"))


@query("x36_search_index", "SELECT n_nationkey AS id, 'https://b.example.invalid/n' || n_nationkey || '.html' AS url, n_name AS title FROM nation")
def _(s, d):
    n = table(s, d, "nation")
    js = n.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.struct(F.format_string("n%d.html", "n_nationkey").alias("href"), F.col("n_name").alias("title")))))).alias("js"))
    e = js.select(F.explode(F.from_json("js", "map<string,struct<href:string,title:string>>")).alias("k", "v"))
    return e.select(F.col("k").cast(dict(n.dtypes)["n_nationkey"]).alias("id"), F.concat(F.lit("https://b.example.invalid/"), "v.href").alias("url"), F.col("v.title").alias("title"))


@query("x37_book_list", "SELECT DISTINCT n_name AS book FROM nation")
def _(s, d):
    js = table(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("id")))).alias("js"))
    return js.select(F.explode(F.from_json("js", "array<struct<id:string>>")).alias("b")).select(F.col("b.id").alias("book")).distinct()


@query("x38_url_version", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'v' || p_size || '.1' END AS version FROM part")
def _(s, d):
    k = F.col("p_partkey")
    url = F.when(k % 3 == 0, "https://a.invalid/video/value").when(k % 3 == 1, F.format_string("https://a.invalid/docs/v%d.1/x", "p_size")).otherwise(F.format_string("https://a.invalid/pkg-v%d.1-notes", "p_size"))
    return table(s, d, "part").select(k.alias("id"), fn.version_of_url(url).alias("version"))


# --- types ----------------------------------------------------------------------


@query("e3_dyn_trait", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE 'T' || p_size END AS trait FROM part")
def _(s, d):
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, F.format_string("Box<dyn T%d>", "p_size")).when(k == 1, F.format_string("&'a dyn T%d + Send", "p_size")).when(k == 2, F.format_string("Arc<dyn a::T%d + Sync>", "p_size")).when(k == 3, F.format_string("std::rc::Rc<dyn T%d>", "p_size")).otherwise(F.format_string("Vec<T%d>", "p_size"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), fn.dyn_trait(t).alias("trait"))


@query("e4_return_type", f"WITH {D.CH}, r AS (SELECT id, parent_fqn, {text_plans._RETURN} AS t FROM ch) SELECT id, CASE WHEN parent_fqn IS NULL THEN t ELSE regexp_replace(t, '\\bSelf\\b', parent_fqn, 'g') END AS return_type FROM r WHERE t IS NOT NULL")
def _(s, d):
    c = D.chunks(s, d, ["signature", "parent_fqn", "ingested_at"]).select("id", "parent_fqn", fn.return_type(F.col("signature")).alias("t")).where("t is not null")
    return c.select("id", F.when(F.col("parent_fqn").isNull(), F.col("t")).otherwise(F.regexp_replace(F.col("t"), F.lit(r"\bSelf\b"), F.col("parent_fqn"))).alias("return_type"))


_FIELD = r"(?m)^[ \t]+(?:pub(?:lic)?\s+|private\s+|readonly\s+)*(\w+)(?:\s*:\s*(\w+))?\s*[,;]?\s*(?:(?://|#).*)?$"


@query("e5_struct_fields", f"WITH {D.CH}, l AS (SELECT id, unnest(regexp_extract_all(content, '{_FIELD}')) AS line FROM ch WHERE chunk_type = 'struct') SELECT DISTINCT id, regexp_extract(line, '{_FIELD}', 1) AS field, nullif(regexp_extract(line, '{_FIELD}', 2), '') AS type_name FROM l")
def _(s, d):
    c = D.chunks(s, d, ["chunk_type", "content", "ingested_at"]).where("chunk_type = 'struct'")
    line = c.select("id", F.explode(F.regexp_extract_all("content", F.lit(_FIELD), F.lit(0))).alias("line"))
    return line.select("id", F.regexp_extract("line", _FIELD, 1).alias("field"), F.nullif(F.regexp_extract("line", _FIELD, 2), F.lit("")).alias("type_name")).distinct()


@query("e18_interface_methods", f"WITH {D.CH} SELECT id, m AS method FROM (SELECT id, unnest(regexp_extract_all(content, '(?m)^[ \\t]+([A-Za-z]\\w*)', 1)) AS m FROM ch WHERE language = 'go' AND chunk_type IN ('interface', 'trait'))")
def _(s, d):
    c = D.chunks(s, d, ["language", "chunk_type", "content", "ingested_at"]).where("language = 'go' and chunk_type in ('interface', 'trait')")
    return c.select("id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]+([A-Za-z]\w*)"), F.lit(1))).alias("method"))


# --- calls and imports ----------------------------------------------------------

#: Calls between neighbours of a large chunk: every second one names the owner of what it calls.
_RAW = f"""{D.CH}, {D.LC}, re AS (SELECT DISTINCT a.id AS src, b.name AS callee, CASE WHEN length(b.name) % 2 = 0 THEN regexp_extract(b.parent_fqn, '([^.:]+)$', 1) ELSE '' END AS receiver
  FROM lc JOIN ch a ON a.id = lower(lc.chunk_ids[1]) JOIN ch b ON b.id = lower(lc.chunk_ids[2]) WHERE b.name IS NOT NULL)"""
_TIERS = """df AS (SELECT id, repo_name, module_path, name, coalesce(regexp_extract(parent_fqn, '([^.:]+)$', 1), '') AS owner FROM ch WHERE chunk_type IN ('function', 'method')),
t1 AS (SELECT repo_name, owner, name, min(id) AS d FROM df WHERE owner <> '' GROUP BY ALL HAVING count(*) = 1), t2 AS (SELECT repo_name, module_path, name, min(id) AS d FROM df GROUP BY ALL HAVING count(*) = 1), t3 AS (SELECT repo_name, name, min(id) AS d FROM df GROUP BY ALL HAVING count(*) = 1),
rs AS (SELECT re.src, re.callee, c.repo_name, coalesce(t1.d, t2.d, t3.d) AS dst, CASE WHEN t1.d IS NOT NULL THEN 0.9 WHEN t2.d IS NOT NULL THEN 0.8 ELSE 0.6 END AS confidence, CASE WHEN t1.d IS NOT NULL THEN 'type_qualified' WHEN t2.d IS NOT NULL THEN 'same_file' ELSE 'heuristic' END AS method
  FROM re JOIN ch c ON c.id = re.src LEFT JOIN t1 ON t1.repo_name = c.repo_name AND t1.owner = re.receiver AND t1.name = re.callee LEFT JOIN t2 ON t2.repo_name = c.repo_name AND t2.module_path = c.module_path AND t2.name = re.callee LEFT JOIN t3 ON t3.repo_name = c.repo_name AND t3.name = re.callee),
ed AS (SELECT src, dst, max(confidence) AS confidence, max_by(method, (confidence, method)) AS method FROM rs WHERE dst IS NOT NULL AND dst <> src GROUP BY ALL)"""


def _raw_calls(s, d):
    ch = D.chunks(s, d)
    ids = D.large_chunks(s, d).select(F.lower(F.get("chunk_ids", F.lit(0))).alias("src"), F.lower(F.get("chunk_ids", F.lit(1))).alias("dst"))
    to = ch.select(F.col("id").alias("dst"), F.col("name").alias("callee"), F.when(F.length("name") % 2 == 0, F.coalesce(F.regexp_extract("parent_fqn", r"([^.:]+)$", 1), F.lit(""))).otherwise("").alias("receiver"))
    e = ids.join(to, "dst").where("callee is not null").select(F.col("src").alias("id"), "callee", "receiver").distinct()
    return e.join(ch.select("id"), "id", "left_semi"), ch


@query("e7_resolve_edges", f"WITH {_RAW}, {_TIERS} SELECT * FROM ed")
def _(s, d):
    return extract.resolve_calls(*_raw_calls(s, d))


@query("e13_edge_stage", f"WITH {_RAW}, {_TIERS} SELECT method, round(confidence, 2) AS confidence, count(*) AS n FROM ed GROUP BY ALL")
def _(s, d):
    return extract.resolve_calls(*_raw_calls(s, d)).groupBy("method", F.round("confidence", 2).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


#: Imports between neighbouring files of a repository, written in five ways; every fifth leads nowhere.
_RAWIM = f"""{D.MO}, nx AS (SELECT repo_name, path, lead(path) OVER (PARTITION BY repo_name ORDER BY path) AS nxt, row_number() OVER (PARTITION BY repo_name ORDER BY path) AS k FROM mo),
ri AS (SELECT repo_name, path AS module_path, nxt, k, CASE k % 5 WHEN 0 THEN nxt WHEN 1 THEN regexp_replace(nxt, '[.](rs|ts|js|py|go|java|cs|sh)$', '') WHEN 2 THEN '@app/' || nxt WHEN 3 THEN '@root/lib/' || nxt ELSE 'nowhere/' || k END AS target FROM nx WHERE nxt IS NOT NULL)"""


def _raw_imports(s, d):
    w = Window.partitionBy("repo_name").orderBy("path")
    m = D.modules(D.chunks(s, d)).select("repo_name", "path").withColumns({"nxt": F.lead("path").over(w), "k": F.row_number().over(w)}).where("nxt is not null")
    k = F.col("k") % 5
    target = F.when(k == 0, F.col("nxt")).when(k == 1, F.regexp_replace("nxt", r"[.](rs|ts|js|py|go|java|cs|sh)$", "")).when(k == 2, F.concat(F.lit("@app/"), "nxt")).when(k == 3, F.concat(F.lit("@root/lib/"), "nxt")).otherwise(F.concat(F.lit("nowhere/"), "k"))
    return m.select("repo_name", F.col("path").alias("module_path"), target.alias("target"))


def _aliases(s):
    return s.createDataFrame([("@app/", ""), ("@root/", "src/root/"), ("@root/lib/", "")], "alias string, replacement string")


_ALIASED = "ra AS (SELECT repo_name, module_path, CASE WHEN starts_with(target, '@app/') THEN substr(target, 6) WHEN starts_with(target, '@root/lib/') THEN substr(target, 11) WHEN starts_with(target, '@root/') THEN 'src/root/' || substr(target, 7) ELSE target END AS target FROM ri)"
_TRY = "[" + ", ".join(f"{{'r': {i * len(op.ENDINGS) + k}, 'p': '{p}' || target || '{e}'}}" for i, p in enumerate(op.PREFIXES) for k, e in enumerate(op.ENDINGS)) + "]"
_RESOLVED = f"{_ALIASED}, rc AS (SELECT repo_name, module_path, target, unnest({_TRY}) AS c FROM ra), rr AS (SELECT rc.repo_name, rc.module_path, rc.target, min_by(mo.path, rc.c.r) AS resolved FROM rc JOIN mo ON mo.repo_name = rc.repo_name AND mo.path = rc.c.p GROUP BY ALL)"


@query("e9_import_aliases", f"WITH {_RAWIM}, {_ALIASED} SELECT * FROM ra")
def _(s, d):
    return op.rewrite_alias(_raw_imports(s, d), _aliases(s))


@query("e8_import_targets", f"WITH {_RAWIM}, {_RESOLVED} SELECT * FROM rr")
def _(s, d):
    return op.import_targets(op.rewrite_alias(_raw_imports(s, d), _aliases(s)), D.modules(D.chunks(s, d)))


@query("e10_alias_discovery", "SELECT '@app/' AS alias, 'src/app/' AS replacement UNION ALL SELECT '~/', 'src/'")
def _(s, d):
    config = s.createDataFrame([('{"compilerOptions": {"paths": {"@app/*": ["src/app/*"], "~/*": ["src/*", "lib/*"]}}}',)], "js string")
    paths = F.from_json("js", "compilerOptions struct<paths:map<string,array<string>>>")["compilerOptions"]["paths"]
    return config.select(F.explode(paths).alias("a", "r")).select(F.regexp_replace("a", r"\*$", "").alias("alias"), F.regexp_replace(F.get("r", F.lit(0)), r"\*$", "").alias("replacement"))


@query("e11_raw_imports", f"WITH {text_plans._IMPORTS} SELECT DISTINCT module_path, target FROM im")
def _(s, d):
    return text_plans.QUERIES["x13_import_edges"](s, d).select("module_path", "target").distinct()


@query("e12_import_stage", f"WITH {_RAWIM}, {_RESOLVED} SELECT repo_name, module_path, count(DISTINCT resolved) AS n_imported FROM rr WHERE resolved <> module_path GROUP BY ALL")
def _(s, d):
    r = QUERIES["e8_import_targets"](s, d).where("resolved <> module_path")
    return r.groupBy("repo_name", "module_path").agg(F.countDistinct("resolved").alias("n_imported"))


_INHERIT = f"WITH RECURSIVE {D.SU}, up AS (SELECT su.newer AS src, su.older AS t, 1 AS depth FROM su UNION ALL SELECT up.src, su.older, up.depth + 1 FROM up JOIN su ON su.newer = up.t WHERE up.depth < 8), ih AS (SELECT src, '1-URGENT' AS method, min_by(up.t, up.depth) AS dst, min(up.depth) AS depth FROM up JOIN sn ON sn.note_id = up.t WHERE sn.category = '1-URGENT' GROUP BY 1)"


def _inherited(s, d):
    n = D.saga_notes(s, d)
    supers = D.supersedes(s, d).select(F.col("newer").alias("type"), F.col("older").alias("super"))
    calls = n.select(F.col("note_id").alias("src"), F.lit("1-URGENT").alias("method"), F.col("note_id").alias("type"))
    return op.inherited(s, calls, supers, n.select(F.col("note_id").alias("type"), F.col("category").alias("method")))


@query("e15_inherited_calls", f"{_INHERIT} SELECT src, method, dst, depth, 0.9 AS confidence FROM ih")
def _(s, d):
    return _inherited(s, d)


@query("e16_new_inherited", f"{_INHERIT} SELECT src, dst FROM ih WHERE NOT EXISTS (SELECT 1 FROM su WHERE su.newer = ih.src AND su.older = ih.dst)")
def _(s, d):
    known = D.supersedes(s, d).select(F.col("newer").alias("src"), F.col("older").alias("dst"))
    return _inherited(s, d).select("src", "dst").join(known, ["src", "dst"], "left_anti")
