"""S-3 to S-15: the documentation contract, on a corpus that is made from the documents' paths.

Every repository has an index that lists three quarters of its pages by source;
a page links to the next one, some to a page or an anchor that is not there,
some inside code, some to another host.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import text as fn
from lakeloom.operators import contract as op
from lakeloom.sources.tables import table

QUERIES, SQL = {}, {}
BASE = "https://docs.example.invalid/"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_SRC = "coalesce(lower(trim(source)), 'none')"
FILES = f"""pg AS (SELECT doc_id, repo_name AS repo, {_SRC} AS src, 'pages/' || {_SRC} || '/p' || doc_id || '.md' AS path, 'Page ' || doc_id AS title FROM documents WHERE repo_name IS NOT NULL),
pn AS (SELECT *, lead(src) OVER w AS nsrc, lead(doc_id) OVER w AS nid FROM pg WINDOW w AS (PARTITION BY repo ORDER BY doc_id)),
pc AS (SELECT repo, path, title, src, doc_id, '# ' || title || chr(10) || chr(10) || '## How it works' || chr(10) || chr(10) || CASE WHEN nid IS NULL THEN 'The last page.'
  WHEN doc_id % 10 = 0 THEN 'See [gone](../none/p' || doc_id || '.md).' WHEN doc_id % 10 = 1 THEN 'See [next](../' || nsrc || '/p' || nid || '.md#nowhere).'
  WHEN doc_id % 10 = 2 THEN 'Write `[x](missing.md)` or see [host](https://a.example.invalid/x).' WHEN doc_id % 10 = 3 THEN 'Back to [the index](../../index.md#all-pages) or [up](#how-it-works).'
  ELSE 'See [next](../' || nsrc || '/./p' || nid || '.md#page-' || nid || ').' END AS content FROM pn),
ix AS (SELECT repo, src, '### ' || src || chr(10) || string_agg('- [' || title || '](' || path || ')' || CASE WHEN doc_id % 2 = 0 THEN ' — about ' || doc_id ELSE '' END, chr(10) ORDER BY doc_id) AS body FROM pc WHERE doc_id % 4 <> 0 GROUP BY repo, src),
fi AS (SELECT repo, path, content FROM pc UNION ALL SELECT repo, 'index.md', '# Index' || chr(10) || chr(10) || '## All pages' || chr(10) || string_agg(body, chr(10) ORDER BY src) FROM ix GROUP BY 1)"""


def files(s, d):
    p = table(s, d, "documents").where("repo_name is not null")
    p = p.select("doc_id", F.col("repo_name").alias("repo"), F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("src"))
    p = p.withColumns({"path": F.format_string("pages/%s/p%d.md", "src", "doc_id"), "title": F.format_string("Page %d", "doc_id")})
    w = Window.partitionBy("repo").orderBy("doc_id")
    p = p.withColumns({"nsrc": F.lead("src").over(w), "nid": F.lead("doc_id").over(w)})
    i = F.col("doc_id") % 10
    body = (
        F.when(F.col("nid").isNull(), "The last page.").when(i == 0, F.format_string("See [gone](../none/p%d.md).", "doc_id")).when(i == 1, F.format_string("See [next](../%s/p%d.md#nowhere).", "nsrc", "nid"))
        .when(i == 2, "Write `[x](missing.md)` or see [host](https://a.example.invalid/x).").when(i == 3, "Back to [the index](../../index.md#all-pages) or [up](#how-it-works).").otherwise(F.format_string("See [next](../%s/./p%d.md#page-%d).", "nsrc", "nid", "nid"))
    )
    p = p.withColumn("content", F.concat(F.lit("# "), "title", F.lit("\n\n## How it works\n\n"), body))
    entry = F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(")"), F.when(F.col("doc_id") % 2 == 0, F.format_string(" — about %d", "doc_id")).otherwise(""))
    groups = p.where("doc_id % 4 <> 0").groupBy("repo", "src").agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))).alias("es"))
    text = F.concat(F.lit("### "), "src", F.lit("\n"), F.array_join(F.transform("es", lambda x: x["e"]), "\n"))
    index = groups.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("src", text.alias("t")))).alias("g"))
    index = index.select("repo", F.lit("index.md").alias("path"), F.concat(F.lit("# Index\n\n## All pages\n"), F.array_join(F.transform("g", lambda x: x["t"]), "\n")).alias("content"))
    return p.select("repo", "path", "content").unionByName(index)


@query("s3_version_header", "SELECT p_partkey AS id, p_size AS major, p_partkey % 10 AS minor, 0 AS patch FROM part WHERE p_partkey % 3 <> 0")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.lit("#define X_MAJOR x\n")).otherwise(F.format_string("// v\n#define X_VERSION_MAJOR %d\n#define X_VERSION_MINOR  %d\n#define X_VERSION_PATCH 0\n", "p_size", F.col("p_partkey") % 10)).alias("t"))
    return p.select("id", fn.version_header(F.col("t")).alias("v")).where("v is not null").select("id", F.col("v.major").alias("major"), F.col("v.minor").cast("long").alias("minor"), F.col("v.patch").alias("patch"))


_NAV = FILES + """, nl AS (SELECT repo, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM fi WHERE path = 'index.md'),
nv AS (SELECT repo, pos, grp, regexp_extract(line, '^- \\[([^\\]]*)\\]\\(([^)]*)\\)', 1) AS title, regexp_extract(line, '^- \\[([^\\]]*)\\]\\(([^)]*)\\)', 2) AS path, regexp_extract(line, ' — (.*)$', 1) AS description
  FROM (SELECT *, last_value(CASE WHEN starts_with(line, '### ') THEN substr(line, 5) END IGNORE NULLS) OVER (PARTITION BY repo ORDER BY pos) AS grp FROM nl) WHERE starts_with(line, '- ['))""".replace("\\\\", "\\")


@query("s4_nav_tree", f"WITH {_NAV} SELECT repo, CAST(pos AS INTEGER) AS pos, grp, title, path, description FROM nv")
def _(s, d):
    return op.nav(files(s, d)).select("repo", "pos", "grp", "title", "path", "description")


@query("s5_relative_path", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'a/y' WHEN 2 THEN 'a/b/c' ELSE 'z' END AS path, doc_id % 4 = 3 AS escapes FROM documents")
def _(s, d):
    k = F.col("doc_id") % 4
    target = F.when(k == 0, "../../x").when(k == 1, "./.././y").when(k == 2, "c").otherwise("../../../z")
    r = op.resolve_path(F.lit("a/b"), target)
    return table(s, d, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.path", "r.escapes")


@query("s6_code_ranges", "SELECT doc_id, CAST(coalesce(sum(length(m)), 0) AS BIGINT) AS n_chars, count(m) AS n_ranges, length(regexp_replace(any_value(text), '(?ms)^(?:```.*?^```|~~~.*?^~~~)|`[^`\\n]*`', '', 'g')) AS n_left FROM (SELECT doc_id, text, unnest(CASE WHEN len(regexp_extract_all(text, '(?ms)^(?:```.*?^```|~~~.*?^~~~)|`[^`\\n]*`')) = 0 THEN [NULL] ELSE regexp_extract_all(text, '(?ms)^(?:```.*?^```|~~~.*?^~~~)|`[^`\\n]*`') END) AS m FROM documents WHERE text IS NOT NULL) GROUP BY 1".replace("\\\\", "\\"))
def _(s, d):
    r = op.code_ranges(F.col("text"))
    t = table(s, d, "documents").where("text is not null").select("doc_id", "text", r.alias("r"))
    n = F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return t.select("doc_id", n.alias("n_chars"), F.size("r").cast("long").alias("n_ranges"), F.length(op.without_code(F.col("text"))).cast("long").alias("n_left"))


_FIND = _NAV + r""", lk AS (SELECT repo, path, unnest(regexp_extract_all(regexp_replace(content, '`[^`\n]*`', '', 'g'), '\[([^\]\n]*)\]\(([^)\s]+)\)', 2)) AS target FROM fi),
li AS (SELECT repo, path, target, CASE WHEN starts_with(target, '#') THEN path WHEN starts_with(target, '../../') THEN 'index.md' WHEN path = 'index.md' THEN target
  ELSE 'pages/' || replace(substr(regexp_replace(target, '#.*$', ''), 4), '/./', '/') END AS to_path, nullif(regexp_extract(target, '#(.*)$', 1), '') AS anchor FROM lk WHERE NOT starts_with(target, 'https:')),
sl AS (SELECT DISTINCT repo, path, replace(regexp_replace(lower(h), '[^\p{L}\p{N}\p{M}_\- ]', '', 'g'), ' ', '-') AS slug FROM (SELECT repo, path, unnest(regexp_extract_all(content, '(?m)^#{1,6}[ \t]+(.+?)[ \t]*$', 1)) AS h FROM fi)),
fd AS (SELECT DISTINCT repo, path, 'broken_link' AS rule, target AS detail, 'error' AS severity FROM li WHERE NOT EXISTS (SELECT 1 FROM fi WHERE fi.repo = li.repo AND fi.path = li.to_path)
  UNION SELECT repo, path, 'broken_anchor', target, 'error' FROM li WHERE anchor IS NOT NULL AND EXISTS (SELECT 1 FROM fi WHERE fi.repo = li.repo AND fi.path = li.to_path) AND NOT EXISTS (SELECT 1 FROM sl WHERE sl.repo = li.repo AND sl.path = li.to_path AND sl.slug = li.anchor)
  UNION SELECT repo, path, 'orphan_page', path, 'warn' FROM fi WHERE path <> 'index.md' AND NOT EXISTS (SELECT 1 FROM nv WHERE nv.repo = fi.repo AND nv.path = fi.path))"""


@query("s7_link_findings", f"WITH {_FIND} SELECT * FROM fd")
def _(s, d):
    return op.findings(files(s, d))


@query("s8_heading_slugs", f"WITH {_FIND} SELECT * FROM sl")
def _(s, d):
    return op.slugs(files(s, d))


@query("s9_nav_paths", f"WITH {_NAV} SELECT DISTINCT repo, 'docs/' || path AS path FROM nv")
def _(s, d):
    n = op.nav(files(s, d))
    return n.select("repo", op.resolve_path(op.folder(F.lit("docs/index.md")), F.col("path"))["path"].alias("path")).distinct()


_ORDER = _NAV + ", od AS (SELECT fi.repo, fi.path, fi.content, row_number() OVER (PARTITION BY fi.repo ORDER BY n.pos NULLS LAST, fi.path) AS place FROM fi LEFT JOIN (SELECT repo, path, min(pos) AS pos FROM nv GROUP BY ALL) n ON n.repo = fi.repo AND n.path = fi.path WHERE fi.path <> 'index.md')"


@query("s10_page_order", f"WITH {_ORDER} SELECT repo, path, place FROM od")
def _(s, d):
    return op.ordered_pages(files(s, d))


_LLMS = f"WITH {_NAV}, g AS (SELECT repo, grp, min(pos) AS first, '## ' || grp || chr(10) || string_agg('- [' || title || ']({BASE}' || repo || '/' || path || ')' || CASE WHEN description = '' THEN '' ELSE ': ' || description END, chr(10) ORDER BY pos) AS body FROM nv GROUP BY repo, grp), t AS (SELECT repo, '# ' || repo || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY first) AS text FROM g GROUP BY 1)"


@query("s11_llms_index", _LLMS + " SELECT * FROM t")
def _(s, d):
    return op.llms_index(files(s, d), BASE)


@query("s12_llms_full", f"WITH {_ORDER} SELECT repo, string_agg('--- ' || path || ' ---' || chr(10) || trim(content), chr(10) || chr(10) ORDER BY place) AS text FROM od GROUP BY 1")
def _(s, d):
    return op.llms_full(files(s, d))


@query("s13_global_index", f"SELECT string_agg('- [' || repo_name || ']({BASE}' || repo_name || '/llms.txt)', chr(10) ORDER BY repo_name) AS text FROM sources")
def _(s, d):
    line = F.concat(F.lit("- ["), "repo_name", F.lit("]("), F.lit(BASE), "repo_name", F.lit("/llms.txt)"))
    return table(s, d, "sources").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("repo_name", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))  # a row per repository


@query("s15_skill_doc", _LLMS + " SELECT repo, '---' || chr(10) || 'name: ' || regexp_replace(left(regexp_replace(regexp_replace(lower(repo), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), '-+$', '') || chr(10) || 'description: Documentation of ' || repo || chr(10) || '---' || chr(10) || chr(10) || text AS text FROM t")
def _(s, d):
    t = op.llms_index(files(s, d), BASE)
    return t.select("repo", F.concat(F.lit("---\nname: "), fn.skill_name(F.col("repo")), F.lit("\ndescription: Documentation of "), "repo", F.lit("\n---\n\n"), "text").alias("text"))
