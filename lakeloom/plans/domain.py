"""The domain relations of the tables, once for Spark and once as SQL for the check.

Chunks, notes, sources, documents are the tables themselves, one row per id.
Relations that have no table are read from the star schema: ``part`` are the
nodes of the call graph and neighbouring line items of an order its calls,
``orders`` of a ``customer`` are the notes of a saga and the jobs of a
repository, ``events`` are counters, samples and usage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import table, unique_rows

CHUNK = ["repo_name", "module_path", "chunk_type", "name", "signature", "content", "language", "embedding", "signature_embedding", "git_ref", "fqn", "parent_fqn", "start_line", "end_line", "visibility", "is_async", "is_static", "is_exported", "doc", "ingested_at"]
NOTE = ["repo_name", "branch", "category", "title", "summary", "content", "facts", "author", "embedding", "related_symbols", "related_files", "tags", "created_at", "updated_at", "staleness_score", "access_count", "archived", "valid_at", "invalid_at", "superseded_by"]


def chunks(spark, d, cols=CHUNK) -> DataFrame:
    return unique_rows(table(spark, d, "chunks"), "id", list(cols), latest="ingested_at")


def large_chunks(spark, d) -> DataFrame:
    return unique_rows(table(spark, d, "large_chunks"), "id", ["repo_name", "module_path", "chunk_ids", "content", "embedding", "git_ref", "ingested_at"], latest="ingested_at")


def notes(spark, d, cols=NOTE) -> DataFrame:
    return unique_rows(table(spark, d, "notes"), "id", list(cols), latest="updated_at")


def modules(ch: DataFrame) -> DataFrame:
    """One row per file: its id, number of chunks and of exports, its language."""
    lang = ch.where("language is not null").groupBy("repo_name", "module_path", "language").agg(F.count(F.lit(1)).alias("k"))
    best = lang.groupBy("repo_name", "module_path").agg(F.min_by("language", F.struct(-F.col("k"), "language")).alias("language"))
    m = ch.groupBy("repo_name", "module_path").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("is_exported").alias("exports_count"))
    m = m.join(best, ["repo_name", "module_path"], "left")
    return m.select(F.md5(F.concat_ws("/", "repo_name", "module_path")).alias("module_id"), "repo_name", F.col("module_path").alias("path"), "language", "n_chunks", "exports_count")


def nodes(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("module"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))


def calls(spark, d) -> DataFrame:
    """(src, dst, confidence, method): the greatest confidence of each pair."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    b = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"), (1 - F.col("l_discount")).alias("confidence"))
    e = a.join(b, ["l_orderkey", "l_linenumber"]).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    return e.withColumn("method", F.when(F.col("confidence") >= 0.97, "import_resolved").when(F.col("confidence") >= 0.94, "same_file").otherwise("heuristic"))


def imports(spark, d) -> DataFrame:
    """(src, dst) modules: calls lifted to modules, without loops."""
    n = nodes(spark, d).select("id", "module")
    e = calls(spark, d).select("src", "dst").join(n.withColumnsRenamed({"id": "src", "module": "a"}), "src").join(n.withColumnsRenamed({"id": "dst", "module": "b"}), "dst")
    return e.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def sagas(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    status = F.when(F.col("c_acctbal") < 0, "resolved").when(F.col("c_acctbal") < 5000, "open").otherwise("active")
    return c.select(F.col("c_custkey").alias("saga_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("repo_name"), status.alias("status"))


def saga_notes(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("saga_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderdate").alias("valid_at"), (F.col("o_orderstatus") == "F").alias("archived"), "o_totalprice"
    )


def supersedes(spark, d) -> DataFrame:
    """(newer, older): each saga's notes in order of time."""
    w = Window.partitionBy("saga_id").orderBy("valid_at", "note_id")
    n = saga_notes(spark, d).withColumn("older", F.lag("note_id").over(w))
    return n.where("older is not null").select(F.col("note_id").alias("newer"), "older")


def jobs(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "completed").otherwise("running")
    return o.select(F.col("o_orderkey").alias("job_id"), F.concat(F.lit("repo"), F.col("o_custkey")).alias("repo"), status.alias("status"), F.col("o_orderdate").alias("started_at"), F.col("o_orderpriority").alias("git_ref"), F.col("o_totalprice").alias("progress"))


def sections(spark, d) -> DataFrame:
    """(doc_id, position, depth, heading, content) of the documents' headings, outside nothing: any line counts.

    Depth counts from 0; the text before the first heading is dropped; a
    document without headings is one section "Content".
    """
    docs = table(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", "text", "source", "repo_name")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    head = F.regexp_extract("line", r"^(#{1,6})[ \t]+(.+)$", 1)
    lines = lines.withColumn("marks", F.length(head)).withColumn("no", F.sum(F.when(F.col("marks") > 0, 1).otherwise(0)).over(w))
    some = lines.where("no > 0").groupBy("doc_id", "no").agg(
        (F.max("marks") - 1).alias("depth"), F.max(F.when(F.col("marks") > 0, F.trim(F.regexp_extract("line", r"^(#{1,6})[ \t]+(.+)$", 2)))).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("marks") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("content"),
    )
    bare = docs.join(some.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(1).alias("no"), F.lit(0).alias("depth"), F.lit("Content").alias("heading"), F.col("text").alias("content"))
    return some.unionByName(bare).select("doc_id", (F.col("no") - 1).cast("int").alias("position"), F.col("depth").cast("int"), "heading", "content")


# --- the same relations as common table expressions -------------------------

CH = "ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM chunks WHERE id IS NOT NULL) WHERE rn = 1)"
LC = "lc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM large_chunks WHERE id IS NOT NULL) WHERE rn = 1)"
NO = "no AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM notes WHERE id IS NOT NULL) WHERE rn = 1)"
MO = CH + """, ml AS (SELECT repo_name, module_path, language, count(*) AS k FROM ch WHERE language IS NOT NULL GROUP BY ALL),
mb AS (SELECT repo_name, module_path, language FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, module_path ORDER BY k DESC, language) AS r FROM ml) WHERE r = 1),
mo AS (SELECT md5(g.repo_name || '/' || g.module_path) AS module_id, g.repo_name, g.module_path AS path, mb.language, g.n_chunks, g.exports_count
  FROM (SELECT repo_name, module_path, count(*) AS n_chunks, count(*) FILTER (WHERE is_exported) AS exports_count FROM ch GROUP BY ALL) g
  LEFT JOIN mb ON mb.repo_name = g.repo_name AND mb.module_path = g.module_path)"""
ND = "nd AS (SELECT p_partkey AS id, p_name AS name, p_brand AS module, p_type AS kind, p_size AS size FROM part)"
CA = """ca AS (SELECT src, dst, confidence, CASE WHEN confidence >= 0.97 THEN 'import_resolved' WHEN confidence >= 0.94 THEN 'same_file' ELSE 'heuristic' END AS method
  FROM (SELECT a.l_partkey AS src, b.l_partkey AS dst, max(1 - b.l_discount) AS confidence FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2))"""
IM = ND + ", " + CA + ", im AS (SELECT DISTINCT x.module AS src, y.module AS dst FROM ca JOIN nd x ON x.id = ca.src JOIN nd y ON y.id = ca.dst WHERE x.module <> y.module)"
SA = "sa AS (SELECT c_custkey AS saga_id, c_name AS name, c_mktsegment AS repo_name, CASE WHEN c_acctbal < 0 THEN 'resolved' WHEN c_acctbal < 5000 THEN 'open' ELSE 'active' END AS status FROM customer)"
SN = "sn AS (SELECT o_orderkey AS note_id, o_custkey AS saga_id, o_orderpriority AS category, o_orderdate AS valid_at, o_orderstatus = 'F' AS archived, o_totalprice FROM orders)"
SU = SN + ", su AS (SELECT note_id AS newer, older FROM (SELECT note_id, lag(note_id) OVER (PARTITION BY saga_id ORDER BY valid_at, note_id) AS older FROM sn) WHERE older IS NOT NULL)"
JO = "jo AS (SELECT o_orderkey AS job_id, 'repo' || o_custkey AS repo, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'completed' ELSE 'running' END AS status, o_orderdate AS started_at, o_orderpriority AS git_ref, o_totalprice AS progress FROM orders)"
SE = r"""dl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text <> ''),
dm AS (SELECT *, length(regexp_extract(line, '^(#{1,6})[ \t]+(.+)$', 1)) AS marks FROM dl),
dn AS (SELECT *, sum(CASE WHEN marks > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM dm),
ds AS (SELECT doc_id, no, max(marks) - 1 AS depth, max(CASE WHEN marks > 0 THEN trim(regexp_extract(line, '^(#{1,6})[ \t]+(.+)$', 2)) END) AS heading,
  coalesce(string_agg(CASE WHEN marks = 0 THEN line END, chr(10) ORDER BY pos), '') AS content FROM dn WHERE no > 0 GROUP BY doc_id, no),
se AS (SELECT doc_id, CAST(no - 1 AS INTEGER) AS position, CAST(depth AS INTEGER) AS depth, heading, content FROM ds
  UNION ALL SELECT doc_id, 0, 0, 'Content', text FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM ds))"""
