"""Queries of the general training-data operators (p3, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import hierarchy, orphans
from lakeloom.sources.tables import table


def _references(spark, sf_dir):
    return orphans.reference_parts(*[table(spark, sf_dir, t) for t in ("chunks", "large_chunks", "notes", "removed_chunks")])


def p3_found(spark, sf_dir):
    return orphans.orphans(_references(spark, sf_dir))


def p3_report(spark, sf_dir):
    return orphans.orphan_report(_references(spark, sf_dir))


def _resolved(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks").select("repo_name", "fqn", "parent_fqn")
    return hierarchy.resolve(spark, hierarchy.links(rows))


def p5_found(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].select(F.col("scope").alias("repo_name"), F.col("node").alias("fqn"))


def p5_hierarchy(spark, sf_dir):
    trees = hierarchy.with_counts(_resolved(spark, sf_dir)[0])
    return trees.select(F.col("scope").alias("repo_name"), F.col("node").alias("fqn"), F.array_join("path", " > ").alias("path"), F.col("depth").cast("int"), "root", "n_descendants")


def p5_descendants(spark, sf_dir):
    d = hierarchy.descendants(_resolved(spark, sf_dir)[0])
    return d.select(F.col("scope").alias("repo_name"), "ancestor", "descendant", F.col("distance").cast("int"))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p5_found, p5_hierarchy, p5_descendants)}

_LINKS = """
WITH RECURSIVE own AS (
  SELECT DISTINCT repo_name, fqn, CASE WHEN trim(parent_fqn) <> '' THEN parent_fqn END AS parent
  FROM chunks WHERE repo_name IS NOT NULL AND trim(fqn) <> ''),
node AS (
  SELECT o.repo_name, o.fqn, min(p.fqn) AS parent
  FROM own o LEFT JOIN own p ON p.repo_name = o.repo_name AND p.fqn = o.parent GROUP BY ALL)"""
_TREES = _LINKS + """,
tree AS (
  SELECT repo_name, fqn, [fqn] AS path FROM node WHERE parent IS NULL
  UNION ALL
  SELECT n.repo_name, n.fqn, list_append(t.path, n.fqn) FROM node n JOIN tree t ON t.repo_name = n.repo_name AND t.fqn = n.parent)"""
_DESC = """
closure AS (SELECT repo_name, path[i] AS ancestor, fqn AS descendant, CAST(len(path) - i AS INTEGER) AS distance
  FROM tree, LATERAL (SELECT unnest(range(1, len(path) + 1)) AS i))"""

_P3 = r"""
WITH live AS (
  SELECT lower(trim(id)) AS key, min(ingested_at) AS live_from, any_value(repo_name) AS repo, any_value(name) AS name, any_value(module_path) AS module_path
  FROM chunks WHERE lower(trim(id)) NOT IN (SELECT lower(trim(chunk_id)) FROM removed_chunks WHERE chunk_id IS NOT NULL) GROUP BY 1),
r1 AS (SELECT DISTINCT id, ingested_at AS ts, unnest(chunk_ids) AS v FROM large_chunks),
r2 AS (SELECT DISTINCT id, created_at AS ts, repo_name AS repo, unnest(related_symbols) AS v FROM notes),
s2 AS (SELECT *, trim(regexp_replace(trim(v), '\(\)$', '')) AS sym FROM r2 WHERE trim(v) <> ''),
r3 AS (SELECT DISTINCT id, created_at AS ts, repo_name AS repo, unnest(related_files) AS v FROM notes),
s3 AS (SELECT *, regexp_replace(regexp_replace(replace(trim(v), '\', '/'), '(:[0-9]+|#L[0-9]+)$', ''), '^(\./)+', '') AS path FROM r3 WHERE trim(v) <> '')
SELECT DISTINCT 'large_chunks' AS source_table, id AS source_id, 'chunk_ids' AS ref_field, v AS ref_value, strftime(ts, '%Y-%m') AS period FROM r1
WHERE trim(v) <> '' AND NOT EXISTS (SELECT 1 FROM live WHERE live.key = lower(trim(r1.v)) AND live.live_from <= r1.ts)
UNION
SELECT DISTINCT 'notes', id, 'related_symbols', v, strftime(ts, '%Y-%m') FROM s2
WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.repo = s2.repo AND live.live_from <= s2.ts
  AND live.name = regexp_extract(s2.sym, '([^:]|:[^:])*$', 0) AND NOT contains(s2.sym, '::'))
  AND NOT EXISTS (SELECT 1 FROM live WHERE live.repo = s2.repo AND live.live_from <= s2.ts AND contains(s2.sym, '::')
  AND live.name = regexp_extract(s2.sym, '^(.*)::(.*?)$', 2) AND contains(live.module_path, regexp_extract(s2.sym, '^(.*)::(.*?)$', 1)))
UNION
SELECT DISTINCT 'notes', id, 'related_files', v, strftime(ts, '%Y-%m') FROM s3
WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.repo = s3.repo AND live.live_from <= s3.ts AND live.module_path = s3.path)"""

SQL = {
    "p3_found": _P3,
    "p3_report": f"SELECT source_table, ref_field, period, count(*) AS n_orphans, count(DISTINCT source_id) AS n_sources FROM ({_P3}) GROUP BY ALL",
    "p5_found": _LINKS
    + """,
walk AS (
  SELECT repo_name, fqn AS origin, parent AS here FROM node WHERE parent IS NOT NULL
  UNION
  SELECT w.repo_name, w.origin, n.parent FROM walk w JOIN node n ON n.repo_name = w.repo_name AND n.fqn = w.here WHERE n.parent IS NOT NULL)
SELECT DISTINCT repo_name, origin AS fqn FROM walk WHERE origin = here""",
    "p5_hierarchy": _TREES + "," + _DESC + """
SELECT t.repo_name, t.fqn, array_to_string(t.path, ' > ') AS path, CAST(len(t.path) - 1 AS INTEGER) AS depth, t.path[1] AS root, coalesce(c.n, 0) AS n_descendants
FROM tree t LEFT JOIN (SELECT repo_name, ancestor, count(*) AS n FROM closure WHERE distance > 0 GROUP BY ALL) c ON c.repo_name = t.repo_name AND c.ancestor = t.fqn""",
    "p5_descendants": _TREES + "," + _DESC + " SELECT repo_name, ancestor, descendant, distance FROM closure",
}
