"""C, further V, N, O and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeloom.operators import clustering, curation, lookups, retrieval
from lakeloom.plans import domain as D
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


@query("c2_section_clusters")
def _(s, d):
    return clustering.spherical_kmeans(s, table(s, d, "embeddings"), "vec_id", "embedding")


@query("c3_centroids", "SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL")
def _(s, d):
    c = clustering.centroids(table(s, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "m")).select("label", "i", F.round("m", 6).alias("m"))


_NAME = "coalesce(min_by(heading, (length(heading), position)) FILTER (WHERE length(heading) BETWEEN 3 AND 50), min_by(heading, position))"


@query("c4_cluster_names", f"WITH {D.SE} SELECT doc_id, {_NAME} AS name FROM se GROUP BY 1")
def _(s, d):
    fits = F.when(F.length("heading").between(3, 50), F.col("heading"))
    best = F.min_by(fits, F.when(fits.isNotNull(), F.struct(F.length("heading"), "position")))
    return D.sections(s, d).groupBy("doc_id").agg(F.coalesce(best, F.min_by("heading", "position")).alias("name"))


@query("c5_unique_names", f"WITH {D.SE}, n AS (SELECT doc_id, {_NAME} AS name FROM se GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS k FROM n) SELECT doc_id, CASE WHEN k = 1 THEN name ELSE name || ' (' || k || ')' END AS name FROM r")
def _(s, d):
    from pyspark.sql import Window

    n = QUERIES["c4_cluster_names"](s, d).withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("doc_id")))
    return n.select("doc_id", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), "k", F.lit(")"))).alias("name"))


@query("c11_project_summary", f"WITH {D.NO} SELECT repo_name, lower(trim(category)) AS category, count(*) AS n, strftime(max(created_at), '%Y-%m-%dT%H:%M:%SZ') AS newest FROM no GROUP BY ALL")
def _(s, d):
    n = D.notes(s, d)
    return n.groupBy("repo_name", F.lower(F.trim("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"), lookups.iso(F.max("created_at")).alias("newest"))


_COS = "CASE WHEN list_inner_product(x, x) > 0 AND list_inner_product(q.v, q.v) > 0 THEN list_inner_product(x, q.v) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(q.v, q.v))) ELSE 0 END"
_NEAREST = f"WITH {D.NO}, v AS (SELECT id, embedding::DOUBLE[] AS x, invalid_at, archived FROM no WHERE len(embedding) = 48), q AS (SELECT id AS query, x AS v FROM v WHERE substr(md5(id), 1, 2) < '03'), c AS (SELECT query, id, score FROM (SELECT q.query, v.id, round({_COS}, 6) AS score FROM v, q WHERE v.invalid_at IS NULL AND v.archived = false AND v.id <> q.query) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) = 1)"


def _nearest_note(s, d):
    """Of every hundredth note, the most similar other valid note."""
    n = D.notes(s, d, ["embedding", "invalid_at", "archived", "updated_at"]).where(F.size("embedding") == 48)
    q = n.where(retrieval.every_hundredth(F.col("id"))).select(F.col("id").alias("query"), F.col("embedding").alias("v"))
    near = retrieval.nearest(curation.valid(n), q, "id", "embedding", 2).where("key <> query")
    return near.groupBy("query").agg(F.min(F.struct("rank", "key", "score")).alias("b")).select("query", F.col("b.key").alias("id"), F.col("b.score").alias("score"))


@query("n1_nearest_note", _NEAREST + " SELECT query, id, score FROM c")
def _(s, d):
    return _nearest_note(s, d)


@query("n2_dedup_verdict", _NEAREST + " SELECT query, id, CASE WHEN score >= 0.9 THEN 'block' WHEN score >= 0.7 THEN 'warn' ELSE 'ok' END AS verdict FROM c")
def _(s, d):
    return _nearest_note(s, d).select("query", "id", curation.dedup_verdict(F.col("score"), F.lit(False)).alias("verdict"))


@query("v6_section_vectors", f"WITH {D.SE}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT se.doc_id, se.position, round({_COS}, 6) AS score FROM se JOIN (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) e ON e.vec_id = se.doc_id, q")
def _(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("v"))
    j = D.sections(s, d).select("doc_id", "position").join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").join(F.broadcast(q), how="inner")  # one row
    return j.select("doc_id", "position", F.round(curation.cosine(F.col("v"), F.col("embedding")), 6).alias("score"))


@query("o13_saga_reaper", f"WITH {D.SA}, {D.SN}, m AS (SELECT saga_id, max(valid_at) AS last FROM sn GROUP BY 1) SELECT sa.saga_id, CASE WHEN sa.status = 'open' AND m.last < TIMESTAMP '1998-01-01 00:00:00' THEN 'stale' ELSE sa.status END AS status FROM sa LEFT JOIN m ON m.saga_id = sa.saga_id")
def _(s, d):
    last = D.saga_notes(s, d).groupBy("saga_id").agg(F.max("valid_at").alias("last"))
    old = F.coalesce(F.col("last") < F.expr("timestamp_ntz '1998-01-01 00:00:00'"), F.lit(False))
    return D.sagas(s, d).join(last, "saga_id", "left").select("saga_id", F.when((F.col("status") == "open") & old, "stale").otherwise(F.col("status")).alias("status"))


@query("o18_snapshot_round_trip", f"WITH {D.CH}, {D.LC}, {D.NO} SELECT repo_name, 'chunks' AS source_table, count(*) AS n FROM ch GROUP BY 1 UNION ALL SELECT repo_name, 'large_chunks', count(*) FROM lc GROUP BY 1 UNION ALL SELECT repo_name, 'notes', count(*) FROM no GROUP BY 1")
def _(s, d):
    """Exports three tables by repository and reads them again."""
    path = f"{shared_dir(s)}/lakeloom/snapshot-{uuid.uuid4().hex}"
    names = {"chunks": D.chunks(s, d), "large_chunks": D.large_chunks(s, d), "notes": D.notes(s, d)}
    snapshots.export(names, path)
    out = None
    for n in names:
        k = lookups.counts(snapshots.restore(s, path, n), "repo_name").select("repo_name", F.lit(n).alias("source_table"), "n")
        out = k if out is None else out.unionByName(k)
    return out


@query("o24_last_job_ref", f"WITH {D.JO} SELECT repo, max_by(git_ref, (started_at, job_id)) AS git_ref FROM jo GROUP BY 1")
def _(s, d):
    return D.jobs(s, d).groupBy("repo").agg(F.max_by("git_ref", F.struct("started_at", "job_id")).alias("git_ref"))


@query("o25_corpus_versions", f"WITH {D.JO} SELECT repo, job_id, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, job_id DESC) AS place FROM jo")
def _(s, d):
    from pyspark.sql import Window

    return D.jobs(s, d).select("repo", "job_id", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("started_at"), F.desc("job_id"))).alias("place"))


@query("o27_derive_claim", f"WITH {D.JO} SELECT job_id, status <> 'running' AS claimed, CASE WHEN status <> 'running' THEN 'running' ELSE status END AS status FROM jo")
def _(s, d):
    free = F.col("status") != "running"
    return D.jobs(s, d).select("job_id", free.alias("claimed"), F.when(free, "running").otherwise(F.col("status")).alias("status"))
