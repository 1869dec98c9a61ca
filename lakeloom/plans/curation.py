"""N, O, T and M: notes and sagas, operations, stateful operators (batch twins) and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import curation as op
from lakeloom.operators import graph, lookups
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


_SYM = "sy AS (SELECT DISTINCT id AS note, repo_name, trim(unnest(related_symbols)) AS name FROM no)"


def _symbols(s, d):
    n = D.notes(s, d, ["repo_name", "related_symbols", "updated_at"])
    return n.select(F.col("id").alias("note"), "repo_name", F.explode("related_symbols").alias("x")).select("note", "repo_name", F.trim("x").alias("name")).distinct()


@query("n3_notes_with_symbols", f"WITH {D.NO} SELECT id, CAST(len(coalesce(related_symbols, [])) AS INTEGER) AS n_symbols, CAST(len(coalesce(related_files, [])) AS INTEGER) AS n_files FROM no")
def _(s, d):
    e = F.array().cast("array<string>")
    return D.notes(s, d).select("id", F.size(F.coalesce("related_symbols", e)).alias("n_symbols"), F.size(F.coalesce("related_files", e)).alias("n_files"))


_MISS = f"{D.NO}, {D.CH}, {_SYM}, nm AS (SELECT DISTINCT repo_name, name FROM ch), ms AS (SELECT note, count(*) AS missing FROM sy WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.repo_name = sy.repo_name AND nm.name = sy.name) GROUP BY 1)"


def _missing(s, d):
    names = D.chunks(s, d, ["repo_name", "name", "ingested_at"]).select("repo_name", "name").distinct()
    return lookups.counts(_symbols(s, d).where("name <> ''").join(names, ["repo_name", "name"], "left_anti"), "note", name="missing")


_DIV = """dv AS (SELECT sy.note, 1 - avg(list_cosine_similarity(n.embedding::DOUBLE[], ch.embedding::DOUBLE[])) AS divergence FROM sy JOIN no n ON n.id = sy.note JOIN ch ON ch.repo_name = sy.repo_name AND ch.name = sy.name
 WHERE len(n.embedding) = len(ch.embedding) AND list_inner_product(n.embedding::DOUBLE[], n.embedding::DOUBLE[]) > 0 AND list_inner_product(ch.embedding::DOUBLE[], ch.embedding::DOUBLE[]) > 0 GROUP BY 1)"""


def _divergence(s, d):
    n = D.notes(s, d, ["embedding", "updated_at"]).select(F.col("id").alias("note"), F.col("embedding").alias("v"))
    ch = D.chunks(s, d, ["repo_name", "name", "embedding", "ingested_at"]).select("repo_name", "name", "embedding")
    j = _symbols(s, d).join(ch, ["repo_name", "name"]).join(n, "note").where(F.size("v") == F.size("embedding"))
    j = j.where(F.exists("v", lambda x: x != 0) & F.exists("embedding", lambda x: x != 0))
    return j.groupBy("note").agg((1 - F.avg(op.cosine(F.col("v"), F.col("embedding")))).alias("divergence"))


@query("n4_staleness", f"WITH {_MISS}, {_DIV} SELECT no.id, round(least(1, 0.5 * coalesce(ms.missing, 0) + CASE WHEN dv.divergence > 0.3 THEN dv.divergence ELSE 0 END), 4) AS score FROM no LEFT JOIN ms ON ms.note = no.id LEFT JOIN dv ON dv.note = no.id")
def _(s, d):
    n = D.notes(s, d, ["updated_at"]).select(F.col("id").alias("note")).join(_missing(s, d), "note", "left").join(_divergence(s, d), "note", "left")
    return n.select(F.col("note").alias("id"), F.round(op.staleness(F.coalesce("missing", F.lit(0)), F.col("divergence")), 4).alias("score"))


@query("n5_missing_symbols", f"WITH {_MISS} SELECT * FROM ms")
def _(s, d):
    return _missing(s, d)


@query("n7_embedding_divergence", f"WITH {_MISS}, {_DIV} SELECT note, round(divergence, 6) AS divergence FROM dv")
def _(s, d):
    return _divergence(s, d).withColumn("divergence", F.round("divergence", 6))


_NOW = "TIMESTAMP '2026-03-01 00:00:00'"


@query("n8_auto_archive", f"WITH {D.NO} SELECT id, coalesce(archived, false) OR (staleness_score > 0.9 AND coalesce(access_count, 0) = 0 AND created_at < {_NOW} - INTERVAL 90 DAY) AS archived FROM no")
def _(s, d):
    old = F.col("created_at") < F.expr("timestamp_ntz '2026-03-01 00:00:00' - interval 90 days")
    rule = F.coalesce((F.col("staleness_score") > 0.9) & (F.coalesce("access_count", F.lit(0)) == 0) & old, F.lit(None).cast("boolean"))
    return D.notes(s, d).select("id", (F.coalesce("archived", F.lit(False)) | rule).alias("archived"))


@query("n9_health_bands", f"WITH {D.NO}, u AS (SELECT * FROM no WHERE archived IS NULL OR archived = false) SELECT repo_name, count(*) FILTER (WHERE staleness_score < 0.3) AS healthy, count(*) FILTER (WHERE staleness_score >= 0.3 AND staleness_score < 0.7) AS review, count(*) FILTER (WHERE staleness_score >= 0.7) AS stale, count(*) AS total FROM u GROUP BY 1")
def _(s, d):
    u = op.unarchived(D.notes(s, d)).withColumn("b", F.when(F.col("staleness_score").isNotNull(), op.band(F.col("staleness_score"))))
    return u.groupBy("repo_name").agg(*[F.count_if(F.col("b") == b).alias(b) for b in ("healthy", "review", "stale")], F.count(F.lit(1)).alias("total"))


@query("n10_top_notes", f"WITH {D.NO}, v AS (SELECT * FROM no WHERE invalid_at IS NULL AND archived = false AND title IS NOT NULL) SELECT repo_name, id, access_count, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY access_count DESC NULLS LAST, id) AS r FROM v) WHERE r <= 5")
def _(s, d):
    v = op.valid(D.notes(s, d)).where("title is not null")
    w = Window.partitionBy("repo_name").orderBy(F.desc_nulls_last("access_count"), "id")
    return v.withColumn("place", F.row_number().over(w)).where("place <= 5").select("repo_name", "id", "access_count", "place")


@query("n11_notes_by_category", f"WITH {D.NO} SELECT repo_name, lower(trim(category)) AS category, count(*) AS n FROM no WHERE invalid_at IS NULL AND archived = false GROUP BY ALL")
def _(s, d):
    return op.valid(D.notes(s, d)).groupBy("repo_name", F.lower(F.trim("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("n12_saga_list", f"WITH {D.SA}, {D.SN} SELECT sa.saga_id, sa.name, sa.status, count(sn.note_id) AS n_notes FROM sa LEFT JOIN sn ON sn.saga_id = sa.saga_id GROUP BY ALL")
def _(s, d):
    k = lookups.counts(D.saga_notes(s, d), "saga_id", name="n_notes")
    return D.sagas(s, d).join(k, "saga_id", "left").select("saga_id", "name", "status", F.coalesce("n_notes", F.lit(0)).alias("n_notes"))


@query("n13_saga_timeline", f"WITH {D.SN} SELECT saga_id, note_id, row_number() OVER (PARTITION BY saga_id ORDER BY valid_at, note_id) AS place FROM sn")
def _(s, d):
    return D.saga_notes(s, d).select("saga_id", "note_id", F.row_number().over(Window.partitionBy("saga_id").orderBy("valid_at", "note_id")).alias("place"))


@query("n14_saga_entries", f"WITH {D.SU} SELECT sn.saga_id, sn.note_id, coalesce(su.older, -1) AS supersedes, strftime(sn.valid_at, '%Y-%m-%d') AS day FROM sn LEFT JOIN su ON su.newer = sn.note_id")
def _(s, d):
    w = Window.partitionBy("saga_id").orderBy("valid_at", "note_id")
    return D.saga_notes(s, d).select("saga_id", "note_id", F.coalesce(F.lag("note_id").over(w), F.lit(-1)).alias("supersedes"), F.date_format("valid_at", "yyyy-MM-dd").alias("day"))


@query("n15_saga_counters", f"WITH {D.SA} SELECT repo_name, count(*) FILTER (WHERE status IN ('active', 'open')) AS active, count(*) FILTER (WHERE status = 'resolved') AS resolved FROM sa GROUP BY 1")
def _(s, d):
    return D.sagas(s, d).groupBy("repo_name").agg(F.count_if(F.col("status").isin("active", "open")).alias("active"), F.count_if(F.col("status") == "resolved").alias("resolved"))


@query("n16_saga_statuses", f"WITH {D.SA}, {D.SN} SELECT saga_id, status FROM sa WHERE saga_id IN (SELECT saga_id FROM sn WHERE archived)")
def _(s, d):
    return lookups.among(D.sagas(s, d), D.saga_notes(s, d).where("archived"), "saga_id", "saga_id").select("saga_id", "status")


@query("n17_saga_of_note", f"WITH {D.NO} SELECT id, coalesce(CASE WHEN regexp_full_match(branch, 'wp/[A-Z]+/[0-9]+') THEN regexp_extract(branch, '^wp/([A-Z]+)/([0-9]+)$', 1) || '-' || regexp_extract(branch, '^wp/([A-Z]+)/([0-9]+)$', 2) END, nullif(trim(tags[1]), ''), 'none') AS saga FROM no")
def _(s, d):
    topic = F.nullif(F.trim(F.get("tags", F.lit(0))), F.lit(""))
    return D.notes(s, d).select("id", F.coalesce(op.issue_of_branch(F.col("branch")), topic, F.lit("none")).alias("saga"))


@query("n18_find_or_create_saga", f"WITH {D.NO} SELECT repo_name, branch, min(id) AS first_note, count(*) AS n FROM no WHERE branch IS NOT NULL GROUP BY ALL")
def _(s, d):
    return D.notes(s, d, ["repo_name", "branch", "updated_at"]).where("branch is not null").groupBy("repo_name", "branch").agg(F.min("id").alias("first_note"), F.count(F.lit(1)).alias("n"))


@query("n19_repo_card", f"WITH {D.CH}, g AS (SELECT repo_name, language, count(*) AS n FROM ch WHERE language IS NOT NULL GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY n DESC, language) AS r FROM g) SELECT repo_name, string_agg(language || ' ' || CAST(CAST(round(100.0 * n / total) AS INTEGER) AS VARCHAR) || '%', ', ' ORDER BY r) AS languages FROM (SELECT *, sum(n) OVER (PARTITION BY repo_name) AS total FROM t WHERE r <= 3) GROUP BY 1")
def _(s, d):
    ch = D.chunks(s, d, ["repo_name", "language", "ingested_at"]).where("language is not null")
    w = Window.partitionBy("repo_name").orderBy(F.desc("n"), "language")
    t = lookups.counts(ch, "repo_name", "language").withColumn("r", F.row_number().over(w)).where("r <= 3")
    t = t.withColumn("total", F.sum("n").over(Window.partitionBy("repo_name")))
    part = F.concat("language", F.lit(" "), F.round(F.lit(100.0) * F.col("n") / F.col("total")).cast("int"), F.lit("%"))
    return t.groupBy("repo_name").agg(F.array_sort(F.collect_list(F.struct("r", part.alias("p")))).alias("ps")).select("repo_name", F.array_join(F.transform("ps", lambda x: x["p"]), ", ").alias("languages"))


@query("n20_top_notes_card", f"WITH {D.NO}, v AS (SELECT * FROM no WHERE invalid_at IS NULL AND archived = false AND title IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY access_count DESC NULLS LAST, id) AS r FROM v) SELECT repo_name, string_agg(r || '. ' || title, chr(10) ORDER BY r) AS card FROM t WHERE r <= 5 GROUP BY 1")
def _(s, d):
    w = Window.partitionBy("repo_name").orderBy(F.desc_nulls_last("access_count"), "id")
    t = op.valid(D.notes(s, d)).where("title is not null").withColumn("r", F.row_number().over(w)).where("r <= 5")
    t = t.groupBy("repo_name").agg(F.array_sort(F.collect_list(F.struct("r", "title"))).alias("ps"))
    return t.select("repo_name", F.array_join(F.transform("ps", lambda x: F.concat(x["r"].cast("string"), F.lit(". "), x["title"])), "\n").alias("card"))


@query("n22_mark_superseded", f"WITH {D.SU} SELECT sn.note_id, su.newer AS superseded_by, n.valid_at AS invalid_at FROM sn JOIN su ON su.older = sn.note_id JOIN sn n ON n.note_id = su.newer")
def _(s, d):
    w = Window.partitionBy("saga_id").orderBy("valid_at", "note_id")
    n = D.saga_notes(s, d).select("note_id", F.lead("note_id").over(w).alias("superseded_by"), F.lead("valid_at").over(w).alias("invalid_at"))
    return n.where("superseded_by is not null")


@query("n23_access_counter", "SELECT user_id AS note, count(*) AS accesses, max(ts) AS last_accessed FROM events WHERE event_type = 'view' GROUP BY 1")
def _(s, d):
    return table(s, d, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("note")).agg(F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last_accessed"))


@query("n27_stale_notes", f"WITH {D.NO} SELECT id, staleness_score, row_number() OVER (PARTITION BY repo_name ORDER BY staleness_score DESC, id) AS place FROM no WHERE (archived IS NULL OR archived = false) AND staleness_score >= 0.3")
def _(s, d):
    n = op.unarchived(D.notes(s, d)).where("staleness_score >= 0.3")
    return n.select("id", "staleness_score", F.row_number().over(Window.partitionBy("repo_name").orderBy(F.desc("staleness_score"), "id")).alias("place"))


@query("n28_band_counts", f"WITH {D.NO} SELECT count(*) FILTER (WHERE staleness_score < 0.3) AS healthy, count(*) FILTER (WHERE staleness_score >= 0.3 AND staleness_score < 0.7) AS review, count(*) FILTER (WHERE staleness_score >= 0.7) AS stale, count(*) FILTER (WHERE archived) AS archived, count(*) AS total FROM no")
def _(s, d):
    b = F.when(F.col("staleness_score").isNotNull(), op.band(F.col("staleness_score")))
    return D.notes(s, d).agg(*[F.count_if(b == k).alias(k) for k in ("healthy", "review", "stale")], F.count_if("archived").alias("archived"), F.count(F.lit(1)).alias("total"))


@query("n30_saga_note_count", f"WITH {D.SN} SELECT saga_id, count(*) AS n FROM sn GROUP BY 1")
def _(s, d):
    return lookups.counts(D.saga_notes(s, d), "saga_id")


# --- operations ---------------------------------------------------------------


@query("o1_sources_overview", f"WITH {D.CH}, {D.NO}, c AS (SELECT repo_name, count(*) AS n, max(ingested_at) AS newest FROM ch GROUP BY 1), k AS (SELECT repo_name, count(*) AS n FROM no GROUP BY 1), t AS (SELECT repo_name, count(*) AS n FROM documents GROUP BY 1) SELECT s.repo_name, s.status, coalesce(c.n, 0) AS n_chunks, coalesce(k.n, 0) AS n_notes, coalesce(t.n, 0) AS n_docs, strftime(c.newest, '%Y-%m-%dT%H:%M:%SZ') AS newest FROM sources s LEFT JOIN c ON c.repo_name = s.repo_name LEFT JOIN k ON k.repo_name = s.repo_name LEFT JOIN t ON t.repo_name = s.repo_name")
def _(s, d):
    ch = D.chunks(s, d, ["repo_name", "ingested_at"]).groupBy("repo_name").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("ingested_at").alias("newest"))
    no = lookups.counts(D.notes(s, d, ["repo_name", "updated_at"]), "repo_name", name="n_notes")
    do = lookups.counts(table(s, d, "documents"), "repo_name", name="n_docs")
    j = table(s, d, "sources").select("repo_name", "status").join(ch, "repo_name", "left").join(no, "repo_name", "left").join(do, "repo_name", "left")
    return j.select("repo_name", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "n_notes", "n_docs")], lookups.iso("newest").alias("newest"))


@query("o2_demand_by_kind", "SELECT split_part(repo_name, '-', 2) AS kind, count(*) AS n, max(seed_url) AS url FROM sources GROUP BY 1")
def _(s, d):
    return table(s, d, "sources").groupBy(F.split_part("repo_name", F.lit("-"), F.lit(2)).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("seed_url").alias("url"))


@query("o3_active_jobs", f"WITH {D.JO} SELECT repo, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, job_id DESC) AS r FROM jo WHERE status NOT IN ('done', 'completed', 'failed')) WHERE r = 1")
def _(s, d):
    j = D.jobs(s, d).where(~F.col("status").isin("done", "completed", "failed"))
    return lookups.latest(j, ["repo"], "started_at", "job_id").select("repo", "job_id", "status")


@query("o4_corpus_repos", f"WITH {D.JO} SELECT repo, job_id AS latest, n AS n_versions FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, job_id DESC) AS r, count(*) OVER (PARTITION BY repo) AS n FROM jo) WHERE r = 1")
def _(s, d):
    j = D.jobs(s, d).withColumn("n_versions", F.count(F.lit(1)).over(Window.partitionBy("repo")))
    return lookups.latest(j, ["repo"], "started_at", "job_id").select("repo", F.col("job_id").alias("latest"), "n_versions")


@query("o5_resolve_version", f"WITH {D.JO} SELECT repo, git_ref, max_by(job_id, (started_at, job_id)) AS job_id FROM jo GROUP BY ALL")
def _(s, d):
    return D.jobs(s, d).groupBy("repo", "git_ref").agg(F.max_by("job_id", F.struct("started_at", "job_id")).alias("job_id"))


@query("o6_latest_flag", f"WITH {D.JO} SELECT job_id, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, job_id DESC) = 1 AS is_latest FROM jo")
def _(s, d):
    w = Window.partitionBy("repo").orderBy(F.desc("started_at"), F.desc("job_id"))
    return D.jobs(s, d).select("job_id", (F.row_number().over(w) == 1).alias("is_latest"))


@query("o7_quota_rolling", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), 4) AS used, sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) >= 300 AS exceeded FROM events")
def _(s, d):
    e = op.rolling_sum(table(s, d, "events"), "user_id", "ts", "value", 86400)
    return e.select("event_id", F.round("used", 4).alias("used"), (F.col("used") >= 300).alias("exceeded"))


@query("o8_admin_closure", f"WITH RECURSIVE {D.SU}, r AS (SELECT min(note_id) AS root FROM sn), g AS (SELECT newer, older FROM su), c AS (SELECT newer, older FROM g UNION SELECT c.newer, g.older FROM c JOIN g ON g.newer = c.older) SELECT newer AS grantee, count(*) AS n_granters FROM c GROUP BY 1")
def _(s, d):
    e = D.supersedes(s, d).select(F.col("newer").alias("src"), F.col("older").alias("dst"))
    return lookups.counts(graph.closure(s, e).withColumnRenamed("a", "grantee"), "grantee", name="n_granters")


@query("o9_admin_list", f"WITH {D.SN} SELECT saga_id, note_id AS first_grant FROM (SELECT *, row_number() OVER (PARTITION BY saga_id ORDER BY valid_at, note_id) AS r FROM sn WHERE NOT archived) WHERE r = 1")
def _(s, d):
    return D.saga_notes(s, d).where("not archived").groupBy("saga_id").agg(F.min_by("note_id", F.struct("valid_at", "note_id")).alias("first_grant"))


@query("o10_job_status_update", f"WITH {D.JO} SELECT job_id, coalesce(CASE WHEN status = 'failed' THEN 'retried' END, status) AS status, coalesce(CASE WHEN progress > 200000 THEN progress END, 0) AS progress FROM jo")
def _(s, d):
    return D.jobs(s, d).select("job_id", F.coalesce(F.when(F.col("status") == "failed", "retried"), "status").alias("status"), F.coalesce(F.when(F.col("progress") > 200000, F.col("progress")), F.lit(0)).alias("progress"))


@query("o11_resumable_job", f"WITH {D.JO} SELECT repo, max_by(job_id, (started_at, job_id)) AS job_id FROM jo WHERE status = 'failed' GROUP BY 1")
def _(s, d):
    return D.jobs(s, d).where("status = 'failed'").groupBy("repo").agg(F.max_by("job_id", F.struct("started_at", "job_id")).alias("job_id"))


@query("o12_stale_job_reaper", f"WITH {D.JO} SELECT job_id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 10 MINUTE THEN 'failed' ELSE status END AS status FROM jo")
def _(s, d):
    old = F.col("started_at") < F.expr("timestamp_ntz '1998-01-01 00:00:00' - interval 10 minutes")
    return D.jobs(s, d).select("job_id", F.when((F.col("status") == "running") & old, "failed").otherwise(F.col("status")).alias("status"))


@query("o14_idempotency_reserve", "SELECT user_id, event_type, min(event_id) AS reserved, count(*) - 1 AS repeats FROM events GROUP BY ALL")
def _(s, d):
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("reserved"), (F.count(F.lit(1)) - 1).alias("repeats"))


@query("o15_idempotency_expiry", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOUR")
def _(s, d):
    return table(s, d, "events").where("ts >= timestamp_ntz '2024-01-31 00:00:00' - interval 48 hours").select("event_id")


@query("o16_audit_list", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def _(s, d):
    return lookups.page(table(s, d, "events"), [F.desc("ts"), F.desc("event_id")], 20, per=["user_id"]).select("user_id", "event_id")


@query("o17_audit_append", "SELECT event_id, sha256(props) AS response_hash FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.sha2("props", 256).alias("response_hash"))


@query("o21_latest_job", f"WITH {D.JO} SELECT repo, job_id, status, git_ref FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, job_id DESC) AS r FROM jo) WHERE r = 1")
def _(s, d):
    return lookups.latest(D.jobs(s, d), ["repo"], "started_at", "job_id").select("repo", "job_id", "status", "git_ref")


@query("o22_pending_sources", "SELECT repo_name, status, row_number() OVER (ORDER BY created_at DESC, repo_name) AS place FROM sources WHERE status <> 'ready'")
def _(s, d):
    p = table(s, d, "sources").where("status <> 'ready'")
    return p.select("repo_name", "status", F.row_number().over(Window.orderBy(F.desc("created_at"), "repo_name")).alias("place"))  # sources is a fixed table


@query("o23_has_active_job", f"WITH {D.JO} SELECT repo, bool_or(status NOT IN ('done', 'completed', 'failed')) AS active FROM jo GROUP BY 1")
def _(s, d):
    return D.jobs(s, d).groupBy("repo").agg(F.bool_or(~F.col("status").isin("done", "completed", "failed")).alias("active"))


@query("o26_corpus_page_paths", "SELECT repo_name, doc_path FROM documents WHERE ends_with(doc_path, '.md')")
def _(s, d):
    return table(s, d, "documents").where(F.col("doc_path").endswith(".md")).select("repo_name", "doc_path")


@query("o28_usage", "SELECT user_id, event_type AS kind, count(*) AS n, round(sum(value), 4) AS tokens FROM events GROUP BY ALL")
def _(s, d):
    return table(s, d, "events").groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("tokens"))


# --- stateful operators, as batch ---------------------------------------------


@query("t2_counter_delta", "SELECT event_id, round(CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END, 6) AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS b FROM events)")
def _(s, d):
    return op.counter_delta(table(s, d, "events"), ["user_id", "event_type"], "ts", "value").select("event_id", F.round("delta", 6).alias("delta"))


@query("t4_error_rate", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n_errors, count(*) > 5 AS alert FROM events WHERE event_type = 'error' GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").where("event_type = 'error'")
    return e.groupBy(F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count(F.lit(1)).alias("n_errors"), (F.count(F.lit(1)) > 5).alias("alert"))


@query("t5_quota_floor", "SELECT user_id, min(value) AS least FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING min(value) < 10")
def _(s, d):
    return table(s, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("value").alias("least")).where("least < 10")


@query("t6_failure_streaks", "WITH b AS (SELECT user_id, tick FROM (SELECT user_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts)) AS BIGINT) AS tick, avg(value) AS v FROM events GROUP BY 1, 2) WHERE v > 40), g AS (SELECT *, tick - row_number() OVER (PARTITION BY user_id ORDER BY tick) AS k FROM b) SELECT user_id, min(tick) AS first, max(tick) AS last, count(*) AS length FROM g GROUP BY user_id, k HAVING count(*) >= 2")
def _(s, d):
    e = table(s, d, "events").withColumn("tick", F.expr("timestampdiff(HOUR, timestamp_ntz '2024-01-01 00:00:00', date_trunc('HOUR', ts))"))
    t = e.groupBy("user_id", "tick").agg(F.avg("value").alias("v"))
    return op.streaks(t, "user_id", "tick", F.col("v") > 40).where("length >= 2")


@query("t7_write_spike", "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return table(s, d, "events").groupBy(F.window("ts", "1 minute")["start"].alias("minute")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("t13_metrics", "SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n, round(sum(value), 3) AS total FROM events, (SELECT unnest([5.0, 10.0, 25.0, 50.0, 1e9]) AS le) GROUP BY ALL")
def _(s, d):
    """A histogram for each type: samples up to each bound, and their sum; one pass, bounds as columns."""
    bounds = [5.0, 10.0, 25.0, 50.0, 1e9]
    g = table(s, d, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.round(F.sum("value"), 3).alias("total"))
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]))
    return g.select("event_type", cells.alias("c"), "total").select("event_type", "c.le", "c.n", "total")


# --- evaluation ---------------------------------------------------------------


@query("m3_eval_corpus", f"WITH {D.CH} SELECT id, fqn, doc FROM ch WHERE trim(doc) <> ''")
def _(s, d):
    return D.chunks(s, d, ["fqn", "doc", "ingested_at"]).where(F.trim("doc") != "").select("id", "fqn", "doc")


_RANK = "q AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), sc AS (SELECT q.vec_id AS query, e.vec_id AS hit, q.label = e.label AS relevant, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 6) DESC, e.vec_id) - 1 AS rank FROM q, e WHERE q.vec_id <> e.vec_id), fr AS (SELECT query, min(rank) AS rank FROM sc WHERE relevant GROUP BY 1)"


@query("m1_ir_metrics", f"WITH {_RANK} SELECT round(avg(1.0 / (rank + 1)), 6) AS mrr, round(avg(CASE WHEN rank < 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank < 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(CASE WHEN rank < 10 THEN 1.0 / log2(rank + 2) ELSE 0 END), 6) AS ndcg_10 FROM fr")
def _(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"), F.col("label").alias("l"))
    sc = e.join(F.broadcast(q), F.col("vec_id") != F.col("query"))  # the query set against all rows
    sc = sc.select("query", "vec_id", (F.col("l") == F.col("label")).alias("relevant"), F.round(op.cosine(F.col("v"), F.col("embedding")), 6).alias("c"))
    r = sc.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("c"), "vec_id")) - 1).where("relevant").groupBy("query").agg(F.min("rank").alias("rank"))
    k = F.col("rank")
    return r.agg(F.round(F.avg(1 / (k + 1)), 6).alias("mrr"), F.round(F.avg(F.when(k < 1, 1.0).otherwise(0.0)), 6).alias("recall_1"), F.round(F.avg(F.when(k < 10, 1.0).otherwise(0.0)), 6).alias("recall_10"), F.round(F.avg(F.when(k < 10, 1 / F.log2(k + 2)).otherwise(0.0)), 6).alias("ndcg_10"))
