"""Further queries of scalar functions, fusion, stateful and evaluation operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import text as fn
from lakeloom.operators import curation, graph, lookups
from lakeloom.operators import retrieval as rt
from lakeloom.plans import domain as D
from lakeloom.plans import graph as g
from lakeloom.plans import retrieval as r
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


@query("q31_module_paths", f"WITH {D.MO} SELECT module_id, path FROM mo")
def _(s, d):
    return D.modules(D.chunks(s, d)).select("module_id", "path")


@query("e19_go_receiver", f"WITH {D.CH} SELECT id, regexp_extract(content, 'func\\s*\\(\\s*\\w*\\s*\\*?\\s*(\\w+)\\s*\\)', 1) AS receiver FROM ch WHERE language = 'go' AND chunk_type = 'method' AND regexp_matches(content, 'func\\s*\\(\\s*\\w*\\s*\\*?\\s*(\\w+)\\s*\\)')")
def _(s, d):
    ch = D.chunks(s, d, ["content", "language", "chunk_type", "ingested_at"]).where("language = 'go' and chunk_type = 'method'")
    return ch.select("id", fn.go_receiver(F.col("content")).alias("receiver")).where("receiver is not null")


@query("s16_encode_path", f"WITH {D.MO} SELECT module_id, replace(url_encode(path), '%2F', '/') AS coded FROM mo")
def _(s, d):
    return D.modules(D.chunks(s, d)).select("module_id", fn.encode_path(F.col("path")).alias("coded"))


@query("s22_cosine", "SELECT a.vec_id, round(greatest(0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(s, d):
    e = table(s, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v"))
    return e.join(b, "vec_id").select("vec_id", F.round(F.greatest(F.lit(0.0), curation.cosine(F.col("embedding"), F.col("v"))), 6).alias("cosine"))


@query("s26_metric_lines", "SELECT event_id, event_type AS label, round(value, 4) AS value FROM events WHERE event_id % 5 <> 0")
def _(s, d):
    """Pages of three lines: a remark, a line that is none or a sample, a blank one; only samples count."""
    e = table(s, d, "events")
    sample = F.format_string('hits_total{type="%s",id="%d"} %s', "event_type", "event_id", F.col("value").cast("string"))
    page = F.concat(F.lit("# HELP hits_total x\n"), F.when(F.col("event_id") % 5 == 0, F.format_string("hits_total{id=%d", "event_id")).otherwise(sample), F.lit("\n"))
    p = r"^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)$"
    x = e.select(F.explode(F.split(page, "\n")).alias("l")).where(~F.col("l").startswith("#") & F.col("l").rlike(p))
    labels = F.str_to_map(F.regexp_replace(F.regexp_extract("l", p, 2), '"', ""), F.lit(","), F.lit("="))
    return x.select(labels["id"].cast("long").alias("event_id"), labels["type"].alias("label"), F.round(F.regexp_extract("l", p, 3).cast("double"), 4).alias("value"))


@query("r1_positional_rank", f"WITH {r._HYBRID} SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, key) - 1 AS rank FROM fu")
def _(s, d):
    w = Window.partitionBy("query").orderBy(F.desc("rrf"), "key")
    return r._fused(s, d).select("query", "key", (F.row_number().over(w) - 1).alias("rank"))


@query("r3_multi_source_rrf", f"WITH {r._HYBRID} SELECT query, key, round(sum(w), 9) AS rrf FROM (SELECT query, key, 1.0 / (60 + rank + 1) AS w FROM lx WHERE rank < 10 UNION ALL SELECT query, key, 1.2 / (60 + rank + 1) FROM vs UNION ALL SELECT query, key, 0.8 / (60 + rank + 1) FROM vs) GROUP BY ALL")
def _(s, d):
    lx = rt.lexical(table(s, d, "documents").select("doc_id", "text"), r._query_terms(s), "doc_id", "text", 10)
    e = table(s, d, "embeddings")
    q = e.where("vec_id < 8").select(F.col("vec_id").cast("int").alias("query"), F.col("embedding").alias("v"))
    vs = rt.nearest(e, q, "vec_id", "embedding", 10)
    return rt.fuse([(lx, 1.0), (vs, 1.2), (vs, 0.8)])


@query("c1_cluster_counts", f"WITH {D.SE}, k AS (SELECT doc_id, count(*) AS n FROM se GROUP BY 1) SELECT doc_id, CAST(CASE WHEN n < 4 THEN 0 ELSE greatest(2, least(10, ceil(n / 8.0))) END AS INTEGER) AS k FROM k")
def _(s, d):
    n = lookups.counts(D.sections(s, d), "doc_id")
    k = F.greatest(F.lit(2), F.least(F.lit(10), F.ceil(F.col("n") / 8)))
    return n.select("doc_id", F.when(F.col("n") < 4, 0).otherwise(k).cast("int").alias("k"))


@query("g47_impact_report", g._IMPACT + " SELECT node, round(score, 5) AS score FROM sc ORDER BY round(score, 5) DESC, node LIMIT 100")
def _(s, d):
    i = graph.impact(g._impact_paths(s, d)).select("node", F.round("score", 5).alias("score"))
    return i.orderBy(F.desc("score"), "node").limit(100)  # the report's size


@query("o19_snapshot_import", f"WITH {D.CH} SELECT repo_name, count(*) AS n, count(DISTINCT module_path) AS n_files FROM ch WHERE repo_name = 'atlas-hub' GROUP BY 1")
def _(s, d):
    """One repository is read back from an export; only its partition is scanned."""
    path = f"{shared_dir(s)}/lakeloom/snapshot-{uuid.uuid4().hex}"
    snapshots.export({"chunks": D.chunks(s, d, ["repo_name", "module_path", "ingested_at"])}, path)
    c = snapshots.restore(s, path, "chunks", "atlas-hub")
    return c.groupBy("repo_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("module_path").alias("n_files"))


_TICKS = "dy AS (SELECT date_trunc('day', ts) AS tick, count(*) FILTER (WHERE event_type = 'error') AS k FROM events GROUP BY 1), sp AS (SELECT tick, CAST(CASE WHEN day(tick) % 7 = 0 THEN k ELSE sum(k) OVER (ORDER BY tick) END AS DOUBLE) AS value FROM dy)"


@query("t8_drain_timeouts", f"WITH {_TICKS} SELECT tick, CASE WHEN value < b THEN value ELSE value - b END AS delta FROM (SELECT *, lag(value) OVER (ORDER BY tick) AS b FROM sp) WHERE b IS NOT NULL AND CASE WHEN value < b THEN value ELSE value - b END > 0")
def _(s, d):
    """The alert of a counter that grew since the tick before; one row a day, and a reset in every week."""
    days = table(s, d, "events").groupBy(F.date_trunc("day", "ts").alias("tick")).agg(F.count_if(F.col("event_type") == "error").alias("k"))
    days = days.withColumn("rule", F.lit("drain_timeouts"))  # a row for each tick of the evaluator
    total = F.sum("k").over(Window.partitionBy("rule").orderBy("tick"))
    samples = days.withColumn("value", F.when(F.dayofmonth("tick") % 7 == 0, F.col("k")).otherwise(total).cast("double"))
    return curation.counter_delta(samples, ["rule"], "tick", "value").where("delta > 0").select(F.col("tick").cast("timestamp_ntz").alias("tick"), "delta")


#: Two ways to answer from a document: its beginning, and all of it; the answer is there if it names the budget.
_ITEMS = """it AS (SELECT doc_id, coalesce(lower(trim(source)), 'none') AS category, strategy, strlen(t) AS bytes, CAST(length(t) // 4 AS BIGINT) AS tokens, CASE WHEN contains(lower(t), 'budget') THEN 1.0 ELSE 0.0 END AS recall
  FROM (SELECT doc_id, source, 'graph' AS strategy, left(text, 200) AS t FROM documents WHERE text <> '' UNION ALL SELECT doc_id, source, 'grep', text FROM documents WHERE text <> ''))"""


def _items(s, d):
    t = table(s, d, "documents").where("text <> ''")
    two = F.explode(F.array(F.struct(F.lit("graph").alias("strategy"), F.substring("text", 1, 200).alias("t")), F.struct(F.lit("grep").alias("strategy"), F.col("text").alias("t"))))
    t = t.select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("category"), two.alias("x")).select("doc_id", "category", "x.*")
    return t.select("doc_id", "category", "strategy", F.octet_length("t").cast("long").alias("bytes"), F.floor(F.length("t") / 4).cast("long").alias("tokens"), F.when(F.lower("t").contains("budget"), 1.0).otherwise(0.0).alias("recall"))


@query("m5_strategy_aggregate", f"WITH {_ITEMS} SELECT strategy, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(bytes) AS BIGINT) AS bytes, round(avg(recall), 6) AS recall FROM it GROUP BY 1")
def _(s, d):
    return _items(s, d).groupBy("strategy").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"), F.round(F.avg("recall"), 6).alias("recall"))


_RATIO = f"{_ITEMS}, ra AS (SELECT category, round(sum(tokens) FILTER (WHERE strategy = 'graph') / nullif(sum(tokens) FILTER (WHERE strategy = 'grep'), 0), 6) AS ratio FROM it GROUP BY 1)"


def _ratios(s, d):
    of = lambda x: F.sum(F.when(F.col("strategy") == x, F.col("tokens")).otherwise(0))
    return _items(s, d).groupBy("category").agg(F.round(F.try_divide(of("graph"), of("grep")), 6).alias("ratio"))


@query("m6_category_ratios", f"WITH {_RATIO} SELECT category, ratio FROM ra UNION ALL SELECT '(macro)', round(avg(ratio), 5) FROM ra")
def _(s, d):
    """Tokens of one way over the other per category, none where the baseline has none, and the mean of the categories."""
    r = _ratios(s, d)
    return r.unionByName(r.agg(F.round(F.avg("ratio"), 5).alias("ratio")).select(F.lit("(macro)").alias("category"), "ratio"))


@query("m8_report_table", f"WITH {_ITEMS} SELECT coalesce(category, '(overall)') AS category, CAST(sum(tokens) FILTER (WHERE strategy = 'graph') AS BIGINT) AS tokens, CAST(sum(tokens) FILTER (WHERE strategy = 'grep') AS BIGINT) AS baseline, round(100 * (1 - sum(tokens) FILTER (WHERE strategy = 'graph') / nullif(sum(tokens) FILTER (WHERE strategy = 'grep'), 0)), 2) AS saved, round(avg(recall) FILTER (WHERE strategy = 'graph'), 4) AS recall FROM it GROUP BY ROLLUP (category)")
def _(s, d):
    """A row per category and one over all: tokens of both ways, what is saved, and beside it the recall."""
    of = lambda x, c: F.sum(F.when(F.col("strategy") == x, F.col(c)))
    r = _items(s, d).rollup("category").agg(of("graph", "tokens").alias("tokens"), of("grep", "tokens").alias("baseline"), F.round(F.avg(F.when(F.col("strategy") == "graph", F.col("recall"))), 4).alias("recall"))
    return r.select(F.coalesce("category", F.lit("(overall)")).alias("category"), "tokens", "baseline", F.round(100 * (1 - F.try_divide("tokens", "baseline")), 2).alias("saved"), "recall")


_LINES = "dl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text <> '')"


@query("m7_grep_baseline", f"WITH {_LINES}, h AS (SELECT *, contains(line, 'token budget') AS hit FROM dl), c AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY doc_id ORDER BY pos), false) OR coalesce(lead(hit) OVER (PARTITION BY doc_id ORDER BY pos), false) AS near FROM h) SELECT doc_id, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit OR near) AS lines FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE hit) > 0")
def _(s, d):
    """Lines that match, with one line around them."""
    docs = table(s, d, "documents").where("text <> ''").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    h = docs.withColumn("hit", F.col("line").contains("token budget"))
    h = h.withColumn("near", F.coalesce(F.lag("hit").over(w), F.lit(False)) | F.coalesce(F.lead("hit").over(w), F.lit(False)))
    return h.groupBy("doc_id").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit") | F.col("near")).alias("lines")).where("hits > 0")
