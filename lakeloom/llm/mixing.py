"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until the sources
have their targets and languages and topics keep their shares of the corpus as
far as the sources allow; no weight passes the source's repeat cap.  The cells'
weights are the expected number of copies of their documents.  Copies are drawn
along documents from large to small, by the hash within a size class: a document
is given when the tokens owed so far are at least half of its own.  So the drawn
tokens of a bucket end within half a document of the expected ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import tokens
from lakeloom.sources.tables import Scratch

#: Cells that the driver rakes; more of them are raked in Spark, by the same rounds to the same end.
MOST_CELLS = 500_000
ROUNDS, CLOSE = 200, 1e-9
#: Digits of a weight, few enough that the order of adding and a round more or less change none.
DIGITS = 7
#: Documents of one sampling bucket, about.
BUCKET = 20_000


def source_key(c) -> "F.Column":
    """Source names are equal regardless of letter case and outer blanks."""
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def allocate(size: np.ndarray, share: np.ndarray, cap: np.ndarray, total: float) -> np.ndarray:
    """Target sizes by share that no cap is passed by; what capped sources can't give goes to the others by share."""
    target, free = np.zeros(len(size)), (size > 0) & (share > 0)
    most = size * cap
    left = min(total, float(most[free].sum()))
    while left > 1e-9 and free.any():
        want = left * share[free] / share[free].sum()
        over = want >= most[free]
        idx = np.flatnonzero(free)
        if not over.any():
            target[idx] = want
            break
        target[idx[over]] = most[idx[over]]
        left -= float(most[idx[over]].sum())
        free[idx[over]] = False
    return target


def _fill(size: np.ndarray, weight: np.ndarray, cap: float, target: float) -> np.ndarray:
    """Scaled weights whose tokens are the target, none above the cap."""
    if target <= 0 or size.sum() <= 0:
        return np.zeros(len(size))
    if size.sum() * cap <= target:
        return np.full(len(size), cap)
    w, fixed = weight.copy(), np.zeros(len(size), dtype=bool)
    while True:
        room = target - cap * size[fixed].sum()
        scale = room / max((size * w)[~fixed].sum(), 1e-300)
        over = ~fixed & (w * scale > cap)
        if not over.any():
            return np.where(fixed, cap, w * scale)
        fixed |= over


def rake(cells: list[tuple[int, int, int, float]], targets: np.ndarray, caps: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, last change): weight of every cell (source, language, topic, tokens) after raking.

    The sources' targets hold exactly.  The last change is the greatest of a
    weight in the last round; it is over ``CLOSE`` where the rounds ended first.
    """
    s, l, t = (np.array([c[i] for c in cells], dtype=np.int64) for i in range(3))
    size = np.array([c[3] for c in cells], dtype=np.float64)
    w = np.ones(len(cells))
    total = targets.sum()
    margins = []
    for of in (l, t):
        have = np.bincount(of, weights=size)
        margins.append((of, have / max(have.sum(), 1e-300) * total))
    order = np.argsort(s, kind="stable")
    ends = np.searchsorted(s[order], np.arange(len(targets) + 1))
    rows = [order[ends[i] : ends[i + 1]] for i in range(len(targets))]
    change = 0.0
    for _ in range(ROUNDS):
        before = w.copy()
        for of, want in margins:
            now = np.bincount(of, weights=size * w, minlength=len(want))
            w = w * np.where(now > 0, want / np.maximum(now, 1e-300), 1.0)[of]
        for i, r in enumerate(rows):
            if len(r):
                w[r] = _fill(size[r], np.maximum(w[r], 1e-12), float(caps[i]), float(targets[i]))
        change = float(np.abs(w - before).max(initial=0))
        if change < CLOSE:
            break
    return w, change


def rake_table(cells: DataFrame, plan: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """The cells of ``raked_table``."""
    return raked_table(cells, plan, scratch, rounds)[0]


def raked_table(cells: DataFrame, plan: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """``rake`` on a table of cells (source, lang, topic, n), for any number of them: the cells with their ``weight``, and the last change.

    ``plan``: (source, cap, target).  A source's cells are one group, as its cap
    binds them together; languages and topics are scaled by joins.  Each round is
    a stored table.
    """
    total = plan.agg(F.sum("target").alias("_total"))
    size = cells.agg(F.sum("n").alias("_size"))
    ratio = total.join(F.broadcast(size), how="inner").select((F.col("_total") / F.col("_size")).alias("_ratio"))  # one row
    rows = scratch.save(cells.join(plan, "source").join(F.broadcast(ratio), how="inner").withColumns({"weight": F.lit(1.0), "change": F.lit(0.0)}), "cells")

    def fill(pdf):
        pdf["weight"] = _fill(pdf["n"].to_numpy(float), np.maximum(pdf["weight"].to_numpy(float), 1e-12), float(pdf["cap"].iloc[0]), float(pdf["target"].iloc[0]))
        pdf["change"] = (pdf["weight"] - pdf["change"]).abs()
        return pdf

    change = 0.0
    for _ in range(rounds):
        step = rows.withColumn("change", F.col("weight"))
        for margin in ("lang", "topic"):
            now = F.sum(F.col("n") * F.col("weight"))
            scale = step.groupBy(margin).agg(F.when(now > 0, F.sum("n") * F.first("_ratio") / now).otherwise(1.0).alias("_scale"))
            step = step.join(scale, margin).withColumn("weight", F.col("weight") * F.col("_scale")).drop("_scale")
        step = scratch.save(step.select(*rows.columns).groupBy("source").applyInPandas(fill, rows.schema), "cells")
        scratch.drop(rows)
        rows, change = step, step.agg(F.max("change")).first()[0] or 0.0
        if change < CLOSE:
            break
    return rows.drop("change"), change


def sized(spark: SparkSession, docs: DataFrame, targets: DataFrame, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """Saved (doc_id, source, lang, topic, n_tokens) of the listed sources' documents that have tokens.

    The topic is the kind of repository that a text is about, the last part of its name.
    """
    listed = F.broadcast(targets.select(source_key(F.col("source")).alias("source")).distinct())  # one row per target
    mine = docs.withColumn("source", source_key(F.col("source"))).join(listed, "source", "left_semi")
    counts = tokens.token_counts(spark, mine, folder=folder)
    topic = F.coalesce(F.nullif(F.regexp_extract("repo_name", r"([^\-/]+)$", 1), F.lit("")), F.lit("?"))
    rows = mine.select("doc_id", "source", F.coalesce(F.lower("lang"), F.lit("?")).alias("lang"), topic.alias("topic")).join(counts, "doc_id")
    return Scratch(spark, "mixing").save(rows.where("n_tokens > 0"), "sized")


def weights(spark: SparkSession, rows: DataFrame, targets: DataFrame, most_cells: int = MOST_CELLS) -> tuple[DataFrame, list[tuple], float]:
    """(rows with their cell's weight, plan of the listed sources, last change of the raking).

    plan: (source, share, cap, size, target).  Every language and topic is a margin of its own.
    ``most_cells`` says where the cells are raked; the weights are the same.
    """
    scratch = Scratch(spark, "mixing")
    cells = scratch.save(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n")), "cells")
    sizes = {r["source"]: r["n"] for r in cells.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row per target at most
    want = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").collect()
    names = [r["source"] for r in want]
    size = np.array([float(sizes.get(n) or 0) for n in names])
    share, cap = np.array([float(r["share"] or 0) for r in want]), np.array([float(max(1 if r["cap"] is None else r["cap"], 0)) for r in want])
    target = allocate(size, share, cap, float(size.sum()))
    plan = [(n, float(share[i]), int(cap[i]), float(size[i]), float(target[i])) for i, n in enumerate(names)]
    if cells.count() > most_cells:
        table, change = raked_table(cells, spark.createDataFrame([(p[0], p[2], p[4]) for p in plan], "source string, cap int, target double"), scratch)
        return rows.join(table.select("source", "lang", "topic", F.round("weight", DIGITS).alias("weight")), ["source", "lang", "topic"]), plan, change
    got = cells.orderBy("source", "lang", "topic").collect()
    at = {n: i for i, n in enumerate(names)}
    li, ti = ({v: i for i, v in enumerate(sorted({c[k] for c in got}))} for k in ("lang", "topic"))
    w, change = rake([(at[c["source"]], li[c["lang"]], ti[c["topic"]], float(c["n"])) for c in got], target, cap) if got else (np.array([]), 0.0)
    table = spark.createDataFrame([(c["source"], c["lang"], c["topic"], round(float(x), DIGITS)) for c, x in zip(got, w)], "source string, lang string, topic string, weight double")
    return rows.join(F.broadcast(table), ["source", "lang", "topic"]), plan, change  # at most MOST_CELLS rows


def _given(n: np.ndarray, weight: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Copies of documents in order: the whole part, and one more when half of the document's tokens are owed."""
    copies = np.minimum(np.floor(weight + 1e-9), cap)
    owed, want = 0.0, (weight - copies) * n
    out = copies.astype(np.int64)
    for i in range(len(n)):
        owed += want[i]
        if owed >= n[i] / 2 and out[i] < cap[i] and weight[i] > 0:
            out[i] += 1
            owed -= n[i]
    return out


def draw(weighted: DataFrame, caps: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, copies) with one copy at least."""
    sizes = weighted.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("buckets")).join(caps, "source")
    rows = weighted.join(F.broadcast(sizes), "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), "buckets").cast("int"))
    rows = rows.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "cap", "bucket", F.floor(F.log2("n_tokens")).alias("class"), F.xxhash64("doc_id", F.lit(1)).alias("h"))

    def run(pdf):
        pdf = pdf.sort_values(["class", "h", "doc_id"], ascending=[False, True, True])
        pdf["copies"] = _given(pdf["n_tokens"].to_numpy(float), pdf["weight"].to_numpy(float), pdf["cap"].to_numpy(float))
        return pdf[["doc_id", "source", "lang", "topic", "n_tokens", "copies"]]

    kind = dict(weighted.dtypes)["doc_id"]
    return rows.groupBy("source", "bucket").applyInPandas(run, f"doc_id {kind}, source string, lang string, topic string, n_tokens long, copies int").where("copies > 0")


@dataclass(frozen=True)
class Mix:
    drawn: DataFrame  # doc_id, source, lang, topic, n_tokens, copies
    report: DataFrame
    margins: DataFrame


def mix(spark: SparkSession, docs: DataFrame, targets: DataFrame, folder: str = tokens.TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(mix, report) of ``mixed``; mix: doc_id, source, n_tokens, copies."""
    m = mixed(spark, docs, targets, folder)
    return m.drawn.select("doc_id", "source", "n_tokens", "copies"), m.report


def mixed(spark: SparkSession, docs: DataFrame, targets: DataFrame, folder: str = tokens.TOKENIZERS) -> Mix:
    """The mix, its report per listed source, and its margins.

    report: the share asked for, the share that its cap and size allow, and the
    share reached.  margins: of every source, language and topic the share asked
    for, the share after raking and the share drawn, with the size of the mix and
    the last change of the raking.  Documents of unlisted or null sources, and
    documents without tokens, are in no mix; a listed source without documents
    reaches 0.
    """
    rows = sized(spark, docs, targets, folder)
    weighted, plan, change = weights(spark, rows, targets)
    caps = spark.createDataFrame([(p[0], p[2]) for p in plan], "source string, cap int")
    drawn = Scratch(spark, "mixing").save(draw(weighted, caps), "mix")
    asked = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, size double, target double")
    whole = sum(p[4] for p in plan)
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    report = asked.join(F.broadcast(got), "source", "left").join(F.broadcast(total), how="inner")  # both have a row per target at most
    report = report.select(
        "source", "target_share", "max_repeats", (F.col("target") / max(whole, 1e-300)).alias("feasible_share"), (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("reached_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.col("size").cast("long").alias("source_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    size = sum(p[3] for p in plan)
    margins = None
    for margin in ("source", "lang", "topic"):
        goal = asked.select(F.col("source").alias("value"), (F.col("target") / max(whole, 1e-300)).alias("asked_share")) if margin == "source" else weighted.groupBy(F.col(margin).alias("value")).agg((F.sum("n_tokens") / max(size, 1e-300)).alias("asked_share"))
        raked = weighted.groupBy(F.col(margin).alias("value")).agg((F.sum(F.col("n_tokens") * F.col("weight")) / max(whole, 1e-300)).alias("raked_share"))
        have = drawn.groupBy(F.col(margin).alias("value")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
        one = goal.join(raked, "value", "left").join(have, "value", "left").join(F.broadcast(total), how="inner")
        one = one.select(F.lit(margin).alias("margin"), "value", "asked_share", F.coalesce("raked_share", F.lit(0.0)).alias("raked_share"), (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("reached_share"), F.col("all_tokens").alias("mix_tokens"), F.lit(size).cast("long").alias("corpus_tokens"), F.lit(change).alias("last_change"))
        margins = one if margins is None else margins.unionByName(one)
    return Mix(drawn, report, margins)
