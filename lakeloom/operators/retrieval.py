"""Lexical and vector retrieval, rank fusion and selection within a budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Rows and queries of the blocks that are multiplied; what rounding to six digits can change of a score, and more.
ROW_BLOCK, QUERY_BLOCK = 1024, 256
CLOSE = 1.1e-6
#: Terms that the queries of one lexical search may have.
MOST_TERMS = 1000


def terms(c: Column) -> Column:
    """Lower-case words of a text: runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lexical(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(query, key, score, rank): texts with all terms of a query, by term frequency over length.

    ``queries``: query, term; at most ``MOST_TERMS`` terms, which are checked here.
    The score is the sum over the terms of 1 + ln(frequency), over 1 + ln(words).
    A text's words are cut to the queries' terms before they become rows.
    """
    wanted = [r["term"] for r in queries.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(wanted) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    split = docs.select(F.col(key).alias("key"), terms(F.col(text)).alias("_w"))
    words = split.select("key", F.size("_w").alias("len"), F.explode(F.filter("_w", lambda x: x.isin(wanted))).alias("term"))
    tf = words.groupBy("key", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    need = queries.groupBy("query").agg(F.count(F.lit(1)).alias("need"))
    hit = tf.join(F.broadcast(queries), "term").groupBy("query", "key", "len").agg(F.count(F.lit(1)).alias("got"), F.sum(1 + F.log("tf")).alias("s"))
    hit = hit.join(F.broadcast(need), "query").where("got = need")
    hit = hit.withColumn("score", F.round(F.col("s") / (1 + F.log(F.col("len"))), 6))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return hit.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("query", "key", "score", "rank")


class _Vectors:
    """The vectors of one width, as rows of a matrix; those whose norm is no common number are ``odd``."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float64)
        with np.errstate(all="ignore"):
            square = np.zeros(len(x))
            for i in range(self.x.shape[1]):  # added in order, as the column expression does
                square += self.x[:, i] * self.x[:, i]
            self.norm = np.sqrt(square)
            self.odd = np.flatnonzero(~((self.norm > 1e-100) & (self.norm < 1e100)))
            self.unit = self.x / self.norm[:, None]
        self.unit[self.odd] = 0

    def cosine(self, at: np.ndarray, other: _Vectors, its: np.ndarray) -> np.ndarray:
        """``curation.cosine`` of pairs, to the last bit."""
        dot = np.zeros(len(at))
        with np.errstate(all="ignore"):
            for i in range(self.x.shape[1]):
                dot += self.x[at, i] * other.x[its, i]
            n = self.norm[at] * other.norm[its]
            return np.where(n <= 0, 0.0, dot / n)

    def near(self, begin: int, end: int, other: _Vectors, first: int, last: int) -> np.ndarray:
        """Cosines of a block of rows with a block of the others, but for the last bits; not a number counts as the greatest."""
        out = self.unit[begin:end] @ other.unit[first:last].T
        rows, cols = (v.odd[(v.odd >= a) & (v.odd < z)] for v, a, z in ((self, begin, end), (other, first, last)))
        for r in rows:
            out[r - begin] = np.nan_to_num(self.cosine(np.full(last - first, r), other, np.arange(first, last)), nan=np.inf)
        for c in cols:
            out[:, c - first] = np.nan_to_num(self.cosine(np.arange(begin, end), other, np.full(end - begin, c)), nan=np.inf)
        return out


def _widths(col: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors by width; null lists and those with a null, which have no cosine, are of width 0."""
    size, flat = np.diff(col.offsets.to_numpy()), col.flatten()
    size = np.where(col.is_valid().to_numpy(zero_copy_only=False), size, 0)
    start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    values = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        of = np.repeat(np.arange(len(size)), size)
        size = np.where(np.bincount(of[flat.is_null().to_numpy(zero_copy_only=False)], minlength=len(size)) > 0, 0, size)
    return {int(w): (at := np.flatnonzero(size == w), values[start[at][:, None] + np.arange(w)]) for w in np.unique(size)}


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, score, rank): the k rows with the greatest cosine of each query vector.

    ``queries``: query, v; a set whose size is checked by the caller, against all
    rows.  Blocks of rows and queries are multiplied as matrices; a pair whose
    product is within what rounding can change of the k-th best that its task has
    seen gets its cosine in the order of the column expression, and is ranked by it.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)[key]
    asked = queries.select("query", F.col("v").cast("array<double>").alias("v")).toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, asked.schema) as w:
        w.write_table(asked)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        if not asked.num_rows:
            return
        names = pa.concat_arrays(asked.column("query").chunks)
        groups = [(w, at, _Vectors(x)) for w, (at, x) in _widths(pa.concat_arrays(asked.column("v").chunks)).items()]
        best = [np.full((k, len(at)), -np.inf) for _, at, _ in groups]
        for b in batches:
            keys = b.column("key")
            for width, (place, x) in _widths(b.column("v")).items():
                mine = _Vectors(x)
                for (w, at, theirs), top in zip(groups, best):
                    same = w == width and w > 0
                    use, mine_at = place, np.arange(len(place))
                    if not same and len(use) > k:  # all score 0, so the smallest keys are the best
                        mine_at = pc.sort_indices(keys.take(pa.array(place))).to_numpy()[:k].astype(np.int64)
                        use = place[mine_at]
                    for first in range(0, len(at), QUERY_BLOCK):
                        last = min(first + QUERY_BLOCK, len(at))
                        for begin in range(0, len(use), ROW_BLOCK):
                            end = min(begin + ROW_BLOCK, len(use))
                            near = mine.near(begin, end, theirs, first, last) if same else np.zeros((end - begin, last - first))
                            r, c = np.nonzero(near >= top[0, first:last] - CLOSE)
                            if not len(r):
                                continue
                            s = near[r, c]
                            order = np.lexsort((-s, c))
                            within = np.arange(len(c)) - np.searchsorted(c[order], c[order])
                            kept = order[within < k]
                            new = np.full((k, last - first), -np.inf)
                            new[within[within < k], c[kept]] = s[kept]
                            top[:, first:last] = np.sort(np.vstack([top[:, first:last], new]), axis=0)[-k:]
                            hit = s >= top[0, first:last][c] - CLOSE
                            r, c = r[hit] + begin, c[hit] + first
                            score = mine.cosine(r, theirs, c) if same else np.zeros(len(r))
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(at[c])), keys.take(pa.array(use[r])), pa.array(score)], ["query", "key", "score"])

    j = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    j = j.mapInArrow(run, f"query {dict(queries.dtypes)['query']}, key {kind}, score double").withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return j.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def fuse(lists: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """(query, key, rrf): sum of weight / (k + rank + 1) over ranked lists; ranks count from 0."""
    out = None
    for df, weight in lists:
        one = df.select("query", "key", (F.lit(weight) / (k + F.col("rank") + 1)).alias("w"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("query", "key").agg(F.round(F.sum("w"), 9).alias("rrf"))


def boosted(fused: DataFrame, space: Column, prefer: str, boost: float = 1.5) -> DataFrame:
    """The preferred space's scores times the boost, after fusion."""
    return fused.withColumn("rrf", F.when(space == prefer, F.col("rrf") * boost).otherwise(F.col("rrf")))


def within_budget(ranked: DataFrame, per: str, order: list, cost: str, budget: int, key: str = "key") -> DataFrame:
    """Rows that a greedy choice keeps: in order, each that still fits; later, smaller ones may fit again.

    ``ranked`` holds a bounded list per group, so the fold is over a short array.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(cost).alias("cost"), F.col(key).alias("item"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(ranked.dtypes)[key]}>").alias("kept"))

    def step(acc, x):
        fits = acc["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["kept"], x["item"])).otherwise(acc["kept"]).alias("kept"))

    g = ranked.withColumn("cost", F.col(cost).cast("long")).groupBy(per).agg(F.aggregate(items, start, step).alias("a"))
    return g.select(per, F.posexplode("a.kept").alias("place", key))


def rule_signal(q: Column) -> tuple[Column, Column]:
    """(confidence, leaning to symbols) of a query's form: names, paths and back-ticks against questions."""
    name = q.rlike(r"[A-Z][a-z]+[A-Z]|[a-z]+_[a-z]+")
    dotted, ticked, asks = q.rlike(r"\w(?:\.|::)\w"), q.contains("`"), q.rlike(r"(?i)^(?:how|what|why|when|where|who|which)\b|\?\s*$")
    conf = F.when(name, 0.6).otherwise(0.0) + F.when(dotted, 0.3).otherwise(0.0) + F.when(ticked, 0.5).otherwise(0.0) + F.when(asks, 0.3).otherwise(0.0)
    lean = F.when(name, 0.6).otherwise(0.0) + F.when(dotted, 0.3).otherwise(0.0) + F.when(ticked, 0.4).otherwise(0.0) - F.when(asks, 0.3).otherwise(0.0)
    none = ~(name | dotted | ticked | asks)
    return F.when(none, 0.1).otherwise(F.least(F.lit(1.0), conf)), F.when(none, 0.4).otherwise(lean)


def every_hundredth(key: Column) -> Column:
    """The stated query set of a search: about every hundredth id, by its digest."""
    return F.substring(F.md5(key.cast("string")), 1, 2) < "03"


def query_weights(confidence: Column, lean: Column, archetype: Column) -> tuple[Column, Column]:
    """(symbol weight, concept weight): the rule's leaning by its confidence, the archetype's by the rest, within .05 and .95."""
    symbol = F.greatest(F.lit(0.05), F.least(F.lit(0.95), lean * confidence + archetype * (1 - confidence)))
    return symbol, 1 - symbol


def archetype_signal(symbol: Column, concept: Column) -> Column:
    """The share of the symbol archetype's similarity; a half where there is none."""
    total = symbol + concept
    return F.when(total > 0, symbol / total).otherwise(0.5)
