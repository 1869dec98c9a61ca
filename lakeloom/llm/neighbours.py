"""Most similar vectors by randomly rotated one-bit codes.

Vectors are scaled to length one and put into lists around centroids fitted on a
bounded sample.  Of a vector's offset from its centroid, rotated by a fixed
random rotation, one bit per dimension is kept, with two correction scalars: the
length of the offset and its inner product with its own code.  A query's inner
product with a stored vector is estimated from the packed bits and the scalars;
the estimate's error bound tells which vectors may be among the k best (and
above the least similarity), and only these are compared exactly.

Exact copies of a vector beyond the first ``k + 1`` ids can be among nobody's k
best when ties go to the smaller id, so they are left out before the search.  As
queries, they have the answer of the copy in place ``k + 1``, before which the
same ``k`` smaller ids stand.
Lists over ``BLOCK`` rows are split, and queries go to every part.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import Scratch

#: Rows of the sample that the centroids are fitted on (twice the lists where that is more), and the most lists.
SAMPLE, MOST_LISTS = 30_000, 65_536
#: Bytes of stored rows and queries that one task of the search reads, about.
TASK_BYTES = 48 << 20
#: Stored rows and queries of one block of a list.
BLOCK, QUERY_BLOCK = 4096, 16_384
#: Error bound of an estimate in standard deviations.
EPSILON = 3.0
#: Cosines are compared after rounding to so many digits; ties go to the smaller id.
DIGITS = 9


@dataclass(frozen=True)
class Search:
    k: int = 5
    least: float = -1.0  # pairs below this cosine are no neighbours
    probes: int = 6  # lists that a query visits at least
    share: float = 0.0  # share of the lists that a query visits at least
    copies: bool = True  # answers for copies beyond the first k + 1 too
    mutual_lists: bool = True  # a pair found from one side counts for both


@functools.lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(20240521 + d).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of one row per id with a usable vector, and the vectors' width.

    Null ids, null or empty vectors, vectors with null, NaN or infinite numbers, all-zero
    vectors and vectors of another width than the most frequent one are out.
    """
    df = rows.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    width = df.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    width = width[0]["w"] if width else 0
    df = df.where(F.size("vec") == width)
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.where(finite & F.exists("vec", lambda x: x != 0))
    return df, width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.array(column).flatten()
    return _units(scaled(flat.to_numpy(zero_copy_only=False).reshape(-1, width)))


def scaled(raw: np.ndarray) -> np.ndarray:
    """The rows in single precision, divided by a power of two so that numbers of any size fit; this loses nothing of single ones."""
    x = raw.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]).astype(np.float32)


def _units(raw: np.ndarray) -> np.ndarray:
    """The rows at length one, in double precision."""
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(df: DataFrame, width: int, n: int) -> np.ndarray:
    """Unit centroids from a sample of at most ``SAMPLE`` rows, chosen by a hash of the id."""
    lists = int(min(MOST_LISTS, max(1, round(2 * n**0.5))))
    size = max(SAMPLE, 2 * lists)
    share = min(1.0, size / max(n, 1))
    some = df.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * size).select("id", "vec").toArrow()
    some = some.combine_chunks().sort_by("id")
    if some.num_rows == 0:
        return np.zeros((1, width), dtype=np.float32)
    x = _matrix(some.column("vec").combine_chunks(), width).astype(np.float32)
    lists = min(lists, len(x))
    c = x[np.random.default_rng(7).permutation(len(x))[:lists]]
    for _ in range(3):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        sums = np.add.reduceat(x[order], at, axis=0)
        c = c.copy()
        c[near[order][at]] = sums
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


INDEX = "field string, rid long, id string, raw binary, lists array<int>, code binary, own float, away float"


def index(spark: SparkSession, df: DataFrame, width: int, field: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """Codes, correction scalars and the nearest lists of every row, the own list first."""
    shared = spark.sparkContext.broadcast(centroids)
    probes = min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, rot = shared.value, rotation(width)
        for b in batches:
            if b.num_rows == 0:
                continue
            raw = scaled(b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            x = _units(raw).astype(np.float32)
            score = x @ c.T
            if probes < len(c):
                top = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
            else:
                top = np.tile(np.arange(len(c)), (len(x), 1))
            near = np.take_along_axis(score, top, axis=1)
            top = np.take_along_axis(top, np.argsort(-near, axis=1, kind="stable"), axis=1).astype(np.int32)
            offset = (x - c[top[:, 0]]) @ rot.T
            away = np.linalg.norm(offset, axis=1)
            own = np.abs(offset).sum(axis=1) / np.sqrt(width) / np.maximum(away, 1e-12)
            code = np.packbits(offset > 0, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([field] * len(x)), b.column("rid"), b.column("id"), pa.array([r.tobytes() for r in raw]),
                    pa.ListArray.from_arrays(np.arange(0, top.size + 1, top.shape[1], dtype=np.int32), pa.array(top.ravel())),
                    pa.array([r.tobytes() for r in code]), pa.array(own.astype(np.float32)), pa.array(away.astype(np.float32)),
                ],
                ["field", "rid", "id", "raw", "lists", "code", "own", "away"],
            )

    return df.select("rid", "id", "vec").mapInArrow(run, INDEX)


FOUND = "field string, a long, b long, cosine double"


def _search_block(width: int, centroids: dict[str, np.ndarray], s: Search):
    """Within one block of one list: the candidates by bounds, then exact cosines."""

    def run(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        rid = t.column("rid").to_numpy()
        unit = _units(np.frombuffer(b"".join(t.column("raw").to_pylist()), dtype=np.float32).reshape(-1, width))
        field = t.column("field")[0].as_py()
        c = centroids[field][t.column("list")[0].as_py()]
        stored, asked = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        out_a, out_b, out_c = [], [], []
        if len(stored) and len(asked):
            rot = rotation(width)
            codes = np.frombuffer(b"".join(t.column("code").take(pa.array(stored)).to_pylist()), dtype=np.uint8).reshape(len(stored), -1)
            signs = np.unpackbits(codes, axis=1, count=width).astype(np.float32) * 2 - 1
            own = np.maximum(t.column("own").to_numpy()[stored], 1e-3)
            away = t.column("away").to_numpy()[stored]
            spread = (np.sqrt(np.maximum(1 - own**2, 0)) / own * EPSILON / np.sqrt(max(width - 1, 1))).astype(np.float32)
            scaled = signs * (1 / (own * np.sqrt(width)))[:, None].astype(np.float32)
            for lo in range(0, len(asked), 512):
                q = asked[lo : lo + 512]
                offset = (unit[q].astype(np.float32) - c) @ rot.T
                far = np.linalg.norm(offset, axis=1)
                base = 1 - (away[None, :] ** 2 + far[:, None] ** 2) / 2
                est = base + away[None, :] * (offset @ scaled.T)
                err = away[None, :] * far[:, None] * spread[None, :] + 1e-4
                floor = np.full(len(q), s.least - 1e-6, dtype=np.float32)
                if len(stored) > s.k + 1:
                    low = est - err
                    # One more than k, as the query itself may be stored here.
                    floor = np.maximum(floor, -np.partition(-low, s.k, axis=1)[:, s.k])
                qi, di = np.nonzero(est + err >= floor[:, None])
                keep = rid[q[qi]] != rid[stored[di]]
                qi, di = qi[keep], di[keep]
                if not len(qi):
                    continue
                cosine = np.round(np.einsum("ij,ij->i", unit[q[qi]], unit[stored[di]]), DIGITS)
                keep = cosine >= s.least
                qi, di, cosine = qi[keep], di[keep], cosine[keep]
                # The k best of a query in this block, with all ties of the last.
                order = np.lexsort((-cosine, qi))
                qi, di, cosine = qi[order], di[order], cosine[order]
                first = np.searchsorted(qi, qi, side="left")
                place = np.arange(len(qi)) - first
                kth = np.minimum(first + s.k - 1, np.searchsorted(qi, qi, side="right") - 1)
                keep = (place < s.k) | (cosine == cosine[kth])
                out_a.append(rid[q[qi[keep]]]), out_b.append(rid[stored[di[keep]]]), out_c.append(cosine[keep])
        a, b, cos = (np.concatenate(x) if x else np.array([], dtype=kind) for x, kind in ((out_a, np.int64), (out_b, np.int64), (out_c, np.float64)))
        return pa.table({"field": pa.array([field] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(cos, pa.float64())})

    return run


def _blocks(idx: DataFrame, queries: DataFrame) -> DataFrame:
    """Stored rows and queries by (field, list, part, share) of their blocks."""
    at = idx.select("field", F.element_at("lists", 1).alias("list"))
    sizes = at.groupBy("field", "list").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.select("field", F.explode("lists").alias("list")).groupBy("field", "list").agg(F.count(F.lit(1)).alias("q"))
    # One row per list: bounded by MOST_LISTS of each field.
    plan = sizes.join(asked, ["field", "list"]).select(
        "field", "list", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("shares")
    )
    plan = F.broadcast(plan)
    stored = idx.withColumn("list", F.element_at("lists", 1)).join(plan, ["field", "list"])
    stored = stored.withColumn("part", F.pmod(F.xxhash64("rid"), "parts").cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    asked = queries.withColumn("list", F.explode("lists")).join(plan, ["field", "list"])
    asked = asked.withColumn("share", F.pmod(F.xxhash64("rid"), "shares").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cols = ["field", "list", "part", "share"]
    none = F.lit(None)
    return stored.select(*cols, F.lit(0).alias("role"), "rid", "raw", "code", "own", "away").unionByName(
        asked.select(*cols, F.lit(1).alias("role"), "rid", "raw", none.cast("binary").alias("code"), none.cast("float").alias("own"), none.cast("float").alias("away"))
    )


def neighbours(spark: SparkSession, fields: dict[str, tuple[DataFrame, str, str]], s: Search, asked=None) -> DataFrame:
    """(field, id, other, cosine, place): the k most similar other ids of each id.

    ``fields``: field name -> (rows, id column, vector column); each field is a
    collection of its own.  ``asked``: a condition on ``id`` that chooses the
    queries (all rows by default); every row is stored in any case.  Ties in the
    cosine go to the smaller id.  A field without usable vectors has no rows.
    """
    scratch = Scratch(spark, "neighbours")
    plans, saved, copies, centroids, widths, sizes = [], [], [], {}, {}, {}
    for field, (rows, id_col, vec_col) in fields.items():
        df, width = usable(rows, id_col, vec_col)
        if not width:
            continue
        same = Window.partitionBy("vec").orderBy("id")
        df = df.groupBy("id").agg(F.first("vec").alias("vec"))
        upto = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumns({"_copy": F.row_number().over(same), "like": F.nth_value("id", s.k + 1).over(upto)})
        if s.copies:
            df = df.withColumn("vec", F.when(F.col("_copy") <= s.k + 1, F.col("vec")))
        else:
            df = df.where(F.col("_copy") <= s.k + 1)
        df = scratch.save(df.withColumn("rid", F.monotonically_increasing_id()), "vectors")
        saved.append(df)
        if s.copies:
            more = df.where(F.col("_copy") > s.k + 1)
            more = more if asked is None else more.where(asked)
            copies.append(scratch.save(more.select(F.lit(field).alias("field"), F.col("id").alias("copy"), F.col("like").alias("id")), "copies"))
        df = df.where(F.col("_copy") <= s.k + 1).select("id", "vec", "rid")
        sizes[field] = df.count()
        centroids[field] = fit(df, width, sizes[field])
        widths[field] = width
        plans.append(index(spark, df, width, field, centroids[field], max(s.probes, math.ceil(s.share * len(centroids[field])))))
    empty = spark.createDataFrame([], "field string, id string, other string, cosine double, place int")
    if not plans:
        return empty
    idx = scratch.save(functools.reduce(DataFrame.unionByName, plans), "index")
    for df in saved:
        scratch.drop(df)
    copies = functools.reduce(DataFrame.unionByName, copies) if copies else None
    results = []
    for width in sorted(set(widths.values())):
        mine = [f for f, w in widths.items() if w == width]
        own = idx.where(F.col("field").isin(mine))
        queries = own if asked is None else own.where(asked)
        if asked is not None and copies is not None:
            queries = queries.unionByName(own.where(~F.coalesce(asked, F.lit(False))).join(copies, ["field", "id"], "left_semi"))
        run = _search_block(width, {f: centroids[f] for f in mine}, s)
        blocks = _blocks(own, queries)
        # Every stored row comes once, every query once for each list that it visits.
        asked_share = 1.0 if asked is None else 0.02
        rows = sum(sizes[f] * (1 + asked_share * max(s.probes, math.ceil(s.share * len(centroids[f])))) for f in mine)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * (5 * width + 48) / TASK_BYTES))
        results.append(blocks.repartition(tasks, "field", "list", "part", "share").groupBy("field", "list", "part", "share").applyInArrow(run, FOUND))
    found = functools.reduce(DataFrame.unionByName, results)
    if s.mutual_lists and asked is None:
        found = found.unionByName(found.select("field", F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    found = scratch.save(found.distinct(), "pairs")
    ids = idx.select("field", "rid", "id")
    named = found.join(ids.withColumnsRenamed({"rid": "a"}), ["field", "a"]).join(ids.withColumnsRenamed({"rid": "b", "id": "other"}), ["field", "b"])
    best = Window.partitionBy("field", "id").orderBy(F.desc("cosine"), "other")
    out = named.withColumn("place", F.row_number().over(best)).where(F.col("place") <= s.k).select("field", "id", "other", "cosine", "place")
    if copies is None:
        return out
    theirs = copies.join(out, ["field", "id"]).select("field", F.col("copy").alias("id"), "other", "cosine", "place")
    return (out if asked is None else out.where(asked)).unionByName(theirs)


def mutual(found: DataFrame) -> DataFrame:
    """(field, id_a, id_b) of the pairs that are in each other's lists, id_a < id_b."""
    pair = found.select("field", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
    return pair.groupBy("field", "id_a", "id_b").count().where("count = 2").drop("count")


def brute_force(ids: list[str], vectors: np.ndarray, k: int, least: float = -1.0) -> dict[str, list[str]]:
    """The k most similar other ids of each id, for tests."""
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for i, key in enumerate(ids):
        cos = np.round(x @ x[i], DIGITS)
        order = sorted((j for j in range(len(ids)) if j != i and cos[j] >= least), key=lambda j: (-cos[j], ids[j]))[:k]
        out[key] = [ids[j] for j in order]
    return out
