"""Projections, filters, point and batch lookups of stored records.

Every optional argument becomes a filter only when it is set, so it reaches the
scan.  Batch lookups are semi-joins, never lists of ids on the driver.  Null ids
match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import Scratch


def only(df: DataFrame, **equal) -> DataFrame:
    """The rows with these values; arguments that are None are no condition."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def iso(c) -> Column:
    """A timestamp as ISO 8601 in UTC, to seconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def page(df: DataFrame, order: list, limit: int, offset: int = 0, per: list | None = None) -> DataFrame:
    """One page in a total order; with ``per``, the same page of every group."""
    if per:
        w = Window.partitionBy(*per).orderBy(*order)
        return df.withColumn("_n", F.row_number().over(w)).where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).drop("_n")
    return df.orderBy(*order).offset(offset).limit(limit)


def among(df: DataFrame, ids: DataFrame, key: str = "id", id_col: str = "id") -> DataFrame:
    """The rows whose key is in a set of ids."""
    return df.join(ids.select(F.col(id_col).alias(key)).distinct(), key, "left_semi")


def counts(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def largest(df: DataFrame, per: list[str], by: str, tie: str, k: int) -> DataFrame:
    """The k rows of every group with the greatest ``by``; ties by ``tie``."""
    return page(df, [F.desc(by), tie], k, per=per)


def latest(df: DataFrame, per: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of every group; ties go to the greatest ``tie``."""
    w = Window.partitionBy(*per).orderBy(F.desc(time), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key (plain files know no MERGE)."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def escape_like(c: Column) -> Column:
    """A text for LIKE in which wildcards stand for themselves."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def symbol_candidates(ch: DataFrame, name: str, module_hint: str | None = None, kind: str | None = None, repo: str | None = None, limit: int = 50) -> DataFrame:
    """Chunks that a name may mean: by full name, by the end of it, or by plain name."""
    df = only(ch, repo_name=repo, chunk_type=kind).where((F.col("fqn") == name) | F.col("fqn").endswith("." + name) | (F.col("name") == name))
    if module_hint:
        df = df.where(F.lower("module_path").contains(module_hint.lower()))
    return df.orderBy("id").limit(limit)


def visibility_rank(c: str = "visibility") -> Column:
    v = F.lower(F.coalesce(F.col(c), F.lit("")))
    return F.when(v.contains("public") | v.contains("export"), 4).when(v.contains("crate"), 3).when(v.contains("protected"), 2).when(v.contains("private"), 1).otherwise(0)


def rank_candidates(df: DataFrame, name: str) -> DataFrame:
    """Exact full names first, then ends of full names, then plain names; the visible before the hidden."""
    precision = F.when(F.col("fqn") == name, 3).when(F.col("fqn").endswith("." + name), 2).when(F.col("name") == name, 1).otherwise(0)
    df = df.withColumns({"precision": precision, "visible": visibility_rank()})
    w = Window.orderBy(F.desc("precision"), F.desc("visible"), "module_path", F.asc_nulls_first("fqn"), "id")
    return df.withColumn("place", F.row_number().over(w))  # over the bounded candidate list


def details(request: DataFrame, *tables: DataFrame) -> DataFrame:
    """(pos, id, kind, title): the first table that knows an id, in the order of the request, misses included.

    ``request``: pos, id.  A repeated id is found the first time only.
    """
    known = None
    for i, t in enumerate(tables):
        t = t.select("id", F.struct(F.lit(i).alias("t"), "kind", "title").alias("hit"))
        known = t if known is None else known.unionByName(t)
    known = known.groupBy("id").agg(F.min("hit").alias("hit"))
    first = request.groupBy("id").agg(F.min("pos").alias("first"))
    out = request.join(first, "id").join(known, "id", "left")
    kind = F.when((F.col("pos") == F.col("first")) & F.col("hit").isNotNull(), F.col("hit.kind")).otherwise("Not found")
    return out.select("pos", "id", kind.alias("kind"), F.when(kind != "Not found", F.col("hit.title")).alias("title"))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """With ``name``: the place of every row in the order of the whole table, from 1.

    Rows are cut into ranges of the order, which are stored; places within a
    range are counted from the sizes of the ranges before it, of which there are
    as many as partitions.  So no task sees all rows.
    """
    s = Scratch(df.sparkSession, "ranked")
    rows = s.save(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.withColumn("_base", F.sum("n").over(Window.orderBy("_range")) - F.col("n")).select("_range", "_base")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_place", place).join(F.broadcast(base), "_range").withColumn(name, (F.col("_place") + F.col("_base")).cast("long")).drop("_range", "_place", "_base")
