"""References to records that do not exist, by a skew-aware anti-join of counts.

References are pre-aggregated to one row per key, field and period, with their
number and the earliest and latest time in it.  Keys that carry more than
``1 / heavy_share`` of all references are heavy; there are at most
``heavy_share`` of them, which bounds what is broadcast.  The groups of heavy
keys are checked against the targets by a broadcast join, the others by a
shuffled one; what has no target in time is left of both, and the two are
united.  Counts come from the groups alone; single references are looked at
only where rows are asked for, or where a target came within the period.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.tables import Scratch

#: The most keys that may be treated as heavy, hence the most that are broadcast.
HEAVY_SHARE = 500

REF = ["source_table", "source_id", "ref_field", "ref_value", "period", "ref_time"]


@dataclass(frozen=True)
class Keyed:
    """References and the targets that they may name, on the same key columns."""

    refs: DataFrame  # REF columns and the key columns
    targets: DataFrame  # the key columns and live_from
    keys: list[str]
    #: For keys that need more than equality: (reference column, target column);
    #: the target column must contain the reference column.
    contains: tuple[str, str] | None = None


def outer_trim(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def symbol_key(c: Column) -> Column:
    """A symbol as a name: no outer blanks, no final ``()``."""
    return outer_trim(F.regexp_replace(outer_trim(c), r"\(\)$", ""))


def file_key(c: Column) -> Column:
    """A path as stored by the scanner: slashes, no leading ``./``, no line suffix."""
    c = F.translate(outer_trim(c), "\\", "/")
    c = F.regexp_replace(c, r"(:\d+|#L\d+)$", "")
    return F.regexp_replace(c, r"^(\./)+", "")


GROUP = ["source_table", "ref_field", "period"]
#: Targets of one popular name that one task compares with a scope.
NAME_PART = 2000


def _keys(k: Keyed) -> list[str]:
    return k.keys + ([k.contains[0]] if k.contains else [])


def grouped(k: Keyed) -> DataFrame:
    """One row per key, field and period: n_refs, and the first and last time of its references."""
    return k.refs.groupBy(*_keys(k), *GROUP).agg(F.count(F.lit(1)).alias("n_refs"), F.min("ref_time").alias("first"), F.max("ref_time").alias("last"))


def heavy_keys(groups: DataFrame, keys: list[str], heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """At most ``heavy_share`` keys, by an exact total, which is a single row."""
    per_key = groups.groupBy(*keys).agg(F.sum("n_refs").alias("n"))
    total = per_key.agg(F.sum("n").alias("total"))
    return per_key.join(F.broadcast(total), how="inner").where(F.col("n") * heavy_share > F.col("total")).select(*keys)


def _targets_for(k: Keyed, wanted: DataFrame, small: bool) -> DataFrame:
    """The earliest live time of each wanted key; keys without a target are absent."""
    keys = _keys(k)
    if small:
        hit = k.targets.join(F.broadcast(wanted), k.keys)
    elif k.contains:
        # The targets of a popular name are compared in parts, each with all scopes of the name.
        parts = k.targets.groupBy(*k.keys).agg(F.ceil(F.count(F.lit(1)) / NAME_PART).cast("int").alias("_parts"))
        targets = k.targets.join(parts, k.keys).withColumn("_part", F.pmod(F.xxhash64(k.contains[1]), "_parts").cast("int")).drop("_parts")
        asked = wanted.join(parts, k.keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        hit = targets.join(asked, [*k.keys, "_part"])
    else:
        hit = k.targets
    if k.contains:
        hit = hit.where(F.col(k.contains[1]).contains(F.col(k.contains[0])))
    return hit.groupBy(*keys).agg(F.min("live_from").alias("live_from"))


def _left_over(groups: DataFrame) -> DataFrame:
    """The groups that have an orphan: no target, or a first reference before it, or references without a time."""
    return groups.where("live_from is null or first is null or live_from > first")


def orphan_groups(k: Keyed, heavy_share: int = HEAVY_SHARE) -> tuple[DataFrame, DataFrame]:
    """(heavy, rest): groups with orphans and the time from which their key has a target (null: never)."""
    keys = _keys(k)
    scratch = Scratch(k.refs.sparkSession, "orphans")
    groups = scratch.save(grouped(k), "groups")
    hot = heavy_keys(groups, keys, heavy_share)
    known_hot = hot.join(_targets_for(k, hot, True), keys, "left").withColumn("_heavy", F.lit(True))
    marked = groups.join(F.broadcast(known_hot), keys, "left")
    heavy = _left_over(marked.where("_heavy")).drop("_heavy")
    rest = marked.where("_heavy is null").drop("_heavy", "live_from")
    known = _targets_for(k, rest.select(*keys).distinct(), False)
    return heavy, _left_over(rest.join(known, keys, "left"))


def _in_time(k: Keyed, groups: DataFrame, small: bool) -> DataFrame:
    """The references of orphan groups that no target was there for."""
    keys = _keys(k)
    # Of heavy keys only (key, live_from) is broadcast, at most ``heavy_share`` rows.
    want = F.broadcast(groups.select(*keys, "live_from").distinct()) if small else groups.select(*keys, *GROUP, "live_from")
    on = keys if small else [*keys, "source_table", "ref_field"]
    refs = k.refs
    if not small:
        refs, want = refs.withColumn("_period", F.coalesce("period", F.lit(""))), want.withColumn("_period", F.coalesce("period", F.lit(""))).drop("period")
        on = [*on, "_period"]
    return refs.join(want, on).where("live_from is null or ref_time is null or live_from > ref_time")


FOUND = ["source_table", "source_id", "ref_field", "ref_value", "period"]


def orphans(parts: list[Keyed], heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """All references without a live target, as distinct rows.

    A reference is an orphan when no target exists or when the earliest one came
    after the referring row; a referring row without a time can't be shown to be
    later than its target and counts as an orphan with a null period.
    """
    out = None
    for k in parts:
        heavy, rest = orphan_groups(k, heavy_share)
        one = _in_time(k, heavy, True).select(*FOUND).unionByName(_in_time(k, rest, False).select(*FOUND))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def orphan_counts(parts: list[Keyed], heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """(source_table, ref_field, period, n_orphans) of the united groups.

    A group whose target is absent or later than all its references counts
    whole; only where a target came in between are single references looked at.
    """
    out = None
    for groups, k in [(g, k) for k in parts for g in orphan_groups(k, heavy_share)]:
        clear = F.col("live_from").isNull() | F.col("first").isNull() | (F.col("live_from") > F.col("last"))
        whole = groups.where(clear).select(*GROUP, F.col("n_refs").alias("n"))
        part = _in_time(k, groups.where(~clear), False).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
        one = whole.unionByName(part)
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*GROUP).agg(F.sum("n").alias("n_orphans"))


def reference_parts(chunks: DataFrame, large_chunks: DataFrame, notes: DataFrame, removed: DataFrame) -> list[Keyed]:
    """The references of large chunks and notes with the chunks they may name."""
    gone = removed.select(F.lower(outer_trim(F.col("chunk_id"))).alias("key")).where("key is not null").distinct()
    live = (
        chunks.where("id is not null")
        .groupBy(F.lower(outer_trim(F.col("id"))).alias("key"))
        .agg(F.min("ingested_at").alias("live_from"), F.first(F.struct("repo_name", "name", "module_path")).alias("c"))
        .join(gone, "key", "left_anti")
        .select("key", "live_from", "c.*")
    )
    live = Scratch(chunks.sparkSession, "orphans").save(live, "live")  # four kinds of references look at it

    def refs(df: DataFrame, source: str, field: str, time: str, repo: bool) -> DataFrame:
        df = df.select(
            F.lit(source).alias("source_table"), F.col("id").alias("source_id"), F.lit(field).alias("ref_field"),
            F.col(time).alias("ref_time"), *([F.col("repo_name").alias("repo")] if repo else []), F.explode(field).alias("ref_value"),
        )
        df = df.where(F.length(outer_trim(F.col("ref_value"))) > 0)
        # Repeated rows of an item are one reference, at its earliest time within the period.
        df = df.withColumn("period", F.date_format("ref_time", "yyyy-MM"))
        return df.groupBy(*[c for c in df.columns if c != "ref_time"]).agg(F.min("ref_time").alias("ref_time"))

    by_id = refs(large_chunks, "large_chunks", "chunk_ids", "ingested_at", False).withColumn("key", F.lower(outer_trim(F.col("ref_value"))))
    symbols = refs(notes, "notes", "related_symbols", "created_at", True).withColumn("sym", symbol_key(F.col("ref_value")))
    plain = symbols.where(~F.col("sym").contains("::")).withColumnRenamed("sym", "name")
    last = F.regexp_extract("sym", r"(?s)^(.*)::(.*?)$", 1), F.regexp_extract("sym", r"(?s)^(.*)::(.*?)$", 2)
    scoped = symbols.where(F.col("sym").contains("::")).withColumns({"scope": last[0], "name": last[1]}).drop("sym")
    files = refs(notes, "notes", "related_files", "created_at", True).withColumn("module_path", file_key(F.col("ref_value")))
    named = live.groupBy(F.col("repo_name").alias("repo"), "name", "module_path").agg(F.min("live_from").alias("live_from"))

    def space(df: DataFrame, name: str, repo: Column, key: Column, *more: str) -> DataFrame:
        return df.select(F.lit(name).alias("space"), repo.alias("repo"), key.alias("key"), *more)

    none, own = F.lit(""), F.col("repo")
    exact = space(by_id, "id", none, F.col("key"), *REF).unionByName(space(plain, "symbol", own, F.col("name"), *REF)).unionByName(space(files, "file", own, F.col("module_path"), *REF))
    there = space(live, "id", none, F.col("key"), "live_from")
    for name, column in (("symbol", "name"), ("file", "module_path")):
        there = there.unionByName(space(live, name, F.col("repo_name"), F.col(column), "live_from"))
    there = there.groupBy("space", "repo", "key").agg(F.min("live_from").alias("live_from"))
    return [Keyed(exact, there, ["space", "repo", "key"]), Keyed(scoped, named, ["repo", "name"], contains=("scope", "module_path"))]


def orphan_report(parts: list[Keyed], heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """Orphans per table, field and month, by the united counts, and the rows that have them."""
    rows = orphans(parts, heavy_share).groupBy(*GROUP).agg(F.countDistinct("source_id").alias("n_sources"))
    counts = orphan_counts(parts, heavy_share)
    same = [counts[c].eqNullSafe(rows[c]) for c in GROUP]
    return counts.join(rows, same).select(*[counts[c] for c in GROUP], "n_orphans", "n_sources")
