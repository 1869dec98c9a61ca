"""Notes, their staleness and their sagas, and the states of jobs and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for other widths, empty or all-zero vectors."""
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot / n).otherwise(0.0)


def valid(notes: DataFrame) -> DataFrame:
    """Not replaced and not archived; a note whose flag is unknown is not valid."""
    return notes.where("invalid_at is null and archived = false")


def unarchived(notes: DataFrame) -> DataFrame:
    """Not archived; a note whose flag is unknown stays."""
    return notes.where("archived is null or archived = false")


def dedup_verdict(similarity: Column, same_saga: Column) -> Column:
    block, warn = F.when(same_saga, 0.95).otherwise(0.90), F.when(same_saga, 0.65).otherwise(0.70)
    return F.when(similarity >= block, "block").when(similarity >= warn, "warn").otherwise("ok")


def staleness(missing: Column, divergence: Column) -> Column:
    """A half for each missing symbol, and a divergence over 0.3; 1 at most.  Unknown divergence counts nothing."""
    return F.least(F.lit(1.0), 0.5 * missing + F.when(divergence > 0.3, divergence).otherwise(0.0))


def band(score: Column) -> Column:
    return F.when(score < 0.3, "healthy").when(score < 0.7, "review").otherwise("stale")


def issue_of_branch(branch: Column) -> Column:
    p = r"^wp/([A-Z]+)/(\d+)$"
    return F.when(branch.rlike(p), F.concat_ws("-", F.regexp_extract(branch, p, 1), F.regexp_extract(branch, p, 2)))


def rolling_sum(events: DataFrame, key: str, ts: str, value: str, seconds: int) -> DataFrame:
    """With ``used``: the sum over the key's events in the last ``seconds``, the lower end excluded."""
    at = F.col(ts).cast("timestamp")
    micros = F.unix_micros(at)
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("used", F.sum(value).over(w))


def counter_delta(samples: DataFrame, key: list[str], ts: str, value: str) -> DataFrame:
    """With ``delta`` to the sample before; the first sight of a counter has 0, a reset its new value."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(ts))
    return samples.withColumn("delta", F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def streaks(samples: DataFrame, key: str, tick: str, bad: Column) -> DataFrame:
    """(key, first, last, length) of runs of bad samples on consecutive ticks; a missing tick ends a run."""
    w = Window.partitionBy(key).orderBy(tick)
    runs = samples.where(bad).withColumn("_g", F.col(tick) - F.row_number().over(w))
    return runs.groupBy(key, "_g").agg(F.min(tick).alias("first"), F.max(tick).alias("last"), F.count(F.lit(1)).alias("length")).drop("_g")


def changed(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows after a change set (key, op, columns): deleted keys are gone, updated and inserted ones have the new columns.

    The change set holds one change per key.
    """
    cols = [c for c in rows.columns if c != key]
    kept = rows.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where("op <> 'delete'").select(key, *cols))
