"""Structured Streaming forms of the stateful operators, on a folder of event files.

Event time is ``ts``; rows later than the watermark are dropped.  Every query
runs to the end of what is there (``availableNow``) and returns its result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.tables import shared_dir, table


def source(spark: SparkSession, d: str, name: str = "events", watermark: str = "10 minutes") -> DataFrame:
    schema = table(spark, d, name).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).option("pathGlobFilter", "*.parquet")
    path = f"{d}/{name}.parquet"
    # A file stream watches folders; a table that is one file is found through its folder.
    import os

    if os.path.isfile(path):
        raw, path = raw.option("pathGlobFilter", f"{name}.parquet"), d
    return raw.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def run(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """The stored result of a streaming plan."""
    base = f"{shared_dir(spark)}/lakeloom/stream-{uuid.uuid4().hex}"
    schema = df.schema
    if mode == "append":
        q = df.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(schema).parquet(f"{base}/out")
    name = "s" + uuid.uuid4().hex
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Errors per hour and whether they pass the limit of the alert."""
    e = source(spark, d).where("event_type = 'error'")
    k = e.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n_errors"))
    return run(spark, k.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "n_errors", (F.col("n_errors") > 5).alias("alert")))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with gaps under 30 minutes."""
    e = source(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return run(spark, e.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"))


def idempotency(spark: SparkSession, d: str) -> DataFrame:
    """Keys that were seen, each once within the watermark; repeats are dropped."""
    e = source(spark, d).select("ts", "user_id", "event_type").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return run(spark, e.select("user_id", "event_type"))


def sliding_quota(spark: SparkSession, d: str) -> DataFrame:
    """Usage of a user in sliding days."""
    e = source(spark, d).groupBy("user_id", F.window("ts", "24 hours", "6 hours")).agg(F.round(F.sum("value"), 4).alias("used"))
    return run(spark, e.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "used"))


def _per_key(e: DataFrame, key: str, decide, keep_seconds: float) -> DataFrame:
    """(key, event_id) of the events that ``decide`` lets through, with one number of state a key.

    All rows of a key in a trigger are put in the order of time before they are
    looked at.  A key's state is dropped when the watermark is ``keep_seconds``
    beyond its number, from where it decides nothing any more.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(e.dtypes)[key]

    def step(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [], "event_id": []})
            return
        number = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for at, event in zip(rows["ts"].astype("int64").to_numpy() / 1e9 if str(rows["ts"].dtype).startswith("datetime64[ns") else [t.timestamp() for t in rows["ts"]], rows["event_id"]):
            passes, number = decide(number, at)
            if passes:
                out.append(event)
        state.update((number,))
        state.setTimeoutTimestamp(max(int((number + keep_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), "event_id": out})

    return e.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long", "number double", "append", GroupStateTimeout.EventTimeTimeout)


def cooldown(seconds: float):
    """Fires if it never did, or not within the last seconds; the number is the time of the last one."""

    def decide(last, now):
        fires = last is None or now - last >= seconds
        return fires, now if fires else last

    return decide


def token_bucket(seconds: float, burst: int):
    """One token in so many seconds, ``burst`` at once; the number is the time when all tokens would be there again."""

    def decide(full_at, now):
        full_at = now if full_at is None else max(now, full_at)
        allowed = full_at - now <= (burst - 1) * seconds
        return allowed, full_at + seconds if allowed else full_at

    return decide


COOLDOWN, REFILL, BURST = 300.0, 12 * 3600.0, 2


def cooldown_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Errors that may fire: none for a user within 300 seconds after one that did."""
    return run(spark, _per_key(source(spark, d).where("event_type = 'error'"), "user_id", cooldown(COOLDOWN), COOLDOWN))


def cooldown_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate of every rule, the rules being the types of events."""
    return run(spark, _per_key(source(spark, d), "event_type", cooldown(COOLDOWN * 10), COOLDOWN * 10))


def request_limits(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a client that its token bucket lets through."""
    return run(spark, _per_key(source(spark, d), "user_id", token_bucket(REFILL, BURST), 0.0))


def broadcast(spark: SparkSession, d: str) -> DataFrame:
    """Every event to each of three listeners, read back and counted."""
    e = source(spark, d).select("event_type", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("listener"))
    return run(spark, e).groupBy("listener", "event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "t1_stream_cooldown_alerts": cooldown_alerts, "t3_cooldown_gate": cooldown_gate, "t4_stream_error_rate": error_rate, "t9_stream_sessions": sessions, "t10_token_bucket": request_limits,
    "t11_stream_sliding_quota": sliding_quota, "t12_event_broadcast": broadcast, "t14_stream_idempotency": idempotency,
}

_HOUR_SQL = "SELECT date_trunc('hour', ts) AS hour, count(*) AS n_errors, count(*) > 5 AS alert FROM events WHERE event_type = 'error' AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 10 MINUTE GROUP BY 1"
_MARK = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def _gate_sql(key: str, cond: str, seconds: float) -> str:
    return f"""WITH RECURSIVE e AS (SELECT {key}, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS r FROM events WHERE {cond}),
w AS (SELECT {key}, event_id, r, t AS last, true AS fired FROM e WHERE r = 1 UNION ALL SELECT e.{key}, e.event_id, e.r, CASE WHEN e.t - w.last >= {seconds} THEN e.t ELSE w.last END, e.t - w.last >= {seconds} FROM w JOIN e ON e.{key} = w.{key} AND e.r = w.r + 1)
SELECT {key}, event_id FROM w WHERE fired"""


SQL: dict[str, str] = {
    "t1_stream_cooldown_alerts": _gate_sql("user_id", "event_type = 'error'", COOLDOWN),
    "t3_cooldown_gate": _gate_sql("event_type", "true", COOLDOWN * 10),
    "t4_stream_error_rate": _HOUR_SQL,
    "t9_stream_sessions": f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 30 MINUTE <= {_MARK}",
    "t10_token_bucket": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT user_id, event_id, r, t + {REFILL} AS tat, true AS ok FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN greatest(w.tat, e.t) - e.t <= {(BURST - 1) * REFILL} THEN greatest(w.tat, e.t) + {REFILL} ELSE greatest(w.tat, e.t) END, greatest(w.tat, e.t) - e.t <= {(BURST - 1) * REFILL}
  FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1) SELECT user_id, event_id FROM w WHERE ok""",
    "t11_stream_sliding_quota": f"SELECT user_id, start, round(sum(value), 4) AS used FROM (SELECT user_id, value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS start FROM events, (SELECT unnest([0, 1, 2, 3]) AS k)) WHERE start + INTERVAL 24 HOUR <= {_MARK} GROUP BY ALL",
    "t12_event_broadcast": "SELECT listener, event_type, count(*) AS n FROM events, (SELECT unnest(['a', 'b', 'c']) AS listener) GROUP BY ALL",
    "t14_stream_idempotency": "SELECT DISTINCT user_id, event_type FROM events",
}
