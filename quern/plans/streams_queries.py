"""Streams drained over whole tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.session import shared_dir
from quern.sources.tables import read_table, table_path
from quern.streaming import streams as H


def _events(spark, d):
    return H.read_stream(spark, table_path(d, "events"), read_table(spark, d, "events").schema)


def _drain(spark, df, mode):
    """Run until the available input is used up, then read what was written."""
    out = shared_dir(spark, "stream")
    parts = spark.sparkContext.defaultParallelism
    H.start_batches(df, f"{out}/data", f"{out}/checkpoint", mode, parts).awaitTermination()
    return H.read_batches(spark, f"{out}/data", df.schema)


# status words of messages; a purchase or an error ends a task
_STATUS = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'running' END"


@query(
    "h01_stream_task_state",
    f"""
    SELECT user_id AS task_id, CAST(max(ts) AS VARCHAR) AS ts, last({_STATUS} ORDER BY ts, event_id) AS status, last(event_id ORDER BY ts, event_id) AS event_id
    FROM events GROUP BY 1
    """,
)
def _state(spark, d):
    messages = _events(spark, d).select(F.col("user_id").alias("task_id"), "ts", F.expr(_STATUS).alias("status"), "event_id")
    written = _drain(spark, H.stream_task_state(messages, tie=["event_id"]), "update")
    return H.latest_of_batches(written, "task_id").withColumn("ts", F.col("ts").cast("string"))


@query(
    "h02_stream_query_stats",
    """
    SELECT * FROM (
      SELECT CAST(date_trunc('hour', created_at) AS VARCHAR) AS window_start, count(*) AS total,
             count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
             round(count(*) FILTER (status = 'completed') / count(*)::DOUBLE, 6) AS success_rate
      FROM hist GROUP BY 1)
    WHERE CAST(window_start AS TIMESTAMP) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM hist) - INTERVAL 10 MINUTE
    """,
    views=("hist",),
)
def _stats(spark, d):
    hist = _events(spark, d).select(
        F.expr("CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'other' END").alias("status"),
        F.col("ts").alias("created_at"),
    )
    written = _drain(spark, H.stream_query_stats(hist), "append")
    return written.select(
        F.col("window_start").cast("string").alias("window_start"), "total", "completed", "failed", "success_rate"
    )


@query(
    "h03_stream_metadata_sync",
    """
    SELECT doc_id, source, n_chars, CAST(updated_at AS VARCHAR) AS updated_at FROM (
      SELECT doc_id, source, n_chars, TIMESTAMP '2023-01-01 00:00:00' AS updated_at FROM documents
      WHERE doc_id NOT IN (SELECT event_id // 4 FROM events)
      UNION ALL
      SELECT event_id // 4 AS doc_id, last(event_type ORDER BY ts, event_type, floor(value)), CAST(last(floor(value) ORDER BY ts, event_type, floor(value)) AS BIGINT), max(ts)
      FROM events GROUP BY 1)
    """,
)
def _sync(spark, d):
    """Events stand for metadata changes: some replace documents, some bring new ones."""
    base = read_table(spark, d, "documents").select(
        "doc_id", "source", "n_chars", F.lit("2023-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at")
    )
    out = shared_dir(spark, "sync")
    events = read_table(spark, d, "events")
    events.repartitionByRange(4, F.desc("ts")).write.parquet(f"{out}/changes")  # the newest file first
    changes = H.read_stream(spark, f"{out}/changes", events.schema, max_files=1).select(
        F.expr("event_id div 4").alias("doc_id"), F.col("event_type").alias("source"),
        F.floor("value").cast("long").alias("n_chars"), F.col("ts").alias("updated_at"),
    )
    H.start_metadata_sync(changes, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    store = H.synced_documents(base, H.read_batches(spark, f"{out}/data", changes.schema))
    return store.withColumn("updated_at", F.col("updated_at").cast("string"))


@query(
    "h04_stream_task_timeout",
    f"""
    SELECT task_id, last_status, CAST(last_seen AS VARCHAR) AS last_seen, messages, 'timeout' AS status FROM (
      SELECT task_id, session, last(status ORDER BY ts, event_id) AS last_status, max(ts) AS last_seen, count(*) AS messages FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
          SELECT user_id AS task_id, ts, event_id, {_STATUS} AS status,
                 CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS fresh
          FROM events)) GROUP BY 1, 2)
    WHERE last_seen + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
      AND last_status NOT IN ('success', 'failed')
    """,
)
def _timeout(spark, d):
    messages = _events(spark, d).select(F.col("user_id").alias("task_id"), "ts", "event_id", F.expr(_STATUS).alias("status"))
    written = _drain(spark, H.stream_task_timeout(messages, gap="60 minutes", tie=["event_id"]), "append")
    return written.select("task_id", "last_status", F.col("last_seen").cast("string").alias("last_seen"), "messages", "status")


@query(
    "h04_stream_task_timers",
    f"""
    SELECT task_id, last_status, CAST(last_seen AS VARCHAR) AS last_seen, messages, 'timeout' AS status FROM (
      SELECT task_id, session, last(status ORDER BY ts, event_id) AS last_status, max(ts) AS last_seen, count(*) AS messages FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
          SELECT user_id AS task_id, ts, event_id, {_STATUS} AS status,
                 CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS fresh
          FROM events)) GROUP BY 1, 2)
    WHERE last_seen + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
      AND last_status NOT IN ('success', 'failed')
    """,
)
def _timers(spark, d):
    """h04 by a state machine per task with event-time timers."""
    messages = _events(spark, d).select(F.col("user_id").alias("task_id"), "ts", "event_id", F.expr(_STATUS).alias("status"))
    written = _drain(spark, H.stream_task_timers(messages, gap_ms=3_600_000), "append")
    return written.select("task_id", "last_status", F.col("last_seen").cast("string").alias("last_seen"), "messages", "status")
