"""Structured Streaming jobs over task messages, query logs and metadata changes.

State lives in RocksDB, so it may outgrow executor memory, and both state and
outputs sit below the shared checkpoint folder. Each sink writes a micro-batch
to a folder named by the batch number; a batch that runs again after a lost
executor or driver overwrites its own folder and nothing is counted twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quern.functions import fixed
from quern.functions.columns import rate
from quern.operators.retrieval import replace_documents

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "10 minutes"
BATCH = "batch_id"


def read_stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``max_files`` bounds a micro-batch.

    The path may be a folder or one file; a file is streamed as the one of its
    folder that has its name.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(target).isDirectory():
        return reader.parquet(path)
    name = re.sub(r"([\\*?\[\]{}])", r"\\\1", target.getName())
    return reader.option("pathGlobFilter", name).parquet(target.getParent().toString())


def event_time(col: str) -> Column:
    """Watermarks need a zoned timestamp; the session runs in UTC, so the instant stays the same."""
    return F.col(col).cast("timestamp")


def stream_task_state(
    messages: DataFrame, key: str = "task_id", ts: str = "ts", tie: Sequence[str] = ()
) -> DataFrame:
    """Newest message per task (update mode). Late old messages never replace newer ones; ``tie`` orders one instant."""
    rest = [c for c in messages.columns if c not in (key, ts)]
    newest = F.max_by(F.struct(*rest), F.struct(ts, *tie, *[c for c in rest if c not in tie])).alias("_m")
    return messages.groupBy(key).agg(F.max(ts).alias(ts), newest).select(key, ts, "_m.*")


def stream_query_stats(
    hist: DataFrame, ts: str = "created_at", window: str = "1 hour", lateness: str = LATENESS
) -> DataFrame:
    """Counts and success rate per tumbling window (append mode: closed windows only)."""
    done, total = F.count_if(F.col("status") == "completed"), F.count(F.lit(1))
    return (
        hist.withColumn(ts, event_time(ts))
        .withWatermark(ts, lateness)
        .groupBy(F.window(ts, window).alias("w"))
        .agg(total.alias("total"), done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
             rate(done, total).alias("success_rate"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "total", "completed", "failed", "success_rate")
    )


def stream_task_timeout(
    messages: DataFrame, key: str = "task_id", ts: str = "ts", status: str = "status", gap: str = "60 seconds",
    lateness: str = LATENESS, tie: Sequence[str] = (),
) -> DataFrame:
    """Tasks silent for ``gap`` whose last message is not final (append mode: closed sessions)."""
    return (
        messages.withColumn(ts, event_time(ts))
        .withWatermark(ts, lateness)
        .groupBy(key, F.session_window(ts, gap).alias("s"))
        .agg(F.max_by(status, F.struct(ts, *tie, status)).alias("last_status"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("messages"))
        .filter(~F.col("last_status").isin(*fixed.FINAL_STATES))
        .select(key, "last_status", "last_seen", "messages", F.lit("timeout").alias("status"))
    )


# -- sinks ----------------------------------------------------------------------


def _start(
    df: DataFrame, checkpoint: str, mode: str, write: Callable[[DataFrame, int], None], partitions: int | None
) -> StreamingQuery:
    """Start with this job's settings; a query keeps those it was started with.

    State has ``partitions`` parts, the session's shuffle partitions unless
    given; the checkpoint fixes them at the first start, so they should suit
    the largest cluster the job will see.
    """
    spark = df.sparkSession
    wanted = {
        "spark.sql.shuffle.partitions": str(partitions or spark.conf.get("spark.sql.shuffle.partitions")),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return (
            df.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _write_batches(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return write


def start_batches(df: DataFrame, path: str, checkpoint: str, mode: str, partitions: int | None = None) -> StreamingQuery:
    """Take what is available now and write each micro-batch to a folder of its own."""
    return _start(df, checkpoint, mode, _write_batches(path), partitions)


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Everything the stream wrote, with the batch number."""
    full = StructType(list(schema.fields)).add(BATCH, "long")
    return spark.read.schema(full).option("basePath", path).parquet(path)


def latest_of_batches(written: DataFrame, key: str, ts: str | None = None) -> DataFrame:
    """Of rows written more than once the newest by ``ts``, then by batch; without ``ts`` that of the newest batch."""
    rest = [c for c in written.columns if c not in (key, BATCH)]
    order = F.struct(*([ts] if ts else []), BATCH, *[c for c in rest if c != ts])
    return written.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_m")).select(key, "_m.*")


def start_metadata_sync(changes: DataFrame, path: str, checkpoint: str, key: str = "doc_id", ts: str = "updated_at") -> StreamingQuery:
    """Apply changed documents to a store kept as a log of changes.

    The checkpoint remembers which files were applied, as the last scan time
    would. A micro-batch appends its newest version per document; the store is
    not rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in (key, ts)]
        newest = batch.groupBy(key).agg(
            F.max(ts).alias(ts), F.max_by(F.struct(*rest), F.struct(ts, *rest)).alias("_m")
        )
        newest.select(key, ts, "_m.*").write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return _start(changes, checkpoint, "append", write, None)


def synced_documents(base: DataFrame, written: DataFrame, key: str = "doc_id", ts: str = "updated_at") -> DataFrame:
    """The store after the sync: the newest version by time replaces the base row, in whatever order changes came."""
    return replace_documents(base, latest_of_batches(written, key, ts).select(*base.columns), key)


def compact(base: DataFrame, written: DataFrame, path: str, key: str = "doc_id", ts: str = "updated_at") -> DataFrame:
    """Write the store with the log worked in; it is the next base, and the log's batches up to now may go."""
    synced_documents(base, written, key, ts).write.parquet(path)
    return base.sparkSession.read.schema(base.schema).parquet(path)


# -- tasks as state machines ---------------------------------------------------------

TIMEOUTS = "task_id long, last_status string, last_seen timestamp, messages long, status string"


def _task_lifecycle(gap_ms: int, final: tuple[str, ...]):
    """A stateful processor: one state per task, closed by an event-time timer ``gap_ms`` after its last message."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

    held = StructType(
        [StructField("last_status", StringType()), StructField("last_seen", TimestampType()),
         StructField("last_tie", LongType()), StructField("messages", LongType())]
    )

    gap = np.timedelta64(gap_ms, "ms")

    def closed(key, status, seen, count) -> pd.DataFrame:
        return pd.DataFrame({"task_id": key[0], "last_status": status, "last_seen": seen, "messages": count, "status": "timeout"})

    def due(seen) -> int:
        return int(pd.Timestamp(seen).timestamp() * 1000) + gap_ms

    class TaskLifecycle(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("task", held)

        def handleInputRows(self, key, rows, timerValues):
            """All sessions of the batch at once: one frame for those closed by a later message, one state for the last."""
            state = self.state.get()
            batch = pd.concat(list(rows), ignore_index=True)
            untimed = int(batch["ts"].isna().sum())  # counted, but never first or last
            batch = batch[batch["ts"].notna()]
            ts = batch["ts"].to_numpy().astype("datetime64[us]")
            tie = batch["tie"].fillna(np.iinfo("int64").min).to_numpy().astype("int64")
            order = np.lexsort((tie, ts))
            ts, tie, status = ts[order], tie[order], batch["status"].to_numpy()[order]
            held_count = 0
            if state is not None:  # the state goes in front; messages older than its last one only count
                seen = np.datetime64(state[1], "us")
                old = int(((ts < seen) | ((ts == seen) & (tie < state[2]))).sum())
                held_count = state[3] + old - 1
                ts, tie = np.append(seen, ts[old:]), np.append(state[2], tie[old:])
                status = np.append(np.array([state[0]], dtype=object), status[old:])
            if not len(ts):
                return
            last = np.append(np.flatnonzero(np.diff(ts) >= gap), len(ts) - 1)  # the last message of each session
            count = np.diff(np.append(-1, last))
            count[0] += held_count
            count[-1] += untimed
            ended = last[:-1]  # a message after the gap opened a new session
            silent = ~np.isin(status[ended].astype(str), final)
            if silent.any():
                yield closed(key, status[ended][silent], ts[ended][silent], count[:-1][silent])
            end = last[-1]
            seen_now = ts[end].item()
            if state is None or seen_now != state[1]:
                if state is not None:
                    self.handle.deleteTimer(due(state[1]))
                self.handle.registerTimer(due(seen_now))
            self.state.update((status[end], seen_now, int(tie[end]), int(count[-1])))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            state = self.state.get()
            if state is not None:
                self.state.clear()
                if state[0] not in final:
                    yield closed(key, [state[0]], [state[1]], [state[3]])

        def close(self) -> None:
            pass

    return TaskLifecycle()


def stream_task_timers(
    messages: DataFrame, key: str = "task_id", ts: str = "ts", status: str = "status", gap_ms: int = 60_000,
    lateness: str = LATENESS, tie: str = "event_id",
) -> DataFrame:
    """Timeouts by state machine (append mode): a timer ``gap_ms`` after a task's last message closes it.

    A closed task whose last message (by time, then ``tie``) is not final is
    emitted as a timeout; its state is cleared either way, so state holds only
    open tasks. (Spark allows no TTL on event-time state; every state has a
    timer, so each goes once the watermark passes its gap.)
    """
    rows = messages.select(F.col(key).alias("task_id"), event_time(ts).alias("ts"), F.col(tie).cast("long").alias("tie"), F.col(status).alias("status"))
    return (
        rows.withWatermark("ts", lateness)
        .groupBy("task_id")
        .transformWithStateInPandas(
            statefulProcessor=_task_lifecycle(gap_ms, tuple(fixed.FINAL_STATES)),
            outputStructType=TIMEOUTS,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
