"""Event logs, queues and windows as Structured Streaming jobs.

Every job takes a streaming DataFrame and returns one; the caller names the
sink and its checkpoint.  State is keyed and expires: by watermark where event
time bounds it, by processing time for logs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

TTL_MS = 3_600_000
LEASE_SECONDS = 90


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Events as a file stream with ``ts`` as a timestamp (UTC)."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """Count and value per window and kind; late rows count until the watermark passes."""
    w = F.window("ts", f"{minutes} minutes")
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("bucket"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("finish"), "n")


def idempotent(requests: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First request of each key within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def numbered_log(events: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """Append-only log per message: each event gets the next offset of its
    message; a complete or error event ends it.  A message that has been quiet
    for the time to live is forgotten."""
    out = "message_id string, offset long, kind string, payload string, terminal boolean"

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        offset, ended = state.get if state.exists else (0, False)
        for frame in batches:
            rows = []
            for r in frame.sort_values(["sent_at", "kind", "payload"]).itertuples():
                if ended:
                    continue
                ended = r.kind in ("complete", "error")
                rows.append((key[0], offset, r.kind, r.payload, ended))
                offset += 1
            yield pd.DataFrame(rows, columns=["message_id", "offset", "kind", "payload", "terminal"])
        state.update((offset, ended))
        state.setTimeoutDuration(ttl_ms)

    return events.groupBy("message_id").applyInPandasWithState(
        number, out, "next long, ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def replay(log: DataFrame, message_id: str, offset: int) -> DataFrame:
    """A message's events from an offset on."""
    return log.where((F.col("message_id") == message_id) & (F.col("offset") >= offset)).orderBy("offset")


def compact(batch: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Last operation of each key in a batch."""
    order = F.struct("created_at", "op_id")
    return batch.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in batch.columns if c != key])


def drain(queue: DataFrame, apply: Callable[[DataFrame, int], Any], checkpoint: str, available_now: bool = True):
    """Hand the compacted operations of each micro-batch to ``apply`` in order.
    ``apply`` gets the batch number, so that a repeated batch can be recognised."""
    writer = queue.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: apply(compact(df), n))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def leases(tasks: DataFrame, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Heartbeats (task_id, ts) to tasks whose beats stopped for longer than the
    lease: one row per lapse, by event time."""
    w = F.session_window("ts", f"{seconds} seconds")
    lapsed = tasks.withWatermark("ts", f"{seconds} seconds").groupBy(w, "task_id").agg(F.max("ts").alias("last_beat"))
    return lapsed.select("task_id", "last_beat", F.lit("pending").alias("status"))


def seen_before(results: DataFrame) -> DataFrame:
    """Marks results (run_id, item_id, body): the first sight of an item in a run
    keeps its body, later ones become stubs."""
    out = "run_id string, item_id string, body string, first boolean"

    def mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.exists
        for frame in batches:
            rows = []
            for body in frame["body"]:
                rows.append((key[0], key[1], None if seen else body, not seen))
                seen = True
            yield pd.DataFrame(rows, columns=["run_id", "item_id", "body", "first"])
        if not state.exists:
            state.update((True,))

    return results.groupBy("run_id", "item_id").applyInPandasWithState(mark, out, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available and give the result as a table.
    Every batch is written by the executors as Parquet beside the checkpoint,
    in a folder of its own that a repeated batch writes anew; nothing is kept in
    the driver.  In complete mode the last batch is the result.  Batches without
    data are off, as a job with processing-time timeouts would ask for them for
    ever."""
    spark, key = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    folder, done = f"{checkpoint.rstrip('/')}-{name}", []

    def write(batch: DataFrame, number: int):
        path = f"{folder}/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        done.append(path)

    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    paths = done[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)
