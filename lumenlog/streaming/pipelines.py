"""Structured Streaming jobs. They share every transformation with the batch code.

Sinks written from ``foreachBatch`` go to a ``batch_id=N`` folder in overwrite
mode: a batch that is run again after a failure replaces its own output, so each
record lands exactly once.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenlog.functions import events as ev
from lumenlog.operators import sampling
from lumenlog.operators.embedding import Embedder, embed_events
from lumenlog.sources.events import parse_messages

TTL_MS = 30 * 60 * 1000


def _writer(stream: DataFrame, checkpoint: str, trigger: dict | None):
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))


def _batch_dir(root: str, batch_id: int) -> str:
    return f"{root}/batch_id={batch_id}"


# --- ingest --------------------------------------------------------------------------
def ingest(messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Queue records to the event table through the exactly-once file sink; invalid rows are left out.

    Rows are dealt in ranges as in ``append_events``: a batch makes at most as many files as it has days and
    partitions together, and a busy day is spread over tasks.
    """
    events = parse_messages(messages).filter(F.size("reasons") == 0).drop("reasons", "value")
    events = events.withColumn("event_date", F.to_date("timestamp"))
    events = events.repartitionByRange("event_date", "service", "timestamp")
    return _writer(events, checkpoint, trigger).format("parquet").partitionBy("event_date").start(path)


def persist_batches(messages: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Micro-batches of queue records to ``root/events``, with statistics in ``root/stats``.

    Valid and rejected rows are written in one pass, split by the ``outcome``
    folder: ``rejected`` is the dead-letter store, with reasons and raw value.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        started = time.time()
        rows = parse_messages(batch).withColumn("outcome", F.when(F.size("reasons") == 0, "valid").otherwise("rejected"))
        out = _batch_dir(f"{root}/events", batch_id)
        rows.write.mode("overwrite").partitionBy("outcome").parquet(out)
        took = int((time.time() - started) * 1000)
        # Counted from the files just written: column statistics only.
        saved = spark.read.schema(rows.schema).parquet(out)
        saved.agg(
            F.count("*").alias("events"),
            F.count_if(F.col("outcome") == "valid").alias("successes"),
            F.count_if(F.col("outcome") == "rejected").alias("failures"),
            F.lit(took).cast("bigint").alias("tookMs"),
        ).write.mode("overwrite").parquet(_batch_dir(f"{root}/stats", batch_id))

    return _writer(messages, checkpoint, trigger).foreachBatch(save).start()


# --- stateless and keyed steps ----------------------------------------------------------
def deduplicate(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """First event per request id within the watermark."""
    return events.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["requestId"])


def enrich_and_sample(events: DataFrame, policy: sampling.SamplingPolicy) -> DataFrame:
    """Summary, latency bucket and sampling tag; no state, so batch and stream agree row by row."""
    return sampling.sample_with_audit(
        events.withColumn("_summary", ev.canonical_summary(**ev.event_args())).withColumn(
            "latencyBucket", ev.latency_bucket(F.col("performance.durationMs"))
        ),
        policy,
    )


def to_table(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append-mode file sink: closed windows and stateless rows."""
    return _writer(stream, checkpoint, trigger).outputMode("append").format("parquet").start(path)


# --- session state -------------------------------------------------------------------
def session_windows(turns: DataFrame, lateness: str = "10 minutes", ttl: str = "30 minutes") -> DataFrame:
    """Closed sessions with a sliding expiry, by the built-in session window.

    The window end is exclusive of the TTL instant: a turn exactly one TTL later
    opens a new session here, unlike :func:`session_state`.
    """
    return (
        turns.withWatermark("createdAt", lateness)
        .groupBy("sessionId", F.session_window("createdAt", ttl))
        .agg(F.count("*").alias("turns"))
        .select("sessionId", F.col("session_window.start").alias("startedAt"), "turns")
    )


STATE = "startedAt bigint, lastAt bigint, turns bigint"
SESSIONS = "sessionId string, startedAt timestamp, lastAt timestamp, turns bigint"


def session_state(turns: DataFrame, ttl_ms: int = TTL_MS, lateness: str = "10 minutes") -> DataFrame:
    """Closed sessions, kept open up to and including one TTL after the last turn.

    State per session is three numbers. An event-time timer closes it.
    """

    def frame(key, started, last, n):
        to_ts = lambda us: pd.Timestamp(us, unit="us")
        return pd.DataFrame({"sessionId": [key], "startedAt": [to_ts(started)], "lastAt": [to_ts(last)], "turns": [n]})

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield frame(key[0], *state.get)
            state.remove()
            return
        times = sorted(int(t) for b in batches for t in b["createdAt"].astype("datetime64[us]").astype("int64"))
        started, last, n = state.get if state.exists else (None, None, 0)
        for t in times:
            if last is not None and t - last > ttl_ms * 1000:
                yield frame(key[0], started, last, n)
                started, n = None, 0
            started = t if started is None else min(started, t)
            last = t if last is None or n == 0 else max(last, t)
            n += 1
        state.update((started, last, n))
        expiry = last // 1000 + ttl_ms + 1
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))

    return (
        turns.select("sessionId", "createdAt")
        .withWatermark("createdAt", lateness)
        .groupBy("sessionId")
        .applyInPandasWithState(step, SESSIONS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


# --- incremental embedding ------------------------------------------------------------
def embed_incrementally(
    events: DataFrame, table: str, checkpoint: str, now: Column, embedder: Embedder | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Embed new events as they arrive; the checkpoint takes the place of the high-water mark.

    Rows already in the table (a replayed source, a late duplicate) are dropped by
    an anti-join on the event id. A copy of an event has the event's time, so only
    the batch's own time span of the table is read.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["eventId"])
        if batch_id > 0:
            low, high = batch.agg(F.min("timestamp"), F.max("timestamp")).first()
            table_rows = spark.read.schema("eventId bigint, timestamp timestamp, batch_id bigint").parquet(table)
            seen = table_rows.filter((F.col("batch_id") < batch_id) & F.col("timestamp").between(low, high))
            rows = rows.join(seen.select("eventId"), "eventId", "left_anti")
        embed_events(rows, now, embedder).write.mode("overwrite").parquet(_batch_dir(table, batch_id))

    return _writer(events.filter("_summary <> ''"), checkpoint, trigger).foreachBatch(save).start()


# --- late data -------------------------------------------------------------------------
def divert_late(
    events: DataFrame, root: str, checkpoint: str, lateness_seconds: int = 600, trigger: dict | None = None
) -> StreamingQuery:
    """Split rows into ``on_time`` and ``late`` folders before any stateful step.

    Late means older than the greatest time of the earlier batches minus the
    bound. Nothing is dropped; the greatest time per batch is kept as one row.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = None
        if batch_id > 0:
            marks = spark.read.schema("maxSeen timestamp, batch_id bigint").parquet(f"{root}/marks")
            seen = marks.filter(F.col("batch_id") < batch_id).agg(F.max("maxSeen")).first()[0]
        bound = F.lit(None).cast("timestamp") if seen is None else F.lit(seen) - F.expr(f"INTERVAL {int(lateness_seconds)} SECONDS")
        late = F.coalesce(F.col("timestamp") < bound, F.lit(False))
        rows = batch.withColumn("arrival", F.when(late, "late").otherwise("on_time"))
        out = _batch_dir(f"{root}/rows", batch_id)
        rows.write.mode("overwrite").partitionBy("arrival").parquet(out)
        saved = spark.read.schema(rows.schema).parquet(out)
        saved.agg(F.max("timestamp").alias("maxSeen")).write.mode("overwrite").parquet(_batch_dir(f"{root}/marks", batch_id))

    return _writer(events, checkpoint, trigger).foreachBatch(save).start()
