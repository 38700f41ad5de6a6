"""Event sinks and sources: JSON lines, the event table, queue envelopes, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.operators.assembly import finalize_once, project_event
from lumenlog.operators.validation import event_reasons, split
from lumenlog.schema import QUEUE_VALUE, WIDE_EVENT

CORRUPT = "_corrupt_record"
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"


# --- JSON lines -------------------------------------------------------------------
def write_json_lines(events: DataFrame, path: str) -> None:
    """Append the core event, one JSON object a line; metadata and summary are not written."""
    project_event(events).write.mode("append").option("timestampFormat", JSON_TIME).json(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Events with a fixed schema; an unreadable line keeps its text in ``_corrupt_record``."""
    schema = T.StructType([*WIDE_EVENT.fields, T.StructField(CORRUPT, T.StringType(), True)])
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


# --- event table --------------------------------------------------------------------
def append_events(events: DataFrame, path: str, rejected_path: str | None = None, cluster: bool = True) -> None:
    """Append valid events to the table partitioned by day; bad rows do not stop good ones.

    ``cluster`` range-partitions by (day, service, time): files then hold narrow
    ranges for min/max skipping, and a busy day or service is split over tasks.
    """
    valid, rejected = split(events, event_reasons())
    rows = valid.withColumn("event_date", F.to_date("timestamp"))
    if cluster:
        order = ["event_date", "service", "timestamp"]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("append").partitionBy("event_date").parquet(path)
    if rejected_path:
        rejected.write.mode("append").parquet(rejected_path)


def retention_split(events: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rows older than ``days``). On the event table the day filter prunes partitions."""
    cutoff = F.timestamp_micros(F.unix_micros(now) - F.lit(days * 86_400_000_000))
    keep = F.col("timestamp") >= cutoff
    hot, cold = events.filter(keep), events.filter(~keep)
    if "event_date" in events.columns:
        day = F.to_date(cutoff)
        hot, cold = hot.filter(F.col("event_date") >= day), cold.filter(F.col("event_date") <= day)
    return hot, cold


def lookup_events(events: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Events whose ``column`` is in ``keys``; a small key list is broadcast at run time."""
    return events.join(keys.select(column).distinct(), column, "left_semi")


def lookup_values(events: DataFrame, column: str, values: Sequence) -> DataFrame:
    """As :func:`lookup_events` for a short literal list, which is pushed into the scan."""
    return events.filter(F.col(column).isin(list(values)))


# --- queue ---------------------------------------------------------------------------
def envelope(events: DataFrame, published: Column) -> DataFrame:
    """Queue records: key = request id, value = JSON of event, metadata, summary and time.

    Metadata that is no JSON travels as ``{"unreadable": text}``.
    """
    core = F.struct(*[F.col(f.name) for f in WIDE_EVENT.fields])
    raw = F.to_json(F.struct(F.col("_metadata").alias("unreadable")))  # {} for null
    bag = F.coalesce(F.try_parse_json("_metadata"), F.parse_json(raw))
    body = F.struct(core.alias("event"), bag.alias("_metadata"), F.col("_summary").alias("summary"), published.alias("timestamp"))
    return events.select(
        F.col("requestId").alias("key"), F.to_json(body, {"timestampFormat": JSON_TIME}).alias("value")
    )


def publish(events: DataFrame, published: Column, servers: str, topic: str = "log-events") -> None:
    """Write the envelopes to Kafka (needs the connector package on the class path)."""
    (
        envelope(events, published)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def read_queue(spark: SparkSession, servers: str, topic: str = "log-events", max_offsets: int | None = None) -> DataFrame:
    """Stream of queue records from the latest offsets (needs the connector package).

    ``max_offsets`` bounds the records of a micro-batch over the whole topic; without it a batch takes all there are.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return (
        reader.load()
        .select(F.col("key").cast("string"), F.col("value").cast("string"))
    )


def parse_messages(messages: DataFrame) -> DataFrame:
    """Stored events of queue records plus ``reasons``; batch and streaming.

    Records without a value are skipped. Unreadable ones stay, with their raw
    ``value`` and a reason, so that they can be routed to a dead-letter sink.

    Each value is read in a generator of one row: a filter on ``reasons`` would be
    pushed below a projection and repeat the parser for every field it tests.
    """
    schema = T.StructType([*QUEUE_VALUE.fields, T.StructField(CORRUPT, T.StringType(), True)])
    read = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = messages.filter(F.col("value").isNotNull()).select("value", F.inline(F.array(read)))
    flat = parsed.select(
        "value",
        *[F.col(f"event.{f.name}").alias(f.name) for f in WIDE_EVENT.fields],
        "_metadata",
        F.col("summary").alias("_summary"),
        CORRUPT,
    )
    unreadable = F.col(CORRUPT).isNotNull()
    return flat.withColumn(
        "reasons", F.when(unreadable, F.array(F.lit("unreadable message"))).otherwise(event_reasons())
    ).drop(CORRUPT)


def merge_paths(queued: DataFrame, direct: DataFrame, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Events of both delivery paths, every request once, nothing lost."""
    return finalize_once(queued.unionByName(direct, allowMissingColumns=True), order)


# --- progress -------------------------------------------------------------------------
def upsert_latest(current: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Newest row per key of both tables."""
    both = current.unionByName(updates)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")


def save_progress(updates: DataFrame, path: str) -> None:
    """Append progress rows; readers take the newest, so no file is ever rewritten."""
    updates.write.mode("append").parquet(path)


def read_progress(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    rows = spark.read.schema(schema).parquet(path)
    return rows.groupBy("source").agg(F.max_by(F.struct(*rows.columns), "lastUpdatedAt").alias("r")).select("r.*")
