"""Registered queries: sources, sinks and streaming jobs, run to completion over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lumenlog.catalog import fixtures as fx
from lumenlog.catalog import sqltext as q
from lumenlog.catalog.metrics_queries import POLICY, REASON
from lumenlog.catalog.registry import query
from lumenlog.operators import embedding, incidents, sketches, validation
from lumenlog.schema import EMBEDDED_EVENT, EMBEDDING_PROGRESS, REQUIRED_EMBEDDED, WIDE_EVENT
from lumenlog.session import fresh_path
from lumenlog.sources import events as src
from lumenlog.sources import retention
from lumenlog.sources.snapshots import SnapshotTable
from lumenlog.streaming import pipelines, session_history

W = ("wide_events",)
FLAT = f"SELECT request_id, event_ts, service, route, user_id, {q.ROLE} AS user_role, error_code, coalesce(duration_ms, -1) AS duration_ms FROM wide_events"
NOW = "2024-02-05 00:00:00"


def _now(text=NOW):
    return F.lit(text).cast("timestamp")


def _flat(df):
    return df.select(
        F.col("requestId").alias("request_id"),
        F.col("timestamp").alias("event_ts"),
        "service",
        "route",
        F.col("user.id").alias("user_id"),
        F.col("user.role").alias("user_role"),
        F.col("error.code").alias("error_code"),
        F.coalesce("performance.durationMs", F.lit(-1)).alias("duration_ms"),
    )


def _stored(spark, sf):
    meta = F.concat(F.lit('{"tenant":"'), F.col("service"), F.lit('"}'))
    return fx.stored_events(spark, sf).withColumn("_metadata", F.when(F.col("eventId") % 2 == 0, meta))


# Every 50th message is damaged, every 60th has no service, every 70th no value.
def _messages(spark, sf, parity=None):
    events = _stored(spark, sf)
    if parity is not None:
        events = events.filter(F.col("eventId") % 2 == parity)
    spoiled = events.withColumn("service", F.when(F.col("eventId") % 60 == 7, F.lit("")).otherwise(F.col("service")))
    env = src.envelope(spoiled, F.col("timestamp")).withColumn("id", F.expr("substr(key, 5)").cast("bigint"))
    value = (
        F.when(F.col("id") % 70 == 3, F.lit(None))
        .when(F.col("id") % 50 == 1, F.concat(F.lit("{broken "), F.col("value")))
        .otherwise(F.col("value"))
    )
    return env.select("key", value.alias("value"))


BAD = "event_id % 70 = 3 OR event_id % 50 = 1 OR event_id % 60 = 7"


@query("a1_json_lines", FLAT, W)
def _(spark, sf):
    path = fresh_path(spark, "json-lines")
    src.write_json_lines(_stored(spark, sf), path)
    return _flat(src.read_json_lines(spark, path))


@query("a2_event_table", f"SELECT request_id, event_ts, strftime(event_ts, '%Y-%m-%d') AS event_date, {q.SUMMARY} AS summary FROM wide_events WHERE event_id % 60 <> 7", W)
def _(spark, sf):
    path, bad = fresh_path(spark, "events"), fresh_path(spark, "rejected")
    spoiled = _stored(spark, sf).withColumn("service", F.when(F.col("eventId") % 60 == 7, F.lit("")).otherwise(F.col("service")))
    src.append_events(spoiled, path, bad)
    return spark.read.parquet(path).select(
        F.col("requestId").alias("request_id"), F.col("timestamp").alias("event_ts"), F.col("event_date").cast("string"), F.col("_summary").alias("summary")
    )


@query(
    "a3_queue_envelope",
    f"""SELECT request_id AS msg_key, request_id, service, error_code, duration_ms::VARCHAR AS duration_ms, CASE WHEN event_id % 2 = 0 THEN service END AS tenant, {q.SUMMARY} AS summary FROM wide_events""",
    W,
)
def _(spark, sf):
    env = src.envelope(_stored(spark, sf), F.col("timestamp"))
    get = lambda p: F.get_json_object("value", p)
    return env.select(
        F.col("key").alias("msg_key"), get("$.event.requestId").alias("request_id"), get("$.event.service").alias("service"),
        get("$.event.error.code").alias("error_code"), get("$.event.performance.durationMs").alias("duration_ms"),
        get("$._metadata.tenant").alias("tenant"), get("$.summary").alias("summary"),
    )


@query(
    "a4_queue_consume",
    f"""SELECT CASE WHEN event_id % 50 = 1 THEN 'unreadable message' WHEN event_id % 60 = 7 THEN 'service is empty' ELSE 'ok' END AS verdict, count(*) AS n
    FROM wide_events WHERE event_id % 70 <> 3 GROUP BY 1""",
    W,
)
def _(spark, sf):
    parsed = src.parse_messages(_messages(spark, sf))
    verdict = F.coalesce(F.nullif(F.array_join("reasons", "; "), F.lit("")), F.lit("ok"))
    return parsed.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("a6_dual_path_merge", "SELECT request_id, event_ts, service FROM wide_events", W)
def _(spark, sf):
    e = fx.events(spark, sf).select("requestId", "timestamp", "service")
    h = F.pmod(F.xxhash64("requestId"), F.lit(3))
    # A third came by the queue, a third directly, a third both ways.
    merged = src.merge_paths(e.filter(h != 0), e.filter(h != 1).withColumn("via", F.lit("direct")))
    return merged.select(F.col("requestId").alias("request_id"), F.col("timestamp").alias("event_ts"), "service")


# Rows are spoiled by id so that each check rejects some.
@query(
    "a7_event_validation",
    """SELECT CASE event_id % 20 WHEN 1 THEN 'requestId is empty' WHEN 2 THEN 'timestamp is empty' WHEN 3 THEN 'route is empty' ELSE '' END
      || CASE WHEN event_id % 20 IN (4, 24) AND user_id IS NOT NULL THEN 'user.role is unknown' ELSE '' END AS reasons, count(*) AS n
    FROM wide_events GROUP BY 1""",
    W,
)
def _(spark, sf):
    k = F.col("eventId") % 20
    spoiled = (
        fx.events(spark, sf)
        .withColumn("requestId", F.when(k == 1, F.lit("")).otherwise(F.col("requestId")))
        .withColumn("timestamp", F.when(k != 2, F.col("timestamp")))
        .withColumn("route", F.when(k != 3, F.col("route")))
        .withColumn("user", F.when(k == 4, F.when(F.col("user").isNotNull(), F.struct("user.id", F.lit("boss").alias("role")))).otherwise(F.col("user")))
    )
    checked = spoiled.withColumn("reasons", F.array_join(validation.event_reasons(), ""))
    return checked.groupBy("reasons").agg(F.count("*").alias("n"))


@query(
    "a7_table_validation",
    "SELECT CASE WHEN event_id % 4 = 0 THEN 'summary is missing' ELSE '' END AS reasons, count(*) AS n FROM event_embeddings GROUP BY 1",
    ("event_embeddings",),
)
def _(spark, sf):
    rows = fx.embedded(spark, sf).withColumn("createdAt", F.col("timestamp")).withColumn("summary", F.when(F.col("eventId") % 4 != 0, "text"))
    reasons = F.array_join(validation.required_reasons(rows, EMBEDDED_EVENT, REQUIRED_EMBEDDED), "; ")
    return rows.groupBy(reasons.alias("reasons")).agg(F.count("*").alias("n"))


@query(
    "a8_progress_upsert",
    """SELECT service AS source, max(event_id) AS last_event_id, max(event_ts) AS last_event_ts FROM wide_events GROUP BY 1""",
    W,
)
def _(spark, sf):
    path = fresh_path(spark, "progress")
    e = fx.events(spark, sf)
    # Two commits: the earlier half first, then everything.
    for part, at in ((e.filter(F.col("timestamp") < _now("2024-01-15")), "2024-02-01"), (e, "2024-02-02")):
        mark = part.groupBy(F.col("service").alias("source")).agg(F.max(F.struct("timestamp", "eventId")).alias("m"))
        rows = mark.select(
            "source", F.col("m.eventId").alias("lastEmbeddedEventId"), F.col("m.timestamp").alias("lastEmbeddedEventTimestamp"),
            _now(at).alias("lastUpdatedAt"),
        )
        src.save_progress(rows, path)
    latest = src.read_progress(spark, path, EMBEDDING_PROGRESS)
    return latest.select(
        "source", F.col("lastEmbeddedEventId").alias("last_event_id"), F.col("lastEmbeddedEventTimestamp").alias("last_event_ts")
    )


@query("a9_key_lookup", "SELECT request_id, event_ts, service FROM wide_events WHERE event_id IN (SELECT vec_id FROM embeddings)", W)
def _(spark, sf):
    keys = fx.embedded(spark, sf).select("eventId")
    hit = src.lookup_events(fx.events(spark, sf), keys, "eventId")
    return hit.select(F.col("requestId").alias("request_id"), F.col("timestamp").alias("event_ts"), "service")


@query(
    "a10_retention",
    f"SELECT event_ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS kept, count(*) AS n, min(event_ts) AS first_ts, max(event_ts) AS last_ts FROM wide_events GROUP BY 1",
    W,
)
def _(spark, sf):
    e = fx.events(spark, sf).withColumn("event_date", F.to_date("timestamp"))
    hot, cold = src.retention_split(e, _now())
    both = hot.withColumn("kept", F.lit(True)).unionByName(cold.withColumn("kept", F.lit(False)))
    return both.groupBy("kept").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


# Marks of four quarters of the events, one upsert each, merged after the second and the fourth.
@query(
    "a8_snapshots",
    """SELECT service AS source, max(event_id) AS last_event_id, max(event_id) FILTER (event_id % 4 < 3) AS earlier_event_id, 6::BIGINT AS versions FROM wide_events GROUP BY 1""",
    W,
)
def _(spark, sf):
    table = SnapshotTable(spark, fresh_path(spark, "snapshots"), EMBEDDING_PROGRESS, "source", "lastEmbeddedEventId", max_deltas=2, keep=3)
    e = fx.events(spark, sf)
    versions = []
    for part in range(4):
        marks = e.filter(F.col("eventId") % 4 == part).groupBy(F.col("service").alias("source")).agg(
            F.max("eventId").alias("lastEmbeddedEventId"), F.max("timestamp").alias("lastEmbeddedEventTimestamp")
        )
        versions.append(table.upsert(marks.withColumn("lastUpdatedAt", _now())))
    earlier = table.read(versions[2]).select("source", F.col("lastEmbeddedEventId").alias("earlier_event_id"))
    last = table.read().select("source", F.col("lastEmbeddedEventId").alias("last_event_id"))
    return last.join(earlier, "source").withColumn("versions", F.lit(max(table.versions())).cast("bigint"))


@query(
    "a10_retention_run",
    f"""SELECT CAST(event_ts AS DATE)::VARCHAR AS day, CASE WHEN CAST(event_ts AS DATE) < DATE '2024-01-16' THEN 'archive' ELSE 'table' END AS place,
      count(*) AS n, min(event_id) AS first_id FROM wide_events GROUP BY 1, 2""",
    W,
)
def _(spark, sf):
    table, archive = fresh_path(spark, "event-table"), fresh_path(spark, "event-archive")
    src.append_events(fx.events(spark, sf), table)
    today = dt.date(2024, 2, 15)
    retention.expire_days(spark, table, archive, today)
    retention.expire_days(spark, table, archive, today)  # finds nothing more
    both = spark.read.parquet(table).withColumn("place", F.lit("table")).unionByName(
        retention.read_archive(spark, archive).withColumn("place", F.lit("archive"))
    )
    return both.groupBy(F.col("event_date").cast("string").alias("day"), "place").agg(F.count("*").alias("n"), F.min("eventId").alias("first_id"))


# --- streams ---------------------------------------------------------------------------
def _stream(spark, df, batches=1):
    """``df`` written to files and read back as a stream of ``batches`` micro-batches.

    Every batch holds an equal share of the files, whose number follows the
    cluster, so that no task writes or reads more than its part.
    """
    path = fresh_path(spark, "stream-source")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per_batch = -(-tasks // batches)
    df.repartition(per_batch * batches).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _run(start, *args, **kwargs):
    start(*args, **kwargs).awaitTermination()


def _staged(spark, parts, start):
    """One micro-batch after the other: each part arrives, and the query resumes from its checkpoint."""
    path, checkpoint = fresh_path(spark, "stream-source"), fresh_path(spark, "cp")
    for part in parts:
        part.write.mode("append").parquet(path)
        start(spark.readStream.schema(part.schema).parquet(path), checkpoint).awaitTermination()


def _in_time_order(df, column):
    """Thirds of the time span in order; with the last come copies of the first tenth, far too late."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    cuts = [F.lit(low + (high - low) * share) for share in (0.1, 1 / 3, 2 / 3)]
    t = F.col(column)
    last = df.filter(t > cuts[2]).unionByName(df.filter(t < cuts[0]))
    return [df.filter(t <= cuts[1]), df.filter((t > cuts[1]) & (t <= cuts[2])), last]


@query("i1_event_ingest", FLAT + f" WHERE NOT ({BAD})", W)
def _(spark, sf):
    path = fresh_path(spark, "ingested")
    _run(pipelines.ingest, _stream(spark, _messages(spark, sf), 3), path, fresh_path(spark, "cp"))
    return _flat(spark.read.parquet(path))


@query(
    "a5_micro_batch_persist",
    f"SELECT count(*) FILTER (event_id % 70 <> 3) AS events, count(*) FILTER (NOT ({BAD})) AS successes, count(*) FILTER (event_id % 70 <> 3 AND ({BAD})) AS failures, 3::BIGINT AS batches FROM wide_events",
    W,
)
def _(spark, sf):
    root = fresh_path(spark, "persisted")
    _run(pipelines.persist_batches, _stream(spark, _messages(spark, sf), 3), root, fresh_path(spark, "cp"))
    return spark.read.parquet(f"{root}/stats").agg(
        F.sum("events").alias("events"), F.sum("successes").alias("successes"), F.sum("failures").alias("failures"),
        F.count("*").alias("batches"),
    )


# Two streams one after the other, so that what is in a batch is fixed: even events, then odd ones.
@query(
    "e15_batch_delivery_stats",
    f"""SELECT event_id % 2 AS batch_no, count(*) FILTER (event_id % 70 <> 3) AS events, count(*) FILTER (NOT ({BAD})) AS successes,
      count(*) FILTER (event_id % 70 <> 3 AND ({BAD})) AS failures, TRUE AS timed FROM wide_events GROUP BY 1""",
    W,
)
def _(spark, sf):
    parts = []
    for no in (0, 1):
        root = fresh_path(spark, "persisted")
        part = _messages(spark, sf, no)
        _run(pipelines.persist_batches, _stream(spark, part, 1), root, fresh_path(spark, "cp"))
        parts.append(spark.read.parquet(f"{root}/stats").withColumn("batch_no", F.lit(no).cast("bigint")))
    return parts[0].unionByName(parts[1]).select("batch_no", "events", "successes", "failures", (F.col("tookMs") >= 0).alias("timed"))


@query(
    "i9_dead_letter",
    f"""SELECT CASE WHEN event_id % 50 = 1 THEN 'unreadable message' ELSE 'service is empty' END AS reason, count(*) AS n
    FROM wide_events WHERE event_id % 70 <> 3 AND ({BAD}) GROUP BY 1""",
    W,
)
def _(spark, sf):
    root = fresh_path(spark, "persisted")
    _run(pipelines.persist_batches, _stream(spark, _messages(spark, sf)), root, fresh_path(spark, "cp"))
    dead = spark.read.parquet(f"{root}/events").filter("outcome = 'rejected'")
    return dead.groupBy(F.array_join("reasons", "; ").alias("reason")).agg(F.count("*").alias("n"))


@query("i2_stream_dedup", "SELECT request_id FROM wide_events", W)
def _(spark, sf):
    e = fx.events(spark, sf).select("requestId", "timestamp")
    twice = e.unionByName(e.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 2 SECONDS")))
    path = fresh_path(spark, "deduplicated")
    _run(pipelines.to_table, pipelines.deduplicate(_stream(spark, twice, 2), "60 days"), path, fresh_path(spark, "cp"))
    return spark.read.parquet(path).select(F.col("requestId").alias("request_id"))


@query(
    "i3_stream_sampling",
    f"SELECT request_id, {q.SUMMARY} AS summary, {q.BUCKET} AS latency_bucket, {REASON} AS reason FROM wide_events WHERE {REASON} <> 'NOT_SAMPLED'",
    W,
)
def _(spark, sf):
    path = fresh_path(spark, "sampled")
    sampled = pipelines.enrich_and_sample(_stream(spark, fx.events(spark, sf), 2), POLICY)
    _run(pipelines.to_table, sampled, path, fresh_path(spark, "cp"))
    return spark.read.parquet(path).select(
        F.col("requestId").alias("request_id"), F.col("_summary").alias("summary"), F.col("latencyBucket").alias("latency_bucket"),
        F.col("_sampling.reason").alias("reason"),
    )


CLOSED = "(SELECT date_trunc('millisecond', max({0})) - INTERVAL 10 MINUTE FROM {1})"


@query(
    "i4_stream_incidents",
    f"""WITH x AS (SELECT time_bucket(INTERVAL 6 HOUR, event_ts) - i * INTERVAL 6 HOUR AS window_start, service, route, error_code
      FROM wide_events, generate_series(0, 3) g(i) WHERE error_code IS NOT NULL)
    SELECT window_start, service, route, error_code, count(*) AS errors FROM x
    WHERE window_start + INTERVAL 1 DAY <= {CLOSED.format('event_ts', "wide_events WHERE error_code IS NOT NULL")} GROUP BY 1, 2, 3, 4 HAVING count(*) > 3""",
    W,
)
def _(spark, sf):
    path = fresh_path(spark, "incidents")
    parts = _in_time_order(fx.events(spark, sf).filter("error is not null"), "timestamp")

    def start(stream, cp):
        failing = stream.withWatermark("timestamp", "10 minutes")
        return pipelines.to_table(incidents.incidents(failing, "1 day", "6 hours", 3), path, cp)

    _staged(spark, parts, start)
    return spark.read.parquet(path).select(
        F.col("windowStart").alias("window_start"), "service", "route", F.col("errorCode").alias("error_code"), "errors"
    )


@query(
    "i5_stream_metrics",
    f"""SELECT date_trunc('hour', event_ts) AS window_start, service, count(*) AS total, count(error_code) AS errors, coalesce(max(duration_ms), -1) AS max_ms, coalesce(quantile_disc(duration_ms, 0.95), -1) AS p95_ms FROM wide_events
    WHERE date_trunc('hour', event_ts) + INTERVAL 1 HOUR <= {CLOSED.format('event_ts', 'wide_events')} GROUP BY 1, 2""",
    W,
)
def _(spark, sf):
    path = fresh_path(spark, "metrics")

    def start(stream, cp):
        return pipelines.to_table(incidents.tumbling_metrics(stream.withWatermark("timestamp", "10 minutes"), "1 hour"), path, cp)

    _staged(spark, _in_time_order(fx.events(spark, sf), "timestamp"), start)
    return spark.read.parquet(path).select(
        F.col("windowStart").alias("window_start"), "service", "total", "errors",
        F.coalesce("maxMs", F.lit(-1)).alias("max_ms"), F.coalesce("p95Ms", F.lit(-1)).alias("p95_ms"),
    )


# Hourly sketches of a stream, stored as the watermark closes them, then merged to days.
@query(
    "i5_stream_sketches",
    f"""SELECT CAST(event_ts AS DATE)::VARCHAR AS day, service, count(*) AS requests, count(error_code) AS errors, coalesce(max(duration_ms), -1) AS max_ms, coalesce(quantile_disc(duration_ms, 0), -1) AS least_ms
    FROM wide_events WHERE date_trunc('hour', event_ts) + INTERVAL 1 HOUR <= {CLOSED.format('event_ts', 'wide_events')} GROUP BY 1, 2""",
    W,
)
def _(spark, sf):
    path = fresh_path(spark, "hour-sketches")

    def start(stream, cp):
        return pipelines.to_table(sketches.minute_sketches(stream.withWatermark("timestamp", "10 minutes"), ("service",), "1 hour"), path, cp)

    _staged(spark, _in_time_order(fx.events(spark, sf), "timestamp"), start)
    days = sketches.sketched_percentiles(sketches.rolled_up(spark.read.parquet(path), "day", ("service",)), (0.0,))
    return days.select(
        F.to_date("start").cast("string").alias("day"), "service", "requests", "errors",
        F.coalesce("maxMs", F.lit(-1)).alias("max_ms"), F.coalesce("p0", F.lit(-1)).alias("least_ms"),
    )


SESSION_SQL = """WITH g AS (SELECT session_id, created_at, CASE WHEN created_at - lag(created_at) OVER w {op} INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM chat_history
    WINDOW w AS (PARTITION BY session_id ORDER BY created_at)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY created_at) AS no FROM g)
  SELECT session_id, min(created_at) AS started_at, count(*) AS turns FROM s GROUP BY session_id, no"""


@query(
    "i6_session_windows",
    SESSION_SQL.format(op="<") + f" HAVING max(created_at) + INTERVAL 30 MINUTE <= {CLOSED.format('created_at', 'chat_history')}",
    ("chat_history",),
)
def _(spark, sf):
    path = fresh_path(spark, "sessions")
    parts = _in_time_order(fx.history(spark, sf).select("sessionId", "createdAt"), "createdAt")
    _staged(spark, parts, lambda stream, cp: pipelines.to_table(pipelines.session_windows(stream), path, cp))
    return spark.read.parquet(path).toDF("session_id", "started_at", "turns")


@query(
    "i6_session_state",
    # Closed by the watermark, or by a later turn of the same session.
    SESSION_SQL.format(op="<=")
    + f""" HAVING max(created_at) + INTERVAL 30 MINUTE < {CLOSED.format('created_at', 'chat_history')}
      OR no < (SELECT max(no) FROM s s2 WHERE s2.session_id = s.session_id)""",
    ("chat_history",),
)
def _(spark, sf):
    path = fresh_path(spark, "sessions")
    parts = _in_time_order(fx.history(spark, sf).select("sessionId", "createdAt"), "createdAt")
    _staged(spark, parts, lambda stream, cp: pipelines.to_table(pipelines.session_state(stream), path, cp))
    return spark.read.parquet(path).select(F.col("sessionId").alias("session_id"), F.col("startedAt").alias("started_at"), "turns")


# Turns of the last two hours of a batch with an even pair number come one batch late, within the three hours of lateness.
@query(
    "i6_session_history",
    f"""WITH g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM chat_history
      WINDOW w AS (PARTITION BY session_id ORDER BY created_at, turn)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY created_at, turn) AS no FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, no ORDER BY created_at DESC, turn DESC) AS age FROM s)
    SELECT session_id, min(created_at) AS started_at, max(created_at) AS last_at, count(*) AS turns,
      string_agg(turn::VARCHAR || ': ' || question || ' -> ' || answer, chr(10) ORDER BY age DESC) FILTER (age <= 2) AS history,
      max(created_at) + INTERVAL 30 MINUTE < {CLOSED.format('created_at', 'chat_history').replace('10 MINUTE', '3 HOUR')} AS closed
    FROM r GROUP BY session_id, no""",
    ("chat_history",),
)
def _(spark, sf):
    path, checkpoints = fresh_path(spark, "sessions"), []
    history = fx.history(spark, sf).select("sessionId", "createdAt", "turn", "question", "answer")
    first, second, third = _in_time_order(history, "createdAt")

    def split(part):
        held = F.col("createdAt") > F.lit(part.agg(F.max("createdAt")).first()[0]) - F.expr("INTERVAL 2 HOURS")
        held = held & (F.col("turn") % 4 == 0)
        return part.filter(~held), part.filter(held)

    (first, late1), (second, late2) = split(first), split(second)

    def start(stream, checkpoint):
        checkpoints.append(checkpoint)
        return pipelines.to_table(session_history.session_history(stream, keep=2, lateness="3 hours"), path, checkpoint)

    with session_history.rocksdb(spark):
        _staged(spark, [first, second.unionByName(late1), third.unionByName(late2)], start)
    closed = spark.read.parquet(path).withColumn("closed", F.lit(True))
    rows = closed.unionByName(session_history.open_sessions(spark, checkpoints[-1], keep=2).withColumn("closed", F.lit(False)))
    line = lambda t: F.concat(t["turn"].cast("string"), F.lit(": "), t["question"], F.lit(" -> "), t["answer"])
    return rows.select(
        F.col("sessionId").alias("session_id"), F.col("startedAt").alias("started_at"), F.col("lastAt").alias("last_at"), "turns",
        F.array_join(F.transform("history", line), "\n").alias("history"), "closed",
    )


@query("i7_incremental_embedding", f"SELECT event_id, {q.DUAL} AS summary FROM wide_events", W)
def _(spark, sf):
    table = fresh_path(spark, "embedded")
    e = fx.stored_events(spark, sf)
    # The source delivers every fifth event again.
    again = e.unionByName(e.filter("eventId % 5 = 0"))
    _run(pipelines.embed_incrementally, _stream(spark, again, 3), table, fresh_path(spark, "cp"), _now())
    return spark.read.parquet(table).select(F.col("eventId").alias("event_id"), "summary")


# Three batches by event id; late is what lies ten minutes behind the greatest time of the batches before.
@query(
    "i8_late_data",
    """WITH b AS (SELECT event_id % 3 AS batch, max(event_ts) AS seen FROM wide_events GROUP BY 1)
    SELECT w.event_id, w.event_id % 3 AS batch_id, CASE WHEN event_ts < (SELECT max(seen) FROM b WHERE b.batch < w.event_id % 3) - INTERVAL 600 SECOND THEN 'late' ELSE 'on_time' END AS arrival
    FROM wide_events w""",
    W,
)
def _(spark, sf):
    root = fresh_path(spark, "arrivals")
    parts = [fx.events(spark, sf).filter(F.col("eventId") % 3 == n) for n in range(3)]
    _staged(spark, parts, lambda stream, cp: pipelines.divert_late(stream, root, cp, 600))
    return spark.read.parquet(f"{root}/rows").select(F.col("eventId").alias("event_id"), F.col("batch_id").cast("bigint").alias("batch_id"), "arrival")
