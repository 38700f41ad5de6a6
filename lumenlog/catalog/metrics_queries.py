"""Registered queries: filters, metrics, audits, sampling, incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.catalog import fixtures as fx
from lumenlog.catalog.registry import query
from lumenlog.operators import audits, filters, incidents, metrics, sampling, sketches
from lumenlog.operators.embedding import advance_mark
from lumenlog.operators.filters import QueryMetadata
from lumenlog.operators.metrics import MetricParams
from lumenlog.session import fresh_path, materialize

W = ("wide_events",)
ROLE = "CASE WHEN user_id IS NULL THEN NULL WHEN user_role_raw IN ('admin','user','premium','guest') THEN user_role_raw ELSE 'guest' END"
HASH = "('0x' || substr(md5(request_id), 1, 8))::BIGINT % 10000"
WEEK = QueryMetadata(start_time="2024-01-03 00:00:00", end_time="2024-01-20 12:00:00")
WEEK_SQL = "event_ts >= TIMESTAMP '2024-01-03 00:00:00' AND event_ts <= TIMESTAMP '2024-01-20 12:00:00'"


# --- C: filters -----------------------------------------------------------------
def _flat(df):
    return df.select(
        F.col("eventId").alias("event_id"),
        F.col("requestId").alias("request_id"),
        "service",
        "route",
        F.col("error.code").alias("error_code"),
    )


FLAT = "SELECT event_id, request_id, service, route, error_code FROM wide_events WHERE "
C1 = QueryMetadata(
    start_time=WEEK.start_time, end_time=WEEK.end_time, service="payments", error_code="GATEWAY_TIMEOUT", has_error=True
)


@query("c1_metric_filter", FLAT + f"{WEEK_SQL} AND service = 'payments' AND error_code = 'GATEWAY_TIMEOUT'", W)
def _(spark, sf):
    return _flat(filters.apply_metadata(fx.events(spark, sf), C1))


@query("c1_metric_filter_compat", FLAT + f"{WEEK_SQL} AND service = 'payments' AND error_code IS NOT NULL", W)
def _(spark, sf):
    return _flat(filters.apply_metadata(fx.events(spark, sf), C1, compat=True))


@query("c1_metric_filter_no_error", FLAT + "route = 'GET /products' AND error_code IS NULL", W)
def _(spark, sf):
    return _flat(filters.apply_metadata(fx.events(spark, sf), QueryMetadata(route="GET /products", has_error=False)))


@query(
    "c2_vector_prefilter",
    "SELECT event_id, label FROM event_embeddings WHERE service = 'orders' AND event_ts >= TIMESTAMP '2024-01-01 06:00:00'",
    ("event_embeddings",),
)
def _(spark, sf):
    md = QueryMetadata(service="orders", start_time="2024-01-01 06:00:00", has_error=True)
    return filters.vector_prefilter(fx.embedded(spark, sf), md).select(F.col("eventId").alias("event_id"), "label")


@query("c3_grounding_postfilter", FLAT + "error_code = 'CARD_EXPIRED'", W)
def _(spark, sf):
    md = QueryMetadata(error_code="CARD_EXPIRED", has_error=True)
    return _flat(filters.grounding_postfilter(fx.events(spark, sf), md))


@query(
    "c4_pending_page",
    """WITH mark AS (SELECT max((event_ts, event_id)) AS m FROM event_embeddings)
    SELECT event_id, event_ts FROM wide_events WHERE (event_ts, event_id) > (SELECT m FROM mark)
    ORDER BY event_ts, event_id LIMIT 100""",
    ("event_embeddings",),
)
def _(spark, sf):
    mark = advance_mark(fx.embedded(spark, sf), "wide_events", F.lit("2024-02-01").cast("timestamp")).first()
    page = filters.pending_page(
        fx.stored_events(spark, sf), mark["lastEmbeddedEventTimestamp"], mark["lastEmbeddedEventId"], 100
    )
    return page.select(F.col("eventId").alias("event_id"), F.col("timestamp").alias("event_ts"))


@query(
    "c5_users_impacted",
    """SELECT user_id, count(*) AS events, min(event_ts) AS first_seen, max(event_ts) AS last_seen
    FROM wide_events WHERE error_code = 'GATEWAY_TIMEOUT' AND user_id IS NOT NULL GROUP BY user_id""",
    W,
)
def _(spark, sf):
    return filters.users_impacted(fx.events(spark, sf), "GATEWAY_TIMEOUT").toDF(
        "user_id", "events", "first_seen", "last_seen"
    )


@query(
    "c6_event_by_user",
    "SELECT event_id, request_id, service, route, error_code FROM wide_events WHERE user_id = 'user-8' ORDER BY event_ts, request_id LIMIT 1",
    W,
)
def _(spark, sf):
    return _flat(filters.event_by_user(fx.events(spark, sf), "user-8"))


# --- D: sampling ----------------------------------------------------------------
POLICY = sampling.SamplingPolicy(normal_rate=0.05, critical_routes=("POST /payments/checkout",))
REASON = f"""CASE WHEN error_code IS NOT NULL THEN 'HAS_ERROR' WHEN duration_ms > 2000 THEN 'SLOW_REQUEST'
  WHEN route = 'POST /payments/checkout' THEN 'CRITICAL_ROUTE' WHEN {HASH} < 500 THEN 'SAMPLED_NORMAL' ELSE 'NOT_SAMPLED' END"""


@query("d1_sampling_decision", f"SELECT request_id, {REASON} AS reason, {REASON} <> 'NOT_SAMPLED' AS should_record FROM wide_events", W)
def _(spark, sf):
    return sampling.decide(fx.events(spark, sf), POLICY).select(
        F.col("requestId").alias("request_id"), "reason", F.col("shouldRecord").alias("should_record")
    )


@query("d2_hash_sampling", f"SELECT request_id FROM wide_events WHERE {HASH} < 100", W)
def _(spark, sf):
    ev = fx.events(spark, sf)
    return ev.filter(sampling.is_sampled(F.col("requestId"), 0.01)).select(F.col("requestId").alias("request_id"))


@query("d3_sampled_write", f"SELECT request_id, TRUE AS recorded, {REASON} AS reason FROM wide_events WHERE {REASON} <> 'NOT_SAMPLED'", W)
def _(spark, sf):
    return sampling.sample_with_audit(fx.events(spark, sf), POLICY).select(
        F.col("requestId").alias("request_id"), "_sampling.recorded", "_sampling.reason"
    )


@query(
    "d4_retention_report",
    f"""SELECT count(*) AS total, count(*) FILTER (r <> 'NOT_SAMPLED') AS kept, count(error_code) AS errors,
    count(error_code) FILTER (r <> 'NOT_SAMPLED') AS errors_kept, count(*) FILTER (duration_ms > 2000) AS slow,
    count(*) FILTER (duration_ms > 2000 AND r <> 'NOT_SAMPLED') AS slow_kept,
    (count(*) FILTER (r = 'NOT_SAMPLED')) * 100.0::DOUBLE / count(*) AS reduction_pct
    FROM (SELECT *, {REASON} AS r FROM wide_events)""",
    W,
)
def _(spark, sf):
    return sampling.retention_report(fx.events(spark, sf), POLICY).toDF(
        "total", "kept", "errors", "errors_kept", "slow", "slow_kept", "reduction_pct"
    )


@query("d4_reason_counts", f"SELECT {REASON} AS reason, count(*) AS n FROM wide_events GROUP BY 1", W)
def _(spark, sf):
    return sampling.reason_counts(fx.events(spark, sf), POLICY)


# Route policy used by the hint operators: path, hint.
HINTS = {"POST /payments/checkout": "critical", "POST /payments": "important", "GET /products": "low"}
HINT = "CASE route WHEN 'POST /payments/checkout' THEN 'critical' WHEN 'POST /payments' THEN 'important' WHEN 'GET /products' THEN 'low' END"


@query(
    "d5_hint_rates",
    f"""SELECT request_id, CASE WHEN error_code IS NOT NULL THEN 'HAS_ERROR' WHEN duration_ms > 2000 THEN 'SLOW_REQUEST'
      WHEN {HASH} < CASE {HINT} WHEN 'critical' THEN 10000 WHEN 'important' THEN 2000 WHEN 'low' THEN 20 ELSE 200 END THEN 'SAMPLED_NORMAL'
      ELSE 'NOT_SAMPLED' END AS reason FROM wide_events""",
    W,
)
def _(spark, sf):
    from lumenlog.operators.assembly import attach_sampling_hint

    policy = sampling.SamplingPolicy(normal_rate=0.02)
    ev = attach_sampling_hint(fx.events(spark, sf), HINTS)
    rate = sampling.hint_rate(F.col("_samplingHint"), policy.normal_rate)
    return sampling.decide(ev, policy, rate).select(F.col("requestId").alias("request_id"), "reason")


# Every eleventh event has lost its time.
@query(
    "d6_adaptive_rates",
    f"""WITH t AS (SELECT *, CASE WHEN event_id % 11 <> 0 THEN floor(epoch(event_ts) / 3600)::BIGINT END AS bucket FROM wide_events),
    v AS (SELECT bucket, count(*) AS volume FROM t WHERE bucket IS NOT NULL GROUP BY 1),
    r AS (SELECT bucket, CASE WHEN volume > (SELECT sum(volume) / count(*)::DOUBLE FROM v) * 1.2 THEN 10 ELSE 500 END AS cut FROM v)
    SELECT request_id, CASE WHEN error_code IS NOT NULL THEN 'HAS_ERROR' WHEN duration_ms > 2000 THEN 'SLOW_REQUEST'
      WHEN {HASH} < coalesce(cut, 500) THEN 'SAMPLED_NORMAL' ELSE 'NOT_SAMPLED' END AS reason
    FROM t LEFT JOIN r ON r.bucket = t.bucket""",
    W,
)
def _(spark, sf):
    policy = sampling.SamplingPolicy(normal_rate=0.05)
    timed = fx.events(spark, sf).withColumn("timestamp", F.when(F.col("eventId") % 11 != 0, F.col("timestamp")))
    return sampling.decide_adaptive(timed, policy, 3600, 1.2, 0.001).select(
        F.col("requestId").alias("request_id"), "reason"
    )


@query(
    "d7_embedding_selection",
    f"""SELECT request_id, CASE WHEN error_code IS NOT NULL THEN 'ERROR' WHEN {ROLE} = 'premium' THEN 'PREMIUM'
      WHEN {HASH} < 1000 THEN 'SAMPLED' ELSE 'SKIP' END AS choice FROM wide_events""",
    W,
)
def _(spark, sf):
    return fx.events(spark, sf).select(
        F.col("requestId").alias("request_id"), sampling.embedding_selection(0.1).alias("choice")
    )


# --- E: metrics -----------------------------------------------------------------
def _top_flat(df):
    return df.select("errorCode", "count", F.posexplode("examples").alias("pos", "e")).select(
        F.col("errorCode").alias("error_code"),
        F.col("count").alias("n"),
        (F.col("pos") + 1).cast("bigint").alias("example_no"),
        F.col("e.requestId").alias("request_id"),
        F.col("e.timestamp").alias("event_ts"),
        F.col("e.service").alias("service"),
        F.col("e.route").alias("route"),
        F.col("e.errorMessage").alias("error_message"),
    )


def top_sql(where: str, source: str = "wide_events", top: int = 5) -> str:
    return f"""WITH sel AS (SELECT * FROM {source} WHERE {where}),
    top AS (SELECT error_code, count(*) AS n FROM sel GROUP BY 1 ORDER BY n DESC, error_code NULLS FIRST LIMIT {top}),
    ex AS (SELECT *, row_number() OVER (PARTITION BY error_code ORDER BY event_ts, request_id) AS example_no FROM sel)
    SELECT ex.error_code, n, example_no, request_id, event_ts, service, route, error_message
    FROM ex JOIN top ON ex.error_code IS NOT DISTINCT FROM top.error_code WHERE example_no <= 3"""


@query("e1_top_error_codes", top_sql("error_code IS NOT NULL"), W)
def _(spark, sf):
    return _top_flat(metrics.top_error_codes(fx.events(spark, sf)))


@query("e1_top_error_codes_filtered", top_sql(f"error_code IS NOT NULL AND service = 'payments' AND {WEEK_SQL}", top=3), W)
def _(spark, sf):
    md = QueryMetadata(start_time=WEEK.start_time, end_time=WEEK.end_time, service="payments", has_error=True)
    return _top_flat(metrics.top_error_codes(fx.events(spark, sf), MetricParams(md, top_n=3)))


@query("e1_top_error_codes_compat", top_sql("error_code IS NULL"), W)
def _(spark, sf):
    params = MetricParams(QueryMetadata(has_error=False), compat=True)
    return _top_flat(metrics.top_error_codes(fx.events(spark, sf), params))


@query(
    "e2_error_distribution_by_route",
    """SELECT route, count(*) AS n, string_agg(DISTINCT error_code, ',' ORDER BY error_code) AS error_codes
    FROM wide_events WHERE error_code IS NOT NULL GROUP BY route ORDER BY n DESC, route LIMIT 5""",
    W,
)
def _(spark, sf):
    return metrics.error_distribution_by_route(fx.events(spark, sf)).select(
        "route", F.col("count").alias("n"), F.array_join("errorCodes", ",").alias("error_codes")
    )


@query(
    "e3_error_by_service",
    "SELECT service, count(*) AS n, 0::BIGINT AS top_codes FROM wide_events WHERE error_code IS NOT NULL GROUP BY service",
    W,
)
def _(spark, sf):
    return metrics.error_by_service(fx.events(spark, sf)).select(
        "service", F.col("count").alias("n"), F.size("topErrorCodes").cast("bigint").alias("top_codes")
    )


@query(
    "e3_error_by_service_top_codes",
    """WITH p AS (SELECT service, error_code, count(*) AS n FROM wide_events WHERE error_code IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY n DESC, error_code) AS k FROM p)
    SELECT service, sum(n)::BIGINT AS n, string_agg(error_code, ',' ORDER BY k) FILTER (k <= 3) AS top_codes FROM r GROUP BY service""",
    W,
)
def _(spark, sf):
    return metrics.error_by_service(fx.events(spark, sf), top_codes=3).select(
        "service", F.col("count").alias("n"), F.array_join("topErrorCodes", ",").alias("top_codes")
    )


def percentile_sql(where: str = "duration_ms IS NOT NULL", by: str = "", value: str = "duration_ms", source: str = "wide_events") -> str:
    """Floor-rank percentiles; no rows when nothing matches."""
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else "HAVING count(*) > 0"
    part = f"PARTITION BY {by}" if by else ""
    # Sums of doubles depend on their order; they are compared to six places.
    avg = f"round(sum({value}) / count(*)::DOUBLE, 6)" if value != "duration_ms" else f"sum({value}) / count(*)::DOUBLE"
    pick = lambda p: f"max({value}) FILTER (k = floor({p}::DOUBLE * n)::BIGINT)"
    return f"""WITH r AS (SELECT {cols}{value}, row_number() OVER ({part} ORDER BY {value}) - 1 AS k, count(*) OVER ({part}) AS n
      FROM {source} WHERE {where})
    SELECT {cols}count(*) AS n, {pick(0.5)} AS p50, {pick(0.95)} AS p95, {pick(0.99)} AS p99,
      {avg} AS avg_value, max({value}) AS max_value FROM r {group}"""


@query("e4_latency_percentile", percentile_sql(), W)
def _(spark, sf):
    return metrics.latency_percentile(fx.events(spark, sf)).toDF("n", "p50", "p95", "p99", "avg_value", "max_value")


@query("e4_latency_percentile_by_route", percentile_sql(by="route"), W)
def _(spark, sf):
    return metrics.latency_percentile(fx.events(spark, sf), by=("route",)).toDF(
        "route", "n", "p50", "p95", "p99", "avg_value", "max_value"
    )


@query("e4_quantity_percentile_by_flag", percentile_sql("l_quantity IS NOT NULL", "l_returnflag, l_linestatus", "l_quantity", "lineitem"))
def _(spark, sf):
    from lumenlog.plans.ranks import floor_rank_percentiles

    by = ["l_returnflag", "l_linestatus"]
    li = fx.table(spark, sf, "lineitem").select(*by, "l_quantity")
    out = floor_rank_percentiles(li, "l_quantity", metrics.PERCENTILES, by)
    return out.withColumn("avg", F.round("avg", 6)).toDF(*by, "n", "p50", "p95", "p99", "avg_value", "max_value")


RATE = "count(*) AS total, count(error_code) AS errors, count(error_code) * 100.0::DOUBLE / count(*) AS error_rate FROM wide_events"


@query("e5_error_rate", f"SELECT {RATE} HAVING count(*) > 0", W)
def _(spark, sf):
    return metrics.error_rate(fx.events(spark, sf)).toDF("total", "errors", "error_rate")


@query("e6_metric_dispatch", f"SELECT {RATE} WHERE {WEEK_SQL} AND service = 'orders' HAVING count(*) > 0", W)
def _(spark, sf):
    md = QueryMetadata(start_time=WEEK.start_time, end_time=WEEK.end_time, service="orders")
    return metrics.run_metric(fx.events(spark, sf), "ERROR_RATE", MetricParams(md)).toDF("total", "errors", "error_rate")


# Approximate: the value's rank is within 1 / accuracy of the wanted one.
@query("e7_approx_p95_by_route", "SELECT route, count(*) AS n, TRUE AS rank_ok FROM wide_events WHERE duration_ms IS NOT NULL GROUP BY route", W)
def _(spark, sf):
    e = fx.events(spark, sf)
    approx = metrics.approx_latency_by_route(e, 0.95, 1000).select("route", "p95", F.col("count").alias("n"))
    d, n = F.col("performance.durationMs"), F.col("n")
    return (
        e.join(approx, "route")
        .groupBy("route", "n")
        .agg(F.count_if(d < F.col("p95")).alias("below"), F.count_if(d <= F.col("p95")).alias("upto"))
        .select("route", "n", ((F.col("below") <= n * 0.951 + 1) & (F.col("upto") >= n * 0.949 - 1)).alias("rank_ok"))
    )


# Days from stored minutes: counts are exact, and each percentile has its rank within the sketch's error.
@query(
    "e7_stored_sketches",
    """SELECT CAST(event_ts AS DATE)::VARCHAR AS day, service, route, count(*) AS requests, count(error_code) AS errors, count(duration_ms) AS timed,
      coalesce(max(duration_ms), -1) AS max_ms, TRUE AS ranks_ok FROM wide_events GROUP BY 1, 2, 3""",
    W,
)
def _(spark, sf):
    e, path = fx.events(spark, sf), fresh_path(spark, "minute-sketches")
    sketches.append_sketches(sketches.minute_sketches(e), path)
    shares = (0.5, 0.95, 0.99)
    days = sketches.sketched_percentiles(sketches.rolled_up(spark.read.parquet(path), "day"), shares)
    took, n = F.col("performance.durationMs"), F.col("timed")
    keys = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("service", "route")] + [F.date_trunc("day", "timestamp") == F.col("start")]
    ranks = [f(took, F.col(f"p{100 * p:g}")).alias(f"{name}{100 * p:g}") for p in shares for name, f in (("below", lambda d, v: F.count_if(d < v)), ("upto", lambda d, v: F.count_if(d <= v)))]
    met = e.join(days.withColumnsRenamed({"service": "_service", "route": "_route"}), keys)
    found = met.groupBy("start", "_service", "_route", "requests", "errors", "timed", "maxMs").agg(*ranks)
    ok = F.lit(True)
    for p in shares:
        name = f"{100 * p:g}"
        ok = ok & (F.col(f"below{name}") <= n * (p + sketches.RANK_ERROR) + 1) & (F.col(f"upto{name}") >= n * (p - sketches.RANK_ERROR) - 1)
    return found.select(
        F.to_date("start").cast("string").alias("day"), F.col("_service").alias("service"), F.col("_route").alias("route"),
        "requests", "errors", "timed", F.coalesce("maxMs", F.lit(-1)).alias("max_ms"), ok.alias("ranks_ok"),
    )


@query("e8_error_rate_by_route", f"SELECT route, {RATE} GROUP BY route", W)
def _(spark, sf):
    return metrics.error_rate(fx.events(spark, sf), by=("route",)).toDF("route", "total", "errors", "error_rate")


@query(
    "e9_record_counts",
    """SELECT count(*) AS total, count(error_code) AS errors, count(*) FILTER (duration_ms > 2000) AS slow,
    count(*) FILTER (event_id % 2 = 0) AS with_metadata FROM wide_events""",
    W,
)
def _(spark, sf):
    meta = F.when(F.col("eventId") % 2 == 0, F.lit("{}"))
    return audits.record_counts(fx.events(spark, sf).withColumn("_metadata", meta)).toDF(
        "total", "errors", "slow", "with_metadata"
    )


@query("e10_distribution", "SELECT service, route, count(*) AS n FROM wide_events GROUP BY 1, 2", W)
def _(spark, sf):
    return audits.distribution(fx.events(spark, sf)).toDF("service", "route", "n")


@query("e10_distribution_rollup", "SELECT service, route, count(*) AS n FROM wide_events GROUP BY ROLLUP (service, route)", W)
def _(spark, sf):
    return audits.distribution_rollup(fx.events(spark, sf)).toDF("service", "route", "n")


@query(
    "e11_latest_events",
    f"""SELECT event_ts, request_id, service, route, CASE WHEN error_code IS NULL THEN 'OK' ELSE 'FAIL' END AS status, {REASON} AS reason
    FROM wide_events ORDER BY event_ts DESC, request_id LIMIT 5""",
    W,
)
def _(spark, sf):
    out = audits.latest_events(fx.events(spark, sf), sampling.sampling_reason(POLICY))
    return out.toDF("event_ts", "request_id", "service", "route", "status", "reason")


@query(
    "e12_delivery_health",
    """WITH s AS (SELECT date_trunc('day', event_ts) AS day, count(*) - count(error_code) AS success_count, count(error_code) AS failure_count,
      arg_max(error_message, (event_ts, event_id)) FILTER (error_code IS NOT NULL) AS last_error,
      max(event_ts) FILTER (error_code IS NOT NULL) AS last_error_time FROM wide_events GROUP BY 1)
    SELECT *, floor(success_count * 100.0::DOUBLE / (success_count + failure_count) * 100 + 0.5) / 100.0::DOUBLE AS success_rate,
      success_count + failure_count < 10 OR failure_count / (success_count + failure_count)::DOUBLE <= 0.05 AS healthy,
      success_count + failure_count >= 100 AND failure_count / (success_count + failure_count)::DOUBLE > 0.05 AS warn FROM s""",
    W,
)
def _(spark, sf):
    log = fx.events(spark, sf).select(
        F.col("timestamp").alias("at"), F.col("eventId").alias("id"), F.col("error.message").alias("error")
    )
    return audits.delivery_health(log, [F.date_trunc("day", "at").alias("day")]).toDF(
        "day", "success_count", "failure_count", "last_error", "last_error_time", "success_rate", "healthy", "warn"
    )


@query(
    "e13_embedding_progress",
    """SELECT count(*) AS total, count(v.vec_id) AS embedded, count(*) - count(v.vec_id) AS pending,
      max(v.vec_id) AS last_event_id, max(w.event_ts) FILTER (v.vec_id IS NOT NULL) AS last_event_ts
    FROM wide_events w LEFT JOIN embeddings v ON v.vec_id = w.event_id""",
    W,
)
def _(spark, sf):
    emb = fx.embedded(spark, sf)
    mark = advance_mark(emb, "wide_events", F.lit("2024-02-01").cast("timestamp"))
    return audits.embedding_progress(fx.events(spark, sf), emb, mark).toDF(
        "total", "embedded", "pending", "last_event_id", "last_event_ts"
    )


@query(
    "e14_cache_stats",
    """WITH c AS (SELECT event_ts, CASE WHEN label % 2 = 0 THEN 900000 ELSE 3600000 END AS ttl FROM event_embeddings)
    SELECT count(*) AS total_entries, count(*) FILTER (epoch_ms(TIMESTAMP '2024-01-01 08:00:00') - epoch_ms(event_ts) > ttl) AS expired_entries,
      count(*) FILTER (NOT epoch_ms(TIMESTAMP '2024-01-01 08:00:00') - epoch_ms(event_ts) > ttl) AS active_entries FROM c""",
    ("event_embeddings",),
)
def _(spark, sf):
    entries = fx.embedded(spark, sf).select(
        F.col("timestamp").alias("cachedAt"), F.when(F.col("label") % 2 == 0, 900000).otherwise(3600000).alias("ttlMs")
    )
    return audits.cache_stats(entries, F.lit("2024-01-01 08:00:00").cast("timestamp")).toDF(
        "total_entries", "expired_entries", "active_entries"
    )


@query(
    "e14_session_stats",
    """WITH p AS (SELECT session_id, max(created_at) AS last, count(*) AS n FROM chat_history GROUP BY 1)
    SELECT count(*) AS active_sessions, coalesce(sum(n), 0)::BIGINT AS total_messages FROM p
    WHERE last <= TIMESTAMP '2024-01-02 12:00:00' AND TIMESTAMP '2024-01-02 12:00:00' - last <= INTERVAL 30 MINUTE""",
    ("chat_history",),
)
def _(spark, sf):
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    return audits.session_stats(fx.history(spark, sf), now).toDF("active_sessions", "total_messages")


# Durations read as seconds, so that requests overlap.
def _requests(spark, sf):
    return fx.events(spark, sf).select(
        "requestId",
        F.col("timestamp").alias("startedAt"),
        F.timestamp_micros(
            F.unix_micros("timestamp") + F.coalesce(F.col("performance.durationMs"), F.lit(0)) * 1_000_000
        ).alias("endedAt"),
    )


CONC = """WITH r AS (SELECT request_id, event_ts AS s, event_ts + coalesce(duration_ms, 0) * INTERVAL 1 SECOND AS e FROM wide_events),
  d AS (SELECT request_id, e AS moment, 0 AS kind, -1 AS delta FROM r UNION ALL SELECT request_id, s, 1, 1 FROM r),
  t AS (SELECT *, sum(delta) OVER (ORDER BY moment, kind, request_id ROWS UNBOUNDED PRECEDING)::BIGINT AS in_flight FROM d)"""


@query("e16_concurrency", CONC + " SELECT request_id, moment AS started_at, in_flight, in_flight > 12 AS over_limit FROM t WHERE kind = 1", W)
def _(spark, sf):
    return audits.concurrency(_requests(spark, sf), "startedAt", "endedAt", 12).toDF(
        "request_id", "started_at", "in_flight", "over_limit"
    )


@query(
    "e16_backpressure_report",
    CONC + """ SELECT count(*) AS requests, count(*) FILTER (in_flight > 12) AS dropped, count(*) FILTER (in_flight <= 12) AS accepted,
    max(in_flight) AS peak FROM t WHERE kind = 1""",
    W,
)
def _(spark, sf):
    return audits.backpressure_report(_requests(spark, sf), "startedAt", "endedAt", 12)


@query(
    "e17_batch_token_share",
    """SELECT doc_id // 50 AS batch, count(*) AS texts, sum(len(string_split(text, ' ')))::BIGINT AS total_tokens,
      sum(len(string_split(text, ' ')))::BIGINT / count(*)::DOUBLE AS tokens_per_text FROM documents GROUP BY 1""",
)
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 50).cast("bigint").alias("batch"),
        F.size(F.split("text", " ")).cast("bigint").alias("tokens"),
    )
    return audits.batch_token_share(docs, "batch", "tokens").toDF("batch", "texts", "total_tokens", "tokens_per_text")


@query(
    "e17_usage_report",
    """SELECT intent AS template_type, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS calls, sum(length(question) + length(answer))::BIGINT AS tokens,
      round(sum((length(question) + length(answer)) * 0.002::DOUBLE), 6) AS cost, avg(length(answer) * 3) AS avg_response_ms
    FROM chat_history GROUP BY 1, 2""",
    ("chat_history",),
)
def _(spark, sf):
    tokens = (F.length("question") + F.length("answer")).cast("bigint")
    usage = fx.history(spark, sf).select(
        F.col("intent").alias("templateType"),
        F.date_format("createdAt", "yyyy-MM-dd").alias("day"),
        tokens.alias("tokens"),
        (tokens * F.lit(0.002)).alias("cost"),
        (F.length("answer") * 3).alias("responseTimeMs"),
    )
    out = audits.usage_report(usage, ("templateType", "day"))
    return out.withColumn("cost", F.round("cost", 6)).toDF("template_type", "day", "calls", "tokens", "cost", "avg_response_ms")


@query("e18_confidence_by_intent", percentile_sql("confidence IS NOT NULL", "intent", "confidence", "chat_history"), ("chat_history",))
def _(spark, sf):
    from lumenlog.plans.ranks import floor_rank_percentiles

    rows = fx.history(spark, sf).select("intent", "confidence")
    out = floor_rank_percentiles(rows, "confidence", metrics.PERCENTILES, ["intent"])
    return out.withColumn("avg", F.round("avg", 6)).toDF("intent", "n", "p50", "p95", "p99", "avg_value", "max_value")


@query(
    "e20_daily_briefing",
    """WITH d AS (SELECT CAST(event_ts AS DATE) AS day, count(*) AS total, count(error_code) AS errors, count(error_code) * 100.0::DOUBLE / count(*) AS error_rate
      FROM wide_events GROUP BY 1),
    l AS (SELECT *, error_rate - lag(error_rate) OVER (ORDER BY day) AS rate_change FROM d),
    c AS (SELECT CAST(event_ts AS DATE) AS day, error_code, count(*) AS code_errors FROM wide_events WHERE error_code IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY code_errors DESC, error_code) AS k FROM c)
    SELECT l.day::VARCHAR AS day, total, errors, error_rate, rate_change, k AS issue_rank, error_code, code_errors
    FROM l LEFT JOIN (SELECT * FROM r WHERE k <= 3) r ON r.day = l.day""",
    W,
)
def _(spark, sf):
    return incidents.daily_briefing(fx.events(spark, sf)).toDF(
        "day", "total", "errors", "error_rate", "rate_change", "issue_rank", "error_code", "code_errors"
    ).withColumns({"issue_rank": F.col("issue_rank").cast("bigint"), "day": F.col("day").cast("string")})


@query(
    "i4_incidents",
    """WITH x AS (SELECT time_bucket(INTERVAL 6 HOUR, event_ts) - i * INTERVAL 6 HOUR AS window_start, service, route, error_code
      FROM wide_events, generate_series(0, 3) g(i) WHERE error_code IS NOT NULL)
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, service, route, error_code, count(*) AS errors
    FROM x GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 3""",
    W,
)
def _(spark, sf):
    return incidents.incidents(fx.events(spark, sf), "1 day", "6 hours", 3).toDF(
        "window_start", "window_end", "service", "route", "error_code", "errors"
    )


# Windows of two days every twelve hours, from four errors on; merged where they overlap or touch.
STRETCHES = """x AS (SELECT time_bucket(INTERVAL 12 HOUR, event_ts) - i * INTERVAL 12 HOUR AS ws, service, route, error_code
      FROM wide_events, generate_series(0, 3) g(i) WHERE error_code IS NOT NULL),
    win AS (SELECT ws, service, route, error_code, count(*) AS errors FROM x GROUP BY 1, 2, 3, 4 HAVING count(*) > 3),
    isl AS (SELECT *, sum(fresh) OVER (PARTITION BY service, route, error_code ORDER BY ws) AS no FROM
      (SELECT *, CASE WHEN ws <= lag(ws) OVER (PARTITION BY service, route, error_code ORDER BY ws) + INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM win)),
    inc AS (SELECT service, route, error_code, min(ws) AS started_at, max(ws) + INTERVAL 2 DAY AS ended_at, count(*) AS windows, max(errors) AS peak_errors,
      CASE WHEN max(errors) >= 12 THEN 'critical' WHEN max(errors) >= 6 THEN 'major' ELSE 'minor' END AS severity,
      service || '|' || route || '|' || error_code || '|' || strftime(min(ws), '%Y-%m-%dT%H:%M') AS incident_id FROM isl GROUP BY service, route, error_code, no)"""


def _stretches(spark, sf):
    windows = incidents.incidents(fx.events(spark, sf), "2 days", "12 hours", 3)
    return materialize(incidents.incident_stretches(windows, 3), "incidents")  # few rows, read several times


@query("i4_incident_stretches", f"WITH {STRETCHES} SELECT incident_id, started_at, ended_at, windows, peak_errors, severity FROM inc", W)
def _(spark, sf):
    return _stretches(spark, sf).select(
        F.col("incidentId").alias("incident_id"), F.col("startedAt").alias("started_at"), F.col("endedAt").alias("ended_at"),
        "windows", F.col("peakErrors").alias("peak_errors"), "severity",
    )


@query(
    "i4_incident_impact",
    f"""WITH {STRETCHES}, met AS (SELECT incident_id, request_id, user_id, event_ts, coalesce(w.error_code = i.error_code, FALSE) AS failed
      FROM wide_events w JOIN inc i ON w.service = i.service AND w.route = i.route AND event_ts >= started_at AND event_ts < ended_at),
    f AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY event_ts, request_id) AS no FROM met WHERE failed)
    SELECT m.incident_id, count(*) AS requests, count(*) FILTER (failed) AS errors, count(DISTINCT user_id) FILTER (failed) AS users,
      min(event_ts) FILTER (failed) AS first_at, max(event_ts) FILTER (failed) AS last_at, count(*) FILTER (failed) * 100.0::DOUBLE / count(*) AS error_rate,
      any_value(traces) AS traces
    FROM met m JOIN (SELECT incident_id, string_agg(request_id, ',' ORDER BY no) AS traces FROM f WHERE no <= 3 GROUP BY 1) t ON t.incident_id = m.incident_id GROUP BY 1""",
    W,
)
def _(spark, sf):
    return incidents.incident_impact(fx.events(spark, sf), _stretches(spark, sf), 86_400).select(
        F.col("incidentId").alias("incident_id"), "requests", "errors", "users", F.col("firstAt").alias("first_at"),
        F.col("lastAt").alias("last_at"), F.col("errorRate").alias("error_rate"), F.array_join("relatedTraces", ",").alias("traces"),
    )


@query(
    "e20_system_briefing",
    f"""WITH {STRETCHES}, c AS (SELECT CAST(event_ts AS DATE) AS day, error_code, count(*) AS n FROM wide_events GROUP BY 1, 2),
    d AS (SELECT day, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (error_code IS NOT NULL), 0)::BIGINT AS failed FROM c GROUP BY 1),
    r AS (SELECT *, failed * 100.0::DOUBLE / total AS error_rate, failed * 100.0::DOUBLE / total - lag(failed * 100.0::DOUBLE / total) OVER (ORDER BY day) AS rate_change FROM d),
    m AS (SELECT c.day, c.error_code, c.n, c.n - coalesce(b.n, 0) AS change FROM c LEFT JOIN c b ON b.day = c.day - INTERVAL 1 DAY AND b.error_code = c.error_code WHERE c.error_code IS NOT NULL),
    h AS (SELECT CAST(event_ts AS DATE) AS day, i.error_code, incident_id, severity, count(*) AS n FROM wide_events w JOIN inc i
      ON w.service = i.service AND w.route = i.route AND w.error_code = i.error_code AND event_ts >= started_at AND event_ts < ended_at GROUP BY 1, 2, 3, 4),
    s AS (SELECT day, 'code' AS section, row_number() OVER (PARTITION BY day ORDER BY n DESC, error_code) AS k, error_code, NULL AS incident_id, NULL AS severity, n, change FROM m
      UNION ALL SELECT day, 'trend', row_number() OVER (PARTITION BY day ORDER BY change DESC, error_code), error_code, NULL, NULL, n, change FROM m WHERE change > 0
      UNION ALL SELECT day, 'incident', row_number() OVER (PARTITION BY day ORDER BY n DESC, incident_id), error_code, incident_id, severity, n, NULL FROM h)
    SELECT r.day::VARCHAR AS day, total, failed, error_rate, coalesce(rate_change, 0) AS rate_change, coalesce(section, '') AS section, coalesce(k, 0) AS section_rank, coalesce(error_code, '') AS error_code,
      coalesce(incident_id, '') AS incident_id, coalesce(severity, '') AS severity, coalesce(n, 0) AS errors, coalesce(change, 0) AS change
    FROM r LEFT JOIN (SELECT * FROM s WHERE k <= 3) s ON s.day = r.day""",
    W,
)
def _(spark, sf):
    out = incidents.system_briefing(fx.events(spark, sf), _stretches(spark, sf), cell_seconds=86_400)
    texts, numbers = ("section", "errorCode", "incidentId", "severity"), ("rank", "errors", "change")
    filled = out.withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in numbers})
    return filled.withColumns({"rateChange": F.coalesce("rateChange", F.lit(0.0)), "day": F.col("day").cast("string")}).toDF(
        "day", "total", "failed", "error_rate", "rate_change", "section", "section_rank", "error_code", "incident_id", "severity", "errors", "change"
    )


@query(
    "i5_tumbling_metrics",
    """SELECT date_trunc('hour', event_ts) AS window_start, service, count(*) AS total, count(error_code) AS errors,
      count(error_code) * 100.0::DOUBLE / count(*) AS error_rate, coalesce(max(duration_ms), -1) AS max_ms, coalesce(quantile_disc(duration_ms, 0.95), -1) AS p95_ms
    FROM wide_events GROUP BY 1, 2""",
    W,
)
def _(spark, sf):
    out = incidents.tumbling_metrics(fx.events(spark, sf), "1 hour")
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("maxMs", "p95Ms")}).toDF(
        "window_start", "service", "total", "errors", "error_rate", "max_ms", "p95_ms"
    )
