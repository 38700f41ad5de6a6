"""Registered queries: building and enriching wide events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.catalog import fixtures as fx
from lumenlog.catalog import sqltext as q
from lumenlog.catalog.registry import query
from lumenlog.functions import events as ev
from lumenlog.functions import normalize as nz
from lumenlog.operators import assembly

W = ("wide_events",)


def _id():
    return F.col("requestId").alias("request_id")


# --- assembly -------------------------------------------------------------------
@query(
    "b1_assemble",
    """SELECT request_id, event_ts, CASE WHEN error_code LIKE 'GATEWAY%' THEN 'paymentGateway' ELSE service END AS service,
      route, user_id, error_code, coalesce(duration_ms, -1) AS duration_ms FROM wide_events""",
    W,
)
def _(spark, sf):
    frags = fx.view(spark, sf, "fragments").withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    out = assembly.assemble(frags, ["service", "route", "user_id", "error_code", "duration_ms"])
    return out.withColumn("duration_ms", F.coalesce("duration_ms", F.lit(-1)))


# Each fragment carries one bag; every service writes "owner", the last one wins.
@query(
    "b1_merge_metadata",
    """WITH e AS (SELECT request_id, seq, 'owner' AS k, coalesce(service, 'none') AS v FROM fragments
      UNION ALL SELECT request_id, seq, 'seq' || (seq % 2)::VARCHAR, seq::VARCHAR FROM fragments),
    l AS (SELECT request_id, k, arg_max(v, seq) AS v FROM e GROUP BY 1, 2)
    SELECT request_id, string_agg(k || '=' || v, ',' ORDER BY k) AS metadata FROM l GROUP BY 1""",
    ("fragments",),
)
def _(spark, sf):
    frags = fx.view(spark, sf, "fragments").select(
        "request_id",
        "seq",
        F.create_map(
            F.lit("owner"),
            F.coalesce("service", F.lit("none")),
            F.concat(F.lit("seq"), (F.col("seq") % 2).cast("string")),
            F.col("seq").cast("string"),
        ).alias("metadata"),
    )
    merged = assembly.merge_metadata(frags)
    text = F.array_join(
        F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )
    return merged.select("request_id", text.alias("metadata"))


@query(
    "b2_project_event",
    f"""SELECT request_id, event_ts, service, route, user_id, {q.ROLE} AS user_role, error_code, error_message, coalesce(duration_ms, -1) AS duration_ms,
      user_id IS NULL AS no_user, error_code IS NULL AS no_error, duration_ms IS NULL AS no_performance FROM wide_events""",
    W,
)
def _(spark, sf):
    e = assembly.project_event(fx.stored_events(spark, sf).withColumn("_metadata", F.lit("{}")))
    return e.select(
        _id(),
        F.col("timestamp").alias("event_ts"),
        "service",
        "route",
        F.col("user.id").alias("user_id"),
        F.col("user.role").alias("user_role"),
        F.col("error.code").alias("error_code"),
        F.col("error.message").alias("error_message"),
        F.coalesce("performance.durationMs", F.lit(-1)).alias("duration_ms"),
        F.col("user").isNull().alias("no_user"),
        F.col("error").isNull().alias("no_error"),
        F.col("performance").isNull().alias("no_performance"),
    )


@query(
    "b3_document_to_event",
    "SELECT request_id, strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, date_trunc('millisecond', event_ts) AS event_ts FROM wide_events",
    W,
)
def _(spark, sf):
    iso = assembly.iso_timestamp(F.col("timestamp"))
    docs = fx.events(spark, sf).select(_id(), iso.alias("iso"))
    return docs.withColumn("event_ts", assembly.parse_timestamp(F.col("iso")))


@query("b4_role_coercion", f"SELECT request_id, {q.ROLE} AS user_role FROM wide_events", W)
def _(spark, sf):
    w = fx.view(spark, sf, "wide_events")
    return w.select("request_id", ev.coerce_role(F.col("user_role_raw")).alias("user_role"))


@query("b5_latency_bucket", f"SELECT request_id, {q.BUCKET} AS latency_bucket FROM wide_events", W)
def _(spark, sf):
    return fx.events(spark, sf).select(_id(), ev.latency_bucket(F.col("performance.durationMs")).alias("latency_bucket"))


@query("b6_outcome", f"SELECT {q.OUTCOME} AS outcome, count(*) AS n FROM wide_events GROUP BY 1", W)
def _(spark, sf):
    out = ev.outcome(F.col("error"), F.col("performance.durationMs"))
    return fx.events(spark, sf).groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


@query("b7_canonical_summary", f"SELECT request_id, {q.SUMMARY} AS summary FROM wide_events", W)
def _(spark, sf):
    return fx.events(spark, sf).select(_id(), ev.canonical_summary(**ev.event_args()).alias("summary"))


@query("b8_dual_layer_summary", f"SELECT request_id, {q.DUAL} AS summary FROM wide_events", W)
def _(spark, sf):
    return fx.events(spark, sf).select(_id(), ev.dual_layer_summary(**ev.event_args()).alias("summary"))


@query(
    "b8_display_names",
    f"""SELECT request_id, {q.SERVICE_NAME} AS service_name, {q.ROUTE_NAME} AS route_name, {q.ROLE_NAME} AS role_name, {q.ERROR_NAME} AS error_name
    FROM wide_events""",
    W,
)
def _(spark, sf):
    return fx.events(spark, sf).select(
        _id(),
        ev.service_display(F.col("service")).alias("service_name"),
        ev.route_display(F.col("route")).alias("route_name"),
        ev.role_display(F.coalesce("user.role", F.lit("ANONYMOUS"))).alias("role_name"),
        ev.error_description(F.col("error.code")).alias("error_name"),
    )


# --- normalisation ---------------------------------------------------------------
STRIPPED = "string_split(path, '?')[1]"


@query(
    "b9_canonical_route",
    f"""SELECT page_id, upper(method) || ' ' || CASE WHEN starts_with({STRIPPED}, '/') THEN '' ELSE '/' END || {STRIPPED} AS route,
      upper(method) || ' ' || CASE WHEN starts_with(x, '/fr') THEN CASE WHEN starts_with(x, '/') THEN x ELSE '/' || x END
        ELSE '/fr' || CASE WHEN starts_with(x, '/') THEN x ELSE '/' || x END END AS based_route
    FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN '/pages/:id' ELSE {STRIPPED} END AS x FROM raw_requests)""",
    ("raw_requests",),
)
def _(spark, sf):
    r = fx.view(spark, sf, "raw_requests")
    template = F.when(F.col("page_id") % 3 == 0, "/pages/:id")
    return r.select(
        "page_id",
        nz.canonical_route(F.col("method"), F.col("path")).alias("route"),
        nz.canonical_route(F.col("method"), F.col("path"), template, "/fr/").alias("based_route"),
    )


def _jx(field):
    raw = f"json_extract_string(raw_response, '$.{field}')"
    return f"""nullif(CASE WHEN json_type(raw_response, '$.{field}') = 'ARRAY' THEN array_to_string(json_extract_string(raw_response, '$.{field}[*]'), ',') ELSE {raw} END, '')"""


KIND = "CASE WHEN raw_response IS NULL THEN 'none' ELSE json_type(raw_response) END"
STATUS_NAME = "CASE http_status WHEN 400 THEN 'BAD_REQUEST' WHEN 429 THEN 'RATE_LIMITED' WHEN 500 THEN 'INTERNAL_ERROR' ELSE 'HTTP_' || http_status::VARCHAR END"
ITEMS = "json_extract_string(raw_response, '$[*]')"
MESSAGE = f"""CASE {KIND} WHEN 'none' THEN 'request failed'
  WHEN 'ARRAY' THEN array_to_string({ITEMS}[1:3], '; ') || CASE WHEN len({ITEMS}) > 3 THEN '... (+' || (len({ITEMS}) - 3)::VARCHAR || ' more)' ELSE '' END
  WHEN 'OBJECT' THEN coalesce({_jx("errorMessage")}, {_jx("message")}, {_jx("error")}, 'request failed')
  ELSE json_extract_string(raw_response, '$') END"""


@query(
    "b10_error_code",
    f"""SELECT request_id, CASE {KIND} WHEN 'OBJECT' THEN coalesce({_jx("errorCode")}, {_jx("code")}, {_jx("error")}, {_jx("statusCode")}, http_status::VARCHAR)
      WHEN 'ARRAY' THEN http_status::VARCHAR ELSE {STATUS_NAME} END AS code FROM error_responses""",
    ("error_responses",),
)
def _(spark, sf):
    r = fx.view(spark, sf, "error_responses")
    return r.select("request_id", nz.error_code(F.col("raw_response"), F.col("http_status")).alias("code"))


@query(
    "b10a_error_message",
    f"""SELECT request_id, CASE WHEN length(m) > 200 THEN substr(m, 1, 197) || '...' ELSE m END AS message
    FROM (SELECT request_id, {MESSAGE} AS m FROM error_responses)""",
    ("error_responses",),
)
def _(spark, sf):
    r = fx.view(spark, sf, "error_responses")
    return r.select("request_id", nz.error_message(F.col("raw_response"), F.lit("request failed")).alias("message"))


@query(
    "b10b_validation_errors",
    f"""SELECT request_id, unnest(CASE WHEN {KIND} = 'ARRAY' THEN {ITEMS} ELSE json_extract_string(raw_response, '$.message[*]') END) AS problem
    FROM error_responses WHERE {KIND} = 'ARRAY' OR ({KIND} = 'OBJECT' AND json_type(raw_response, '$.message') = 'ARRAY')""",
    ("error_responses",),
)
def _(spark, sf):
    r = fx.view(spark, sf, "error_responses")
    return r.select("request_id", F.explode(nz.validation_errors(F.col("raw_response"))).alias("problem"))


@query(
    "b10_plain_error",
    """SELECT request_id, coalesce(CASE WHEN event_id % 3 = 0 THEN error_code END, CASE WHEN event_id % 3 = 1 THEN '503' END, 'TypeError') AS code,
      coalesce(error_message, 'Unknown error') AS message FROM wide_events""",
    W,
)
def _(spark, sf):
    kind = F.col("eventId") % 3
    err = nz.plain_error(
        F.when(kind == 0, F.col("error.code")), F.when(kind == 1, F.lit(503)), F.lit("TypeError"), F.col("error.message")
    )
    return fx.events(spark, sf).withColumn("e", err).select(_id(), F.col("e.code"), F.col("e.message"))


@query(
    "b10_unknown_error",
    """SELECT request_id, 'UNKNOWN' AS code, CASE WHEN length(m) > 200 THEN substr(m, 1, 197) || '...' ELSE m END AS message FROM (
      SELECT request_id, CASE substr(raw_response, 1, 1) WHEN '"' THEN raw_response::JSON ->> '$' WHEN '{' THEN substr(raw_response, 1, 200)
        WHEN '[' THEN substr(raw_response, 1, 200) ELSE 'Unknown error' END AS m FROM error_responses)""",
    ("error_responses",),
)
def _(spark, sf):
    e = nz.unknown_error(F.col("raw_response"))
    return fx.view(spark, sf, "error_responses").select("request_id", e["code"].alias("code"), e["message"].alias("message"))


# --- requests ----------------------------------------------------------------------
REQUESTS = """req AS (SELECT request_id, event_id,
  concat('{"userId":', CASE WHEN user_id IS NULL THEN 'null' ELSE concat('"', user_id, '"') END, ',"role":"', coalesce(user_role_raw, ''), '","password":"pw-', CAST(event_id AS VARCHAR(20)), '","amount":', CAST(coalesce(duration_ms, 0) AS VARCHAR(20)), ',"card":{"pin":"1","note":"', repeat('n', CAST(event_id % 300 AS INT)), '"}}') AS body,
  concat('{"id":"', CAST(event_id % 1000 AS VARCHAR(20)), '"}') AS params,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE '{"page":"3","token":"t"}' END AS query,
  concat('{"x-request-id":"', CASE WHEN event_id % 4 = 0 THEN '' ELSE request_id END, '","authorization":"Bearer x"}') AS headers,
  concat('{"success":true,"data":{"orderId":"ord-', CAST(event_id AS VARCHAR(20)), '"},"transactionId":"txn-', CAST(event_id AS VARCHAR(20)), '"}') AS response,
  error_code, service, duration_ms, event_ts FROM wide_events)"""


def _http(spark, sf):
    """HTTP requests derived from every event; the SQL text serves both engines."""
    fx.view(spark, sf, "wide_events").createOrReplaceTempView("lumenlog_wide_events")
    sql = REQUESTS.replace("FROM wide_events", "FROM lumenlog_wide_events")
    return spark.sql(f"WITH {sql} SELECT * FROM req").withColumn("event_ts", F.col("event_ts").cast("timestamp"))


@query(
    "b11_request_user",
    f"""WITH {REQUESTS}, u AS (SELECT request_id, nullif(json_extract_string(body, '$.userId'), '') AS user_id, json_extract_string(body, '$.role') AS r FROM req)
    SELECT request_id, user_id, CASE WHEN user_id IS NULL THEN NULL WHEN r IN ('admin','user','premium','guest') THEN r ELSE 'guest' END AS user_role FROM u""",
    W,
)
def _(spark, sf):
    user = nz.request_user("body.userId", "body.role")
    return _http(spark, sf).select("request_id", user.alias("u")).select(
        "request_id", F.col("u.id").alias("user_id"), F.col("u.role").alias("user_role")
    )


META = ["body.amount", "body.card.note", "params.id", "query.page", "body.password", "query.token", "headers.authorization", "cookies.x"]


@query(
    "b12_b13_request_meta",
    f"""WITH {REQUESTS}, m AS (SELECT request_id, json_extract_string(body, '$.amount') AS amount, json_extract_string(body, '$.card.note') AS note,
      json_extract_string(params, '$.id') AS id, json_extract_string(query, '$.page') AS page, query IS NOT NULL AS has_query FROM req)
    SELECT request_id, amount, CASE WHEN length(note) > 200 THEN substr(note, 1, 200) || '...' ELSE note END AS note, id, page,
      '[REDACTED]' AS password, CASE WHEN has_query THEN '[REDACTED]' END AS token, '[REDACTED]' AS auth_header,
      6::BIGINT + CASE WHEN has_query THEN 1 ELSE -1 END AS entries FROM m""",
    W,
)
def _(spark, sf):
    m = _http(spark, sf).select("request_id", nz.request_meta(META).alias("m"))
    keys = {"amount": "amount", "note": "note", "id": "id", "page": "page", "password": "password", "token": "token", "authorization": "auth_header"}
    return m.select(
        "request_id",
        *[F.try_element_at("m", F.lit(k)).alias(v) for k, v in keys.items()],
        F.size("m").cast("bigint").alias("entries"),
    )


@query(
    "b13_redact_map",
    """SELECT request_id, '[REDACTED]' AS password, '[REDACTED]' AS cvv, service FROM wide_events""",
    W,
)
def _(spark, sf):
    bag = F.create_map(F.lit("body.password"), _id(), F.lit("cvv"), F.lit("123"), F.lit("service"), F.col("service"))
    m = fx.events(spark, sf).select(_id(), nz.redact_map(bag).alias("m"))
    return m.select(
        "request_id", F.col("m")["body.password"].alias("password"), F.col("m")["cvv"].alias("cvv"),
        F.col("m")["service"].alias("service"),
    )


@query(
    "b14_response_meta",
    f"""WITH {REQUESTS} SELECT request_id, CASE WHEN error_code IS NULL THEN json_extract_string(response, '$.transactionId') END AS transaction_id,
      CASE WHEN error_code IS NULL THEN json_extract_string(response, '$.data.orderId') END AS order_id FROM req""",
    W,
)
def _(spark, sf):
    meta = nz.response_meta(F.col("response"), ["transactionId", "data.orderId"], F.col("error_code").isNull())
    m = _http(spark, sf).select("request_id", meta.alias("m"))
    return m.select(
        "request_id",
        F.col("m")["response_transactionId"].alias("transaction_id"),
        F.col("m")["response_data_orderId"].alias("order_id"),
    )


@query(
    "b15_sanitize",
    """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS body,
      array_to_string(list_transform(string_split(text, ' ')[1:10], lambda w: CASE WHEN length(w) > 200 THEN substr(w, 1, 200) || '...' ELSE w END), '|') AS words,
      '[Array(' || len(string_split(text, ' '))::VARCHAR || ')]' AS deep, '[Object]' AS object FROM documents""",
)
def _(spark, sf):
    words = F.split("text", " ")
    raw = fx.table(spark, sf, "documents").select(
        "doc_id",
        F.struct(
            F.col("text").alias("body"),
            words.alias("words"),
            F.struct(words.alias("deep"), F.struct("lang").alias("object")).alias("inner"),
        ).alias("v"),
    )
    clean = raw.select("doc_id", nz.sanitize(F.col("v"), raw.schema["v"].dataType).alias("v"))
    return clean.select(
        "doc_id", "v.body", F.array_join("v.words", "|").alias("words"), "v.inner.deep", "v.inner.object"
    )


# --- policies and attribution --------------------------------------------------------
@query("b16_route_exclusion", "SELECT request_id, route FROM wide_events WHERE route NOT IN ('GET /products', 'POST /users/login')", W)
def _(spark, sf):
    excluded = spark.createDataFrame([("GET /products",), ("POST /users/login",)], "route string")
    return assembly.exclude_routes(fx.events(spark, sf), excluded).select(_id(), "route")


@query(
    "b17_sampling_hint",
    "SELECT request_id, CASE route WHEN 'POST /payments' THEN 'important' WHEN 'GET /products' THEN 'low' END AS hint FROM wide_events",
    W,
)
def _(spark, sf):
    hinted = assembly.attach_sampling_hint(fx.events(spark, sf), {"POST /payments": "important", "GET /products": "low"})
    return hinted.select(_id(), F.col("_samplingHint").alias("hint"))


# Every third event is finalised a second time, later and from another service.
# Events without a request id are no copies of each other.
@query(
    "b18_finalize_once",
    "SELECT request_id, event_ts, service FROM wide_events UNION ALL SELECT NULL, event_ts, service FROM wide_events WHERE event_id < 20 UNION ALL SELECT NULL, event_ts, service FROM wide_events WHERE event_id < 5",
    W,
)
def _(spark, sf):
    e = fx.events(spark, sf).select("requestId", "timestamp", "service")
    again = e.filter(F.pmod(F.xxhash64("requestId"), F.lit(3)) == 0).select(
        "requestId", (F.col("timestamp") + F.expr("INTERVAL 5 SECONDS")).alias("timestamp"), F.lit("copy").alias("service")
    )
    early = fx.events(spark, sf).withColumn("requestId", F.lit(None).cast("string"))
    lost = [early.filter(F.col("eventId") < n).select("requestId", "timestamp", "service") for n in (20, 5)]
    once = assembly.finalize_once(again.unionByName(e).unionByName(lost[0]).unionByName(lost[1]), ["timestamp", "service"])
    return once.toDF("request_id", "event_ts", "service")


@query("b19_duration", "SELECT request_id, coalesce(duration_ms, -1) AS derived_ms FROM wide_events", W)
def _(spark, sf):
    end = F.timestamp_millis(F.unix_millis("timestamp") + F.col("performance.durationMs"))
    e = fx.events(spark, sf).withColumn("endedAt", end)
    took = assembly.duration_ms(F.col("timestamp"), F.col("endedAt"))
    return e.select(_id(), F.coalesce(took, F.lit(-1)).alias("derived_ms"))


@query(
    "b20_service_attribution",
    """SELECT w.request_id, coalesce(json_extract_string(CASE WHEN raw_response LIKE '{%' THEN raw_response END, '$.errorService'), service) AS service
    FROM wide_events w LEFT JOIN error_responses r ON r.request_id = w.request_id""",
    ("error_responses",),
)
def _(spark, sf):
    e = fx.events(spark, sf).select("requestId", "service")
    raw = fx.view(spark, sf, "error_responses").select(F.col("request_id").alias("requestId"), "raw_response")
    both = e.join(raw, "requestId", "left")
    return both.select(_id(), assembly.attributed_service(F.col("service"), F.col("raw_response")).alias("service"))


@query(
    "b21_status_dimension",
    """WITH s(code, severity, step) AS (VALUES ('SUCCESS','NORMAL','payments'), ('INSUFFICIENT_BALANCE','ERROR','payments'), ('INSUFFICIENT_FUNDS','ERROR','paymentGateway'),
      ('GATEWAY_REJECTED','ERROR','paymentGateway'), ('GATEWAY_TIMEOUT','ERROR','paymentGateway'), ('CARD_EXPIRED','ERROR','paymentGateway'), ('SLOW_ORDER_SUCCESS','WARN','orders')),
    c AS (SELECT request_id, coalesce(CASE WHEN error_code = 'FRAUD_DETECTION' THEN 'NEW_CODE' ELSE error_code END, CASE WHEN duration_ms > 2000 THEN 'SLOW_ORDER_SUCCESS' ELSE 'SUCCESS' END) AS code FROM wide_events)
    SELECT request_id, coalesce(severity, 'ERROR') AS severity, step, coalesce(severity, 'ERROR') = 'ERROR' AS is_error,
      coalesce(severity, 'ERROR') = 'WARN' AS is_slow, coalesce(severity, 'ERROR') = 'NORMAL' AS is_success
    FROM c LEFT JOIN s ON s.code = c.code""",
    W,
)
def _(spark, sf):
    e = fx.events(spark, sf)
    return assembly.with_status(e, _status_code(), assembly.status_table(spark)).select(
        _id(), "severity", F.col("statusService").alias("step"), F.col("isError").alias("is_error"),
        F.col("isSlow").alias("is_slow"), F.col("isSuccess").alias("is_success"),
    )


def _status_code():
    code = F.when(F.col("error.code") == "FRAUD_DETECTION", "NEW_CODE").otherwise(F.col("error.code"))
    slow = F.when(F.col("performance.durationMs") > 2000, "SLOW_ORDER_SUCCESS").otherwise("SUCCESS")
    return F.coalesce(code, slow)


@query("b21_unknown_statuses", "SELECT 'NEW_CODE' AS code, count(*) AS n FROM wide_events WHERE error_code = 'FRAUD_DETECTION' HAVING count(*) > 0", W)
def _(spark, sf):
    return assembly.unknown_statuses(fx.events(spark, sf), _status_code(), assembly.status_table(spark))


@query(
    "b22_failure_http_status",
    "SELECT request_id, CASE WHEN error_code = 'GATEWAY_TIMEOUT' THEN 500 ELSE 400 END AS http_status FROM wide_events WHERE error_code IS NOT NULL",
    W,
)
def _(spark, sf):
    failed = fx.events(spark, sf).filter("error is not null")
    return failed.select(_id(), assembly.failure_http_status(F.col("error.code")).alias("http_status"))


@query(
    "b23_identity",
    f"""WITH {REQUESTS} SELECT event_id, coalesce(nullif(json_extract_string(headers, '$."x-request-id"'), ''),
      sha256(event_id::VARCHAR || chr(1) || service)) AS request_id,
      CASE WHEN event_id % 2 = 0 THEN service ELSE 'backend' END AS service FROM req""",
    W,
)
def _(spark, sf):
    r = _http(spark, sf)
    header = nz.request_value("headers.x-request-id")
    return r.select(
        "event_id",
        assembly.request_id(header, F.col("event_id"), F.col("service")).alias("request_id"),
        assembly.service_name(F.when(F.col("event_id") % 2 == 0, F.col("service")), F.lit("")).alias("service"),
    )
