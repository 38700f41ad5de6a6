"""Registered queries: question understanding over the query log."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lumenlog.catalog import fixtures as fx
from lumenlog.catalog.registry import query
from lumenlog.functions import questions as qn

Q = ("query_log",)


def _rx(words):
    return "'" + "|".join(re.escape(w) for w in words).replace("'", "''") + "'"


def _case(text, table, default="NULL"):
    whens = " ".join(f"WHEN regexp_matches({text}, {_rx(words)}) THEN '{name}'" for name, words in table.items())
    return f"CASE {whens} ELSE {default} END"


LOW = "lower(text)"
ERROR_RX = "regexp_extract(upper(text), '(" + "|".join(qn.ERROR_CODES) + ")', 1)"
CODE = f"nullif({ERROR_RX}, '')"
HAS_ERROR = f"(regexp_matches({LOW}, {_rx(qn.ERROR_WORDS)}) OR {CODE} IS NOT NULL)"
SERVICE = _case(LOW, {qn.SERVICES[w]: [w] for w in qn.NAMED_SERVICES})
OUTCOME = f"CASE WHEN {HAS_ERROR} THEN 'FAILED' ELSE {_case(LOW, qn.OUTCOMES, chr(39) + 'ANY' + chr(39))} END"
ROUTE = f"coalesce({_case(LOW, qn.ROUTES)}, nullif(regexp_extract(text, '(/[a-zA-Z0-9\\-_/]+)', 1), ''))"
ROLE = _case(LOW, qn.ROLES)
LATENCY = _case(LOW, qn.LATENCIES)
STRUCTURED = f"""trim(text) || chr(10) || chr(10) || concat_ws(', ', CASE WHEN {OUTCOME} <> 'ANY' THEN 'Outcome: ' || {OUTCOME} END,
  'Service: ' || {SERVICE}, 'Route: ' || {ROUTE}, CASE WHEN {HAS_ERROR} THEN 'Error: ' || coalesce({CODE}, 'ANY') END,
  CASE WHEN {HAS_ERROR} THEN 'ErrorMessage: ANY' END, 'UserRole: ' || {ROLE}, 'LatencyBucket: ' || {LATENCY})"""


def meta_args():
    """Metadata columns added by ``with_metadata``."""
    return {n: F.col(c) for n, c in (("service", "service"), ("route", "route"), ("error_code", "errorCode"), ("has_error", "hasError"))}


def asked(spark, sf):
    """The query log with the metadata read from each text."""
    return qn.with_metadata(fx.questions(spark, sf))


INTENT = _case(LOW, dict(qn.STRATEGIES), "'SEMANTIC'")


@query("g1_intent", f"SELECT query_id, {INTENT} AS intent FROM query_log", Q)
def _(spark, sf):
    return fx.questions(spark, sf).select("query_id", qn.intent(F.col("text")).alias("intent"))


@query("g1_intent_conversations", f"SELECT conv_id, turn, {INTENT} AS intent FROM conversations")
def _(spark, sf):
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", qn.intent(F.col("text")).alias("intent"))


@query("g2_language", "SELECT query_id, CASE WHEN regexp_matches(text, '[ㄱ-ㅎㅏ-ㅣ가-힣]') THEN 'Korean' ELSE 'English' END AS lang FROM query_log", Q)
def _(spark, sf):
    return fx.questions(spark, sf).select("query_id", qn.language(F.col("text")).alias("lang"))


@query("g3_outcome_hint", f"SELECT query_id, {OUTCOME} AS outcome FROM query_log", Q)
def _(spark, sf):
    m = meta_args()
    hint = qn.outcome_hint(F.col("text"), m["has_error"], m["error_code"])
    return asked(spark, sf).select("query_id", hint.alias("outcome"))


@query("g4_role_hint", f"SELECT query_id, {ROLE} AS user_role FROM query_log", Q)
def _(spark, sf):
    return fx.questions(spark, sf).select("query_id", qn.role_hint(F.col("text")).alias("user_role"))


@query(
    "g5_latency_hint",
    f"SELECT query_id, {LATENCY} AS latency, CASE {LATENCY} WHEN 'P_OVER_1000MS' THEN 'P_OVER_1000MS' WHEN 'P_UNDER_100MS' THEN 'P_SUB_50MS,P_50_200MS' END AS event_buckets FROM query_log",
    Q,
)
def _(spark, sf):
    hint = qn.latency_hint(F.col("text"))
    return fx.questions(spark, sf).select(
        "query_id", hint.alias("latency"), F.array_join(qn.event_buckets(hint), ",").alias("event_buckets")
    )


@query(
    "g6_service_normalization",
    """SELECT event_id, CASE lower(trim(s)) WHEN 'payment' THEN 'payments' WHEN 'order' THEN 'orders' WHEN 'user' THEN 'users' WHEN 'product' THEN 'products' ELSE s END AS service
    FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(substr(service, 1, length(service) - 1)) ELSE upper(service) END AS s FROM wide_events)""",
    ("wide_events",),
)
def _(spark, sf):
    s = F.upper(F.when(F.col("event_id") % 2 == 0, F.expr("substr(service, 1, length(service) - 1)")).otherwise(F.col("service")))
    return fx.view(spark, sf, "wide_events").select("event_id", qn.normalize_service(s).alias("service"))


@query("g7_route_hint", f"SELECT query_id, {ROUTE} AS route FROM query_log", Q)
def _(spark, sf):
    return fx.questions(spark, sf).select("query_id", qn.route_hint(F.col("text"), F.lit(None).cast("string")).alias("route"))


@query("g8_structured_text", f"SELECT query_id, {STRUCTURED} AS structured FROM query_log", Q)
def _(spark, sf):
    return asked(spark, sf).select("query_id", qn.structured_text(F.col("text"), **meta_args()).alias("structured"))


@query(
    "g9_query_variations",
    f"""WITH v AS (SELECT query_id, list_filter([{STRUCTURED}, 'Service: ' || {SERVICE}, text], lambda x: x IS NOT NULL) AS vs FROM query_log)
    SELECT query_id, i - 1 AS variation_no, vs[i] AS variation FROM v, generate_series(1, 3) g(i) WHERE i <= len(vs)""",
    Q,
)
def _(spark, sf):
    # An error code without hasError differs from the error-focused text never:
    # both count as failing, so the duplicate is dropped.
    vs = qn.variations(F.col("text"), **meta_args())
    return asked(spark, sf).select("query_id", F.posexplode(vs).alias("variation_no", "variation")).withColumn(
        "variation_no", F.col("variation_no").cast("bigint")
    )


REF = " OR ".join(f"regexp_matches({LOW}, '{p}')" for p in qn.REFERENCES)


@query(
    "g10_reference_detection",
    f"""SELECT query_id, coalesce(h.turns, 0) > 0 AND ({REF}) AS refers FROM query_log q
    LEFT JOIN (SELECT session_id, count(*) AS turns FROM chat_history GROUP BY 1) h ON h.session_id = q.session_id""",
    ("query_log", "chat_history"),
)
def _(spark, sf):
    turns = fx.history(spark, sf).groupBy(F.col("sessionId").alias("session_id")).agg(F.count("*").alias("turns"))
    q = fx.questions(spark, sf).join(turns, "session_id", "left")
    return q.select("query_id", qn.has_references(F.col("text"), F.coalesce("turns", F.lit(0))).alias("refers"))


@query(
    "g11_standalone",
    """WITH r AS (SELECT query_id, text, CASE query_id % 4 WHEN 0 THEN upper(text) WHEN 1 THEN text || ' in the payments service' WHEN 2 THEN substr(text, 1, 4) ELSE 'something entirely different about the gateway timeouts of yesterday and the day before' END AS ref FROM query_log),
    n AS (SELECT query_id, regexp_replace(trim(lower(text)), '[?.!]', '', 'g') AS o, regexp_replace(trim(lower(ref)), '[?.!]', '', 'g') AS r FROM r)
    SELECT query_id, o = r OR contains(r, o) OR length(o) / length(r)::DOUBLE > 0.8 AS standalone FROM n""",
    Q,
)
def _(spark, sf):
    t, k = F.col("text"), F.col("query_id") % 4
    ref = (
        F.when(k == 0, F.upper(t))
        .when(k == 1, F.concat(t, F.lit(" in the payments service")))
        .when(k == 2, F.substring(t, 1, 4))
        .otherwise("something entirely different about the gateway timeouts of yesterday and the day before")
    )
    return fx.questions(spark, sf).select("query_id", qn.is_standalone(t, ref).alias("standalone"))


UNIT = r"regexp_extract(lower(text), 'last\s+(\d+\s+)?(minute|hour|day|week)s?', 2)"
NUM = r"regexp_extract(lower(text), 'last\s+(\d+\s+)?(minute|hour|day|week)s?', 1)"
SECS = f"CASE {UNIT} WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 WHEN 'week' THEN 604800 END * CASE WHEN {NUM} = '' THEN 1 ELSE trim({NUM})::BIGINT END"
START = f"""CASE WHEN {UNIT} <> '' THEN asked_at - to_seconds({SECS}) WHEN regexp_matches(lower(text), 'yesterday|어제') THEN date_trunc('day', asked_at) - INTERVAL 1 DAY
  WHEN regexp_matches(lower(text), 'today|오늘') THEN date_trunc('day', asked_at)::TIMESTAMP END"""
END = f"""CASE WHEN {UNIT} <> '' THEN asked_at WHEN regexp_matches(lower(text), 'yesterday|어제') THEN date_trunc('day', asked_at) - INTERVAL 1 SECOND
  WHEN regexp_matches(lower(text), 'today|오늘') THEN asked_at END"""


@query("g12_time_range", f"SELECT query_id, {START} AS start_time, {END} AS end_time FROM query_log", Q)
def _(spark, sf):
    r = qn.time_range(F.col("text"), F.col("asked_at"))
    return fx.questions(spark, sf).select("query_id", r.alias("r")).select(
        "query_id", F.col("r.startTime").alias("start_time"), F.col("r.endTime").alias("end_time")
    )


@query("g13_entities", f"SELECT query_id, {HAS_ERROR} AS has_error, {CODE} AS error_code, {SERVICE} AS service FROM query_log", Q)
def _(spark, sf):
    m = meta_args()
    return asked(spark, sf).select(
        "query_id", m["has_error"].alias("has_error"), m["error_code"].alias("error_code"), m["service"].alias("service")
    )


TEMPLATE = _case(LOW, qn.TEMPLATE_RULES, "'TOP_ERROR_CODES'")
TOPN = r"coalesce(nullif(TRY_CAST(regexp_extract(lower(text), 'top\s+(\d+)', 1) AS BIGINT), 0), 5)"


# Numbers of seven and of twenty-one digits; the latter is none.
LONG_TOPN = "SELECT query_id, text || CASE query_id % 3 WHEN 0 THEN ' top 1000000' WHEN 1 THEN ' top 999999999999999999999' ELSE '' END AS text FROM query_log"


@query("g14_long_numbers", f"SELECT query_id, {TOPN} AS top_n FROM ({LONG_TOPN})", Q)
def _(spark, sf):
    n = F.col("query_id") % 3
    text = F.concat("text", F.when(n == 0, " top 1000000").when(n == 1, " top 999999999999999999999").otherwise(""))
    return fx.questions(spark, sf).select("query_id", qn.top_n(text).alias("top_n"))


@query("g14_metric_routing", f"SELECT query_id, {TEMPLATE} AS template_id, {TOPN} AS top_n FROM query_log", Q)
def _(spark, sf):
    t = F.col("text")
    return fx.questions(spark, sf).select(
        "query_id", qn.metric_template(t).alias("template_id"), qn.top_n(t).alias("top_n")
    )


# Extraction "fails" for every seventh question; initial metadata names the session's service.
@query(
    "g15_metadata_merge",
    f"""WITH x AS (SELECT *, query_id % 7 = 0 AS failed, {SERVICE} AS svc, {CODE} AS code, {HAS_ERROR} AS err, {TEMPLATE} AS tpl, {TOPN} AS n, {START} AS st FROM query_log)
    SELECT query_id, CASE WHEN failed THEN 'TOP_ERROR_CODES' ELSE tpl END AS template_id, CASE WHEN failed THEN 5 ELSE n END AS top_n,
      CASE WHEN failed THEN 'orders' ELSE coalesce(svc, 'orders') END AS service, CASE WHEN failed THEN asked_at ELSE coalesce(st, asked_at) END AS start_time,
      CASE WHEN failed THEN NULL ELSE code END AS error_code, CASE WHEN failed THEN TRUE ELSE err END AS has_error FROM x""",
    Q,
)
def _(spark, sf):
    t, m = F.col("text"), meta_args()
    rng = qn.time_range(t, F.col("asked_at"))
    extracted = F.struct(
        qn.metric_template(t).alias("templateId"), qn.top_n(t).alias("topN"), rng["startTime"].alias("startTime"),
        rng["endTime"].alias("endTime"), m["service"].alias("service"), m["route"].alias("route"),
        m["error_code"].alias("errorCode"), m["has_error"].alias("hasError"),
    )
    none = F.lit(None)
    initial = F.struct(
        F.col("asked_at").alias("startTime"), none.cast("timestamp").alias("endTime"), F.lit("orders").alias("service"),
        none.cast("string").alias("route"), none.cast("string").alias("errorCode"), none.cast("boolean").alias("hasError"),
    )
    merged = qn.merge_metadata(extracted, initial, F.col("query_id") % 7 == 0)
    return asked(spark, sf).withColumn("m", merged).select(
        "query_id", F.col("m.templateId").alias("template_id"), F.col("m.topN").alias("top_n"), "m.service",
        F.col("m.startTime").alias("start_time"), F.col("m.errorCode").alias("error_code"), F.col("m.hasError").alias("has_error"),
    )
