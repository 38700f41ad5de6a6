"""Registered queries: chat sessions, grounding, result cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.catalog import fixtures as fx
from lumenlog.catalog.question_queries import CODE, HAS_ERROR, SERVICE, START, asked, meta_args
from lumenlog.catalog.registry import query
from lumenlog.catalog.retrieval_queries import SCORES, _ranked, label_queries
from lumenlog.catalog.sqltext import ROLE
from lumenlog.functions import questions as qn
from lumenlog.operators import grounding, metrics, result_cache, retrieval, sessions

H = ("chat_history",)
NOW = "2024-01-02 12:00:00"
# The turn limit in these queries is 2: fixture sessions are short.
LIMIT = 2


def _sid():
    return F.col("sessionId").alias("session_id")


def _now():
    return F.lit(NOW).cast("timestamp")


@query(
    "h1_history_append",
    f"SELECT session_id, turn, TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' AS updated_at FROM chat_history",
    H,
)
def _(spark, sf):
    out = sessions.append_history(fx.history(spark, sf), _now())
    return out.select(_sid(), "turn", F.col("createdAt").alias("created_at"), F.col("updatedAt").alias("updated_at"))


@query("h2_session_history", "SELECT session_id, turn, created_at, question, answer, intent, confidence, source_id FROM chat_history", H)
def _(spark, sf):
    return sessions.session_history(fx.history(spark, sf)).select(
        _sid(), "turn", F.col("createdAt").alias("created_at"), "question", "answer", "intent", "confidence",
        F.col("sources")[0].alias("source_id"),
    )


@query(
    "h3_turn_pairing",
    "SELECT coalesce(nullif(conv_id, 3), -1) AS conv_id, turn, question, answer FROM chat_turns WHERE role = 'user' AND next_role = 'assistant'",
    ("chat_turns",),
)
def _(spark, sf):
    # one conversation has lost its key
    turns = fx.table(spark, sf, "conversations").withColumn("conv_id", F.nullif("conv_id", F.lit(3)))
    return sessions.pair_turns(turns, "conv_id", "turn", "role", "text").withColumn("conv_id", F.coalesce("conv_id", F.lit(-1)))


RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, turn DESC) AS age, count(*) OVER (PARTITION BY session_id) AS total FROM chat_history)"


@query("h4_last_turns", f"WITH {RANKED} SELECT session_id, turn, age FROM r WHERE age <= {LIMIT}", H)
def _(spark, sf):
    return sessions.last_turns(fx.history(spark, sf), LIMIT).select(_sid(), "turn", F.col("age").cast("bigint").alias("age"))


SUMMARY = f"""old AS (SELECT session_id, count(*) AS n, bool_or(contains(question, '서비스') OR contains(lower(question), 'service')) AS svc,
    bool_or(contains(question, '성능') OR contains(lower(question), 'performance')) AS perf FROM r WHERE age > {LIMIT} GROUP BY 1),
  txt AS (SELECT session_id, n, 'Previous conversation covered ' || n::VARCHAR || ' interactions about ' || CASE WHEN svc AND perf THEN 'services, performance'
    WHEN svc THEN 'services' WHEN perf THEN 'performance' ELSE 'various topics' END || '.' AS answer FROM old)"""
COMPRESSED = f"""c AS (SELECT session_id, 0 AS pos, '[Previous conversation summary]' AS question, answer, 'UNKNOWN' AS intent, 0.8::DOUBLE AS confidence, NULL::TIMESTAMP AS created_at FROM txt
  UNION ALL SELECT session_id, least(total, {LIMIT}) - age + 1, question, answer, intent, confidence, created_at FROM r WHERE age <= {LIMIT})"""


@query("h5_history_compression", f"WITH {RANKED}, {SUMMARY}, {COMPRESSED} SELECT session_id, pos AS turn_no, question, answer, intent, confidence FROM c", H)
def _(spark, sf):
    out = sessions.compress_history(fx.history(spark, sf), LIMIT)
    return out.select(_sid(), F.col("position").cast("bigint").alias("turn_no"), "question", "answer", "intent", "confidence")


@query(
    "h5_old_sources",
    f"WITH {RANKED} SELECT session_id, source_id, min(created_at) AS first_cited_at FROM r WHERE age > {LIMIT} GROUP BY 1, 2",
    H,
)
def _(spark, sf):
    return sessions.old_turn_sources(fx.history(spark, sf), LIMIT).select(
        _sid(), F.col("source").alias("source_id"), F.col("firstCitedAt").alias("first_cited_at")
    )


# Long questions name services and performance often enough to vary the text.
@query("h6_rule_summary", f"WITH {RANKED}, {SUMMARY} SELECT session_id, answer, n AS old_turns FROM txt", H)
def _(spark, sf):
    return sessions.old_turn_summary(fx.history(spark, sf), LIMIT).select(
        _sid(), "answer", F.col("oldTurns").alias("old_turns")
    )


CLIP = "CASE WHEN length(answer) > {n} THEN substr(answer, 1, {n}) || '...' ELSE answer END"


@query(
    "h7_render_history",
    f"""WITH {RANKED}, {SUMMARY}, {COMPRESSED},
    t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS no, count(*) OVER (PARTITION BY session_id) AS cnt FROM c)
    SELECT session_id, chr(10) || 'Chat History (Ordered from oldest to most recent):' || chr(10) || string_agg('Turn ' || no::VARCHAR
      || coalesce(' [' || floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(created_at)) / 60000.0 + 0.5)::BIGINT::VARCHAR || ' mins ago]', '')
      || CASE WHEN no = cnt THEN ' (LAST TURN)' ELSE '' END || ':' || chr(10) || 'Q: ' || question || chr(10) || 'A: ' || {CLIP.format(n=200)}, chr(10) || chr(10) ORDER BY no) AS history_text
    FROM t GROUP BY 1""",
    H,
)
def _(spark, sf):
    return sessions.render_history(sessions.compress_history(fx.history(spark, sf), LIMIT), _now()).toDF("session_id", "history_text")


@query(
    "h7_render_reformulation",
    f"""WITH {RANKED} SELECT session_id, string_agg('Turn ' || (least(total, 5) - age + 1)::VARCHAR || ':' || chr(10) || 'Q: ' || question || chr(10) || 'A: ' || {CLIP.format(n=200)},
      chr(10) || chr(10) ORDER BY age DESC) AS history_text FROM r WHERE age <= 5 GROUP BY 1""",
    H,
)
def _(spark, sf):
    return sessions.render_for_reformulation(fx.history(spark, sf), 5).toDF("session_id", "history_text")


@query(
    "h7_summariser_lines",
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, turn) AS no FROM chat_history)
    SELECT session_id, no AS turn_no, 'Q' || no::VARCHAR || ': ' || question || chr(10) || 'A' || no::VARCHAR || ': ' || {CLIP.format(n=150)} AS line FROM t""",
    H,
)
def _(spark, sf):
    return sessions.summariser_lines(fx.history(spark, sf)).toDF("session_id", "turn_no", "line")


GAPS = """g AS (SELECT session_id, created_at, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM chat_history
  WINDOW w AS (PARTITION BY session_id ORDER BY created_at, turn))"""


@query(
    "h8_session_expiry",
    f"""WITH {GAPS}, s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY created_at ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM g)
    SELECT session_id, session_no, min(created_at) AS started_at, max(created_at) AS last_at, count(*) AS n FROM s GROUP BY 1, 2""",
    H,
)
def _(spark, sf):
    return sessions.sessions_by_ttl(fx.history(spark, sf)).toDF("session_id", "session_no", "started_at", "last_at", "n")


# The query log is the access log here: 50 sessions over all questions.
@query(
    "h9_access_replay",
    """WITH g AS (SELECT session_id, CASE WHEN asked_at - lag(asked_at) OVER (PARTITION BY session_id ORDER BY asked_at) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS miss FROM query_log)
    SELECT session_id, count(*) AS accesses, count(*) - sum(miss)::BIGINT AS hits, sum(miss)::BIGINT AS misses, sum(miss)::BIGINT - 1 AS expiries FROM g GROUP BY 1""",
    ("query_log",),
)
def _(spark, sf):
    log = fx.questions(spark, sf).select(F.col("session_id").alias("sessionId"), F.col("asked_at").alias("at"))
    return sessions.access_replay(log, 6 * 3600).toDF("session_id", "accesses", "hits", "misses", "expiries")


# --- grounding ------------------------------------------------------------------
NL = "chr(10)"
EVENT_JSON = f"""'{{' || {NL} || '  "eventId": ' || event_id || ',' || {NL} || '  "requestId": "' || request_id || '",' || {NL} || '  "timestamp": "'
  || strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '",' || {NL} || '  "service": "' || service || '",' || {NL} || '  "route": "' || route || '"'
  || coalesce(',' || {NL} || '  "user": {{' || {NL} || '    "id": "' || user_id || '",' || {NL} || '    "role": "' || {ROLE} || '"' || {NL} || '  }}', '')
  || coalesce(',' || {NL} || '  "error": {{' || {NL} || '    "code": "' || error_code || '",' || {NL} || '    "message": "' || error_message || '"' || {NL} || '  }}', '')
  || coalesce(',' || {NL} || '  "performance": {{' || {NL} || '    "durationMs": ' || duration_ms || {NL} || '  }}', '') || {NL} || '}}'"""


@query(
    "h10_context_documents",
    f"""WITH {SCORES}, h AS ({_ranked('s', 5)})
    SELECT query_id, string_agg('[Document ' || rank || ']' || {NL} || {EVENT_JSON}, {NL} || {NL} ORDER BY rank) AS context_text FROM h JOIN wide_events USING (event_id) GROUP BY 1""",
    ("event_embeddings",),
)
def _(spark, sf):
    hits = retrieval.top_k(label_queries(spark, sf), fx.embedded(spark, sf), 5)
    return grounding.context_documents(retrieval.ground(hits, fx.events(spark, sf))).toDF("query_id", "context_text")


@query(
    "h10_aggregation_context",
    f"""SELECT '[Aggregation Results]' || {NL} || '[' || {NL} || string_agg('  {{' || {NL} || '    "service": "' || service || '",' || {NL} || '    "count": ' || n || ',' || {NL}
      || '    "topErrorCodes": []' || {NL} || '  }}', ',' || {NL} ORDER BY n DESC, service) || {NL} || ']' AS context_text
    FROM (SELECT service, count(*) AS n FROM wide_events WHERE error_code IS NOT NULL GROUP BY 1)""",
    ("wide_events",),
)
def _(spark, sf):
    by_service = metrics.error_by_service(fx.events(spark, sf))
    return grounding.aggregation_context(by_service, -F.col("count"), F.col("service")).toDF("context_text")


# Model outputs are rendered from every chat row: with and without confidence, fenced and bare verdicts.
RAW = """raw AS (SELECT session_id, turn, answer, confidence,
  CASE turn % 4 WHEN 0 THEN 'Answer: ' || answer || chr(10) || 'Confidence: ' || (conf)::VARCHAR WHEN 2 THEN answer ELSE 'answer:  ' || answer END AS output,
  CASE (turn // 2) % 4 WHEN 0 THEN '```json' || chr(10) || '{"status":"VERIFIED","confidenceAdjustment":1.5,"action":"KEEP_ANSWER"}' || chr(10) || '```'
    WHEN 1 THEN '{"status":"PARTIALLY_VERIFIED","confidenceAdjustment":0.5,"unverifiedClaims":["a","b"],"action":"ADJUST_CONFIDENCE"}'
    WHEN 2 THEN '{"action":"REJECT_ANSWER","unverifiedClaims":[]}' ELSE 'no json here' END AS verdict
  FROM (SELECT *, CASE (turn * 37) % 3 WHEN 0 THEN '0.25' WHEN 1 THEN '0.9' ELSE '1' END AS conf FROM chat_history))"""


def _outputs(spark, sf):
    t = F.col("turn")
    conf = F.when((t * 37) % 3 == 0, "0.25").when((t * 37) % 3 == 1, "0.9").otherwise("1")
    output = (
        F.when(t % 4 == 0, F.concat(F.lit("Answer: "), F.col("answer"), F.lit("\nConfidence: "), conf))
        .when(t % 4 == 2, F.col("answer"))
        .otherwise(F.concat(F.lit("answer:  "), F.col("answer")))
    )
    k = F.floor(t / 2) % 4
    verdict = (
        F.when(k == 0, '```json\n{"status":"VERIFIED","confidenceAdjustment":1.5,"action":"KEEP_ANSWER"}\n```')
        .when(k == 1, '{"status":"PARTIALLY_VERIFIED","confidenceAdjustment":0.5,"unverifiedClaims":["a","b"],"action":"ADJUST_CONFIDENCE"}')
        .when(k == 2, '{"action":"REJECT_ANSWER","unverifiedClaims":[]}')
        .otherwise("no json here")
    )
    return fx.history(spark, sf).withColumn("output", output).withColumn("verdict", verdict)


PARSED = f"""{RAW}, a AS (SELECT *, CASE WHEN turn % 4 = 2 THEN answer ELSE trim(answer, ' ' || chr(9) || chr(10) || chr(13)) END AS parsed,
    CASE WHEN turn % 4 = 0 THEN (CASE (turn * 37) % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.9 ELSE 1 END)::DOUBLE ELSE 0.5::DOUBLE END AS conf,
    CASE (turn // 2) % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'PARTIALLY_VERIFIED' ELSE 'NOT_VERIFIED' END AS status,
    (CASE (turn // 2) % 4 WHEN 0 THEN 1.0 WHEN 3 THEN 0.3 ELSE 0.5 END)::DOUBLE AS adjustment,
    CASE (turn // 2) % 4 WHEN 0 THEN 'KEEP_ANSWER' WHEN 2 THEN 'REJECT_ANSWER' ELSE 'ADJUST_CONFIDENCE' END AS action,
    CASE (turn // 2) % 4 WHEN 1 THEN 'a, b' WHEN 3 THEN 'Verification process failed' ELSE '' END AS claims FROM raw)"""


def _parsed(spark, sf):
    return (
        _outputs(spark, sf)
        .withColumn("a", grounding.parse_answer(F.col("output")))
        .withColumn("v", grounding.parse_verdict(F.col("verdict")))
    )


@query("h11_parse_outputs", f"WITH {PARSED} SELECT session_id, turn, parsed AS answer, conf AS confidence, status, adjustment, action, claims FROM a", H)
def _(spark, sf):
    return _parsed(spark, sf).select(
        _sid(), "turn", F.col("a.answer").alias("answer"), F.col("a.confidence").alias("confidence"), "v.status",
        F.col("v.confidenceAdjustment").alias("adjustment"), "v.action", F.array_join("v.unverifiedClaims", ", ").alias("claims"),
    )


@query(
    "h12_grounding_decision",
    f"""WITH {PARSED} SELECT session_id, turn, CASE action WHEN 'REJECT_ANSWER' THEN '{grounding.REJECTED_ANSWER}'
      WHEN 'ADJUST_CONFIDENCE' THEN parsed || chr(10) || chr(10) || '[Note: Some claims could not be fully verified: ' || claims || ']' ELSE parsed END AS answer,
      round(CASE action WHEN 'REJECT_ANSWER' THEN 0 WHEN 'ADJUST_CONFIDENCE' THEN least(conf, conf * adjustment) ELSE conf END, 6)::DOUBLE AS confidence FROM a""",
    H,
)
def _(spark, sf):
    d = grounding.decide(F.col("a.answer"), F.col("a.confidence"), F.col("v"))
    return _parsed(spark, sf).withColumn("d", d).select(_sid(), "turn", F.col("d.answer"), F.round("d.confidence", 6).alias("confidence"))


@query(
    "h13_traceability",
    """SELECT session_id, count(*) AS cited, count(w.request_id) AS grounded, count(w.request_id) / count(*)::DOUBLE AS grounded_share
    FROM chat_history h LEFT JOIN wide_events w ON w.request_id = h.source_id GROUP BY 1""",
    ("chat_history", "wide_events"),
)
def _(spark, sf):
    cites = grounding.trace_citations(fx.history(spark, sf), fx.events(spark, sf), ["sessionId", "turn"])
    return grounding.traceability(cites, ["sessionId"]).toDF("session_id", "cited", "grounded", "grounded_share")


@query(
    "h14_aggregate_sources",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY error_code ORDER BY event_ts, request_id) AS k FROM wide_events WHERE error_code IS NOT NULL),
    t AS (SELECT error_code FROM x GROUP BY 1 ORDER BY count(*) DESC, error_code LIMIT 5) SELECT request_id FROM x JOIN t USING (error_code) WHERE k <= 3""",
    ("wide_events",),
)
def _(spark, sf):
    return grounding.aggregate_sources(metrics.top_error_codes(fx.events(spark, sf))).toDF("request_id")


# Hits exist for every fifth question; every other question opens a session that has no history.
INTENT_SQL = "CASE query_id % 3 WHEN 0 THEN 'CONVERSATIONAL' WHEN 1 THEN 'SEMANTIC' ELSE 'STATISTICAL' END"


@query(
    "h20_default_answers",
    f"""WITH x AS (SELECT query_id, q.session_id, text, {INTENT_SQL} AS intent, h.turns, query_id % 5 = 0 AS has_hits
      FROM (SELECT query_id, text, session_id || CASE WHEN query_id % 2 = 1 THEN '-new' ELSE '' END AS session_id FROM query_log) q
      LEFT JOIN (SELECT session_id, count(*) AS turns FROM chat_history GROUP BY 1) h ON h.session_id = q.session_id),
    y AS (SELECT *, intent = 'CONVERSATIONAL' AND coalesce(turns, 0) = 0 AS fresh, intent = 'SEMANTIC' AND NOT has_hits AS nothing FROM x)
    SELECT query_id, session_id, intent, CASE WHEN fresh THEN CASE WHEN regexp_matches(text, '[가-힣]') THEN '{grounding.NO_HISTORY["Korean"]}' ELSE '{grounding.NO_HISTORY["English"].replace("'", "''")}' END
      ELSE '{grounding.NO_HITS_ANSWER}' END AS answer, CASE WHEN fresh THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM y WHERE fresh OR nothing""",
    ("query_log", "chat_history"),
)
def _(spark, sf):
    k = F.col("query_id") % 3
    qs = fx.questions(spark, sf).select(
        F.col("query_id").alias("queryId"),
        F.concat("session_id", F.when(F.col("query_id") % 2 == 1, "-new").otherwise("")).alias("sessionId"),
        "text",
        F.when(k == 0, "CONVERSATIONAL").when(k == 1, "SEMANTIC").otherwise("STATISTICAL").alias("intent"),
        qn.language(F.col("text")).alias("language"),
    )
    hits = qs.filter(F.col("queryId") % 5 == 0).select("queryId")
    turns = fx.history(spark, sf).groupBy("sessionId").agg(F.count("*").alias("turns"))
    return grounding.default_answers(qs, hits, turns).toDF("query_id", "session_id", "intent", "answer", "confidence")


# --- result cache -----------------------------------------------------------------
KEY = f"""sha256('{{"service":' || coalesce('"' || {SERVICE} || '"', 'null') || ',"route":null,"errorCode":' || coalesce('"' || {CODE} || '"', 'null')
  || ',"hasError":' || CASE WHEN {HAS_ERROR} THEN 'true' ELSE 'false' END || ',"startTime":' || coalesce('"' || strftime(date_trunc('hour', {START}), '%Y-%m-%dT%H:%M:%S.%gZ') || '"', 'null') || ',"endTime":null}}')"""


def _keyed(spark, sf):
    m = meta_args()
    start = qn.time_range(F.col("text"), F.col("asked_at"))["startTime"]
    key = result_cache.cache_key(m["service"], m["route"], m["error_code"], m["has_error"], start, F.lit(None).cast("timestamp"))
    return asked(spark, sf).withColumn("cacheKey", key).withColumn("startTime", start)


@query("h15_cache_key", f"SELECT query_id, {KEY} AS cache_key FROM query_log", ("query_log",))
def _(spark, sf):
    return _keyed(spark, sf).select("query_id", F.col("cacheKey").alias("cache_key"))


# Vectors double as cache writes and look-ups: key = service, every event writes; the look-up
# comes 20 minutes after the event with the vector of the event before it.
LOOKUP = """w AS (SELECT event_id AS entry_id, service AS k, event_ts AS cached_at, CASE WHEN label % 2 = 0 THEN 900000 ELSE 3600000 END AS ttl, embedding FROM event_embeddings),
  r AS (SELECT event_id AS query_id, service AS k, event_ts + INTERVAL 20 MINUTE AS asked_at, embedding FROM event_embeddings),
  m AS (SELECT query_id, max((cached_at, entry_id)) AS last FROM r JOIN w ON w.k = r.k AND w.cached_at <= r.asked_at AND r.asked_at - w.cached_at <= INTERVAL 60 MINUTE GROUP BY 1),
  j AS (SELECT r.query_id, w.entry_id, epoch_ms(asked_at) - epoch_ms(cached_at) <= ttl AS live, list_cosine_similarity(r.embedding::DOUBLE[], w.embedding::DOUBLE[]) AS sim
    FROM r LEFT JOIN m ON m.query_id = r.query_id LEFT JOIN w ON w.k = r.k AND w.entry_id = m.last[2])"""


def _entries(spark, sf):
    return fx.embedded(spark, sf).select(
        F.col("eventId").alias("entryId"), F.col("service").alias("cacheKey"), F.col("timestamp").alias("cachedAt"),
        F.when(F.col("label") % 2 == 0, 900_000).otherwise(3_600_000).cast("bigint").alias("ttlMs"), "embedding",
    )


def _lookups(spark, sf):
    return fx.embedded(spark, sf).select(
        F.col("eventId").alias("queryId"), F.col("service").alias("cacheKey"),
        (F.col("timestamp") + F.expr("INTERVAL 20 MINUTES")).alias("askedAt"), "embedding",
    )


@query(
    "h16_cache_lookup",
    f"WITH {LOOKUP} SELECT query_id, coalesce(entry_id, -1) AS entry_id, coalesce(live, FALSE) AS live, CASE WHEN live THEN round(sim, 6) END AS similarity, coalesce(live AND sim >= 0.95, FALSE) AS hit FROM j",
    ("event_embeddings",),
)
def _(spark, sf):
    out = result_cache.lookup(_lookups(spark, sf), _entries(spark, sf))
    return out.select(
        F.col("queryId").alias("query_id"), F.coalesce("entryId", F.lit(-1)).alias("entry_id"), "live", F.round("similarity", 6).alias("similarity"), "hit"
    )


@query(
    "h17_cache_write",
    f"""SELECT query_id, {KEY} AS cache_key, CASE WHEN {START} IS NOT NULL THEN 900000 ELSE 3600000 END::BIGINT AS ttl_ms
    FROM query_log WHERE query_id % 4 <> 0""",
    ("query_log",),
)
def _(spark, sf):
    results = _keyed(spark, sf).select(
        "query_id", "service", "route", "errorCode", "hasError", "startTime",
        F.lit(None).cast("timestamp").alias("endTime"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.when(F.col("query_id") % 4 == 0, F.array()).otherwise(F.array(F.lit("hit"))).alias("vectorResults"),
    )
    return result_cache.cache_entries(results, _now()).select(
        "query_id", F.col("cacheKey").alias("cache_key"), F.col("ttlMs").alias("ttl_ms")
    )


@query(
    "h18_cache_purge",
    """SELECT event_id FROM event_embeddings WHERE epoch_ms(TIMESTAMP '2024-01-01 08:00:00') - epoch_ms(event_ts) <= CASE WHEN label % 2 = 0 THEN 900000 ELSE 3600000 END""",
    ("event_embeddings",),
)
def _(spark, sf):
    live = result_cache.purge(_entries(spark, sf), F.lit("2024-01-01 08:00:00").cast("timestamp"))
    return live.select(F.col("entryId").alias("event_id"))


@query(
    "h18_cache_invalidate",
    "SELECT event_id FROM event_embeddings WHERE NOT (service = 'orders' AND label IN (2, 3))",
    ("event_embeddings",),
)
def _(spark, sf):
    keyed = fx.embedded(spark, sf).withColumn("cacheKey", F.concat_ws("-", "service", "label"))
    stale = keyed.filter("service = 'orders' AND label IN (2, 3)").select("cacheKey")
    return result_cache.invalidate(keyed, stale).select(F.col("eventId").alias("event_id"))


@query(
    "h19_answer_cache",
    r"""WITH k AS (SELECT sha256(regexp_replace(trim(lower(text)), '\s+', ' ', 'g') || '|v1|' || CASE WHEN regexp_matches(text, '[가-힣]') THEN 'Korean' ELSE 'English' END) AS key, asked_at FROM query_log),
    g AS (SELECT CASE WHEN asked_at - lag(asked_at) OVER (PARTITION BY key ORDER BY asked_at) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS miss FROM k)
    SELECT count(*) AS questions, sum(miss)::BIGINT AS misses, count(*) - sum(miss)::BIGINT AS hits, (count(*) - sum(miss)) * 100.0::DOUBLE / count(*) AS hit_rate FROM g""",
    ("query_log",),
)
def _(spark, sf):
    t = F.col("text")
    keyed = fx.questions(spark, sf).select(
        result_cache.answer_key(t, F.lit("v1"), qn.language(t)).alias("key"), F.col("asked_at").alias("askedAt")
    )
    return result_cache.exact_hit_rate(keyed).toDF("questions", "misses", "hits", "hit_rate")
