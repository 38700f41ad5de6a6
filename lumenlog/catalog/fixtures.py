"""Views that give the driver tables the shapes the operators work on.

One SQL text per view serves both engines: Spark runs it over parquet files, the
oracle prefixes it to its own SQL. ``chat_history`` is the exception: Spark pairs
the turns with :func:`lumenlog.operators.sessions.pair_turns`.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions import events as ev

VIEWS: dict[str, tuple[list[str], str]] = {
    "wide_events": (
        ["events"],
        """SELECT event_id,
  concat('req-', CAST(event_id AS VARCHAR(20))) AS request_id,
  ts AS event_ts,
  CASE user_id % 4 WHEN 0 THEN 'payments' WHEN 1 THEN 'orders' WHEN 2 THEN 'users' ELSE 'products' END AS service,
  CASE event_id % 6 WHEN 0 THEN 'POST /payments' WHEN 1 THEN 'POST /payments/checkout' WHEN 2 THEN 'GET /orders/:id'
       WHEN 3 THEN 'GET /users/profile' WHEN 4 THEN 'POST /users/login' ELSE 'GET /products' END AS route,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('user-', CAST(user_id AS VARCHAR(20))) END AS user_id,
  CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 IN (1,2) THEN 'premium' WHEN user_id % 7 = 3 THEN 'admin'
       WHEN user_id % 7 = 4 THEN 'user' WHEN user_id % 7 = 5 THEN 'gold' ELSE 'standard' END AS user_role_raw,
  CASE WHEN event_type <> 'error' THEN NULL
       WHEN event_id % 10 IN (0,1,2,3) THEN 'INSUFFICIENT_FUNDS' WHEN event_id % 10 IN (4,5) THEN 'GATEWAY_TIMEOUT'
       WHEN event_id % 10 = 6 THEN 'CARD_EXPIRED' WHEN event_id % 10 = 7 THEN 'GATEWAY_REJECTED'
       WHEN event_id % 10 = 8 THEN 'FRAUD_DETECTION' ELSE 'INSUFFICIENT_BALANCE' END AS error_code,
  CASE WHEN event_type <> 'error' THEN NULL ELSE concat('failed at step ', CAST(event_id % 3 AS VARCHAR(20))) END AS error_message,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(floor(value * 20) AS BIGINT) END AS duration_ms
FROM events""",
    ),
    "event_embeddings": (
        ["wide_events", "embeddings"],
        """SELECT w.event_id, w.request_id, w.service, w.event_ts, 'test-64' AS model, e.label, e.embedding
FROM embeddings e JOIN wide_events w ON w.event_id = e.vec_id""",
    ),
    "chat_turns": (
        ["conversations"],
        """SELECT conv_id, turn, role, text AS question,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer
      FROM conversations""",
    ),
    "chat_history": (
        ["chat_turns"],
        """SELECT concat('s-', CAST(conv_id AS VARCHAR(20))) AS session_id, turn, question, answer,
  TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * (CASE WHEN conv_id % 3 = 0 THEN 20 ELSE 7 END) * INTERVAL '1' MINUTE AS created_at,
  CASE conv_id % 3 WHEN 0 THEN 'SEMANTIC' WHEN 1 THEN 'STATISTICAL' ELSE 'CONVERSATIONAL' END AS intent,
  CAST((turn * 37 + conv_id * 11) % 101 AS DOUBLE) / 100 AS confidence,
  concat(CASE WHEN conv_id % 5 = 0 THEN 'gone-' ELSE 'req-' END, CAST((conv_id * 31 + turn) % 900 AS VARCHAR(20))) AS source_id
FROM chat_turns WHERE role = 'user' AND next_role = 'assistant'""",
    ),
    "query_log": (
        ["wide_events"],
        """SELECT event_id AS query_id, event_ts AS asked_at, concat('s-', CAST(event_id % 50 AS VARCHAR(20))) AS session_id,
  CASE event_id % 12
    WHEN 0 THEN 'What are the top 5 error codes in the payments service yesterday?'
    WHEN 1 THEN 'Which routes have the most errors?'
    WHEN 2 THEN 'What is the error rate for checkout requests in the last 2 hours?'
    WHEN 3 THEN 'Show me P95 latency for /orders/:id today'
    WHEN 4 THEN 'Why are premium users failing to pay?'
    WHEN 5 THEN 'What did I just ask?'
    WHEN 6 THEN 'Show me CARD_EXPIRED errors in the last 24 hours'
    WHEN 7 THEN '어제 결제 에러 원인은 무엇인가요?'
    WHEN 8 THEN 'Did it succeed for admin?'
    WHEN 9 THEN 'List unusual events for anonymous visitors'
    WHEN 10 THEN 'slow requests in the order service'
    ELSE 'hello' END AS text
FROM wide_events""",
    ),
    "fragments": (
        ["wide_events"],
        """SELECT request_id, 1 AS seq, event_ts, 'backend' AS service, route, CAST(NULL AS VARCHAR(50)) AS user_id, CAST(NULL AS VARCHAR(50)) AS error_code, CAST(NULL AS BIGINT) AS duration_ms FROM wide_events
UNION ALL SELECT request_id, 2, NULL, service, NULL, user_id, NULL, NULL FROM wide_events
UNION ALL SELECT request_id, 3, NULL, CASE WHEN error_code LIKE 'GATEWAY%' THEN 'paymentGateway' END, NULL, NULL, error_code, NULL FROM wide_events
UNION ALL SELECT request_id, 4, NULL, NULL, NULL, NULL, NULL, duration_ms FROM wide_events""",
    ),
    "error_responses": (
        ["wide_events"],
        """SELECT request_id, error_code,
  CASE event_id % 6
   WHEN 0 THEN concat('{"errorCode":"', error_code, '","errorMessage":"', error_message, '","errorService":"paymentGateway"}')
   WHEN 1 THEN concat('{"statusCode":400,"message":["', error_message, '","amount must be positive","count must be positive","role is unknown"],"error":"Bad Request"}')
   WHEN 2 THEN concat('{"message":"', error_message, '","statusCode":503}')
   WHEN 3 THEN concat('["', error_message, '","a","b","c","d"]')
   WHEN 4 THEN concat('"', repeat(error_message, 15), '"')
   ELSE NULL END AS raw_response,
  CASE event_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 400 WHEN 2 THEN 429 ELSE 418 END AS http_status
FROM wide_events WHERE error_code IS NOT NULL""",
    ),
    "raw_requests": (
        ["pages"],
        """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'Post' WHEN 2 THEN 'PUT' ELSE 'delete' END AS method,
  regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages""",
    ),
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        if name in VIEWS:
            for dep in _closure(VIEWS[name][0]) + [name]:
                if dep not in out:
                    out.append(dep)
    return out


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL: ``sql`` prefixed with the views it names, as CTEs.

    ``sql`` may itself start with ``WITH``; its CTEs are appended.
    """
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in _closure(list(names))]
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _bases(names: list[str]) -> list[str]:
    found = []
    for name in _closure(names):
        found += [d for d in VIEWS[name][0] if d not in VIEWS and d not in found]
    return found


# The driver tables never change, so their lazy plans are built once per session.
@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=256)
def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    names = _closure([name])
    ctes = [f"{b} AS (SELECT * FROM parquet.`{sf_dir}/{b}.parquet`)" for b in _bases([name])]
    ctes += [f"{n} AS ({VIEWS[n][1]})" for n in names]
    return spark.sql("WITH " + ",\n".join(ctes) + f"\nSELECT * FROM {name}")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested wide events with ``eventId``, the raw role coerced."""
    w = view(spark, sf_dir, "wide_events")
    return w.select(
        F.col("event_id").alias("eventId"),
        F.col("request_id").alias("requestId"),
        F.col("event_ts").cast("timestamp").alias("timestamp"),
        "service",
        "route",
        ev.user_struct(F.col("user_id"), F.col("user_role_raw")).alias("user"),
        ev.error_struct(F.col("error_code"), F.col("error_message")).alias("error"),
        ev.performance_struct(F.col("duration_ms")).alias("performance"),
    )


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored: canonical summary attached."""
    return events(spark, sf_dir).withColumn("_summary", ev.canonical_summary(**ev.event_args()))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "event_embeddings")
    return e.select(
        F.col("event_id").alias("eventId"),
        F.col("request_id").alias("requestId"),
        "service",
        F.col("event_ts").cast("timestamp").alias("timestamp"),
        "model",
        "label",
        "embedding",
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat history rows, turns paired by the skew-safe operator."""
    from lumenlog.operators.sessions import pair_turns

    turns = pair_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    conv, turn = F.col("conv_id"), F.col("turn")
    minutes = conv * 60 + turn * F.when(conv % 3 == 0, 20).otherwise(7)
    return turns.select(
        F.concat(F.lit("s-"), conv.cast("string")).alias("sessionId"),
        "turn",
        "question",
        "answer",
        F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + minutes * 60_000_000).alias(
            "createdAt"
        ),
        F.when(conv % 3 == 0, "SEMANTIC")
        .when(conv % 3 == 1, "STATISTICAL")
        .otherwise("CONVERSATIONAL")
        .alias("intent"),
        (((turn * 37 + conv * 11) % 101).cast("double") / 100).alias("confidence"),
        F.array(
            F.concat(
                F.when(conv % 5 == 0, "gone-").otherwise("req-"),
                ((conv * 31 + turn) % 900).cast("string"),
            )
        ).alias("sources"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = view(spark, sf_dir, "query_log")
    return q.withColumn("asked_at", F.col("asked_at").cast("timestamp"))
