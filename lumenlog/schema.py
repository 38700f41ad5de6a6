"""Table schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------
USER_ROLES = ["admin", "user", "premium", "guest"]

# upper bound (exclusive, ms) -> bucket
LATENCY_BUCKETS = [
    (50, "P_SUB_50MS"),
    (200, "P_50_200MS"),
    (500, "P_200_500MS"),
    (1000, "P_500_1000MS"),
]
LATENCY_TOP = "P_OVER_1000MS"
LATENCY_UNKNOWN = "P_UNKNOWN"

INTENTS = ["STATISTICAL", "SEMANTIC", "SEQUENTIAL", "CONVERSATIONAL", "UNKNOWN"]
# --- end of fixed values ------------------------------------------------------


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


USER = _struct(("id", T.StringType()), ("role", T.StringType()))
ERROR = _struct(("code", T.StringType()), ("message", T.StringType()))
PERFORMANCE = _struct(("durationMs", T.LongType()))

# Immutable core record: what the JSON-lines sink holds.
WIDE_EVENT = _struct(
    ("requestId", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("service", T.StringType()),
    ("route", T.StringType()),
    ("user", USER),
    ("error", ERROR),
    ("performance", PERFORMANCE),
)

# Stored record: core plus the free-form bag (JSON text) and the summary.
STORED_EVENT = T.StructType(
    WIDE_EVENT.fields
    + [
        T.StructField("_metadata", T.StringType(), True),
        T.StructField("_summary", T.StringType(), True),
    ]
)

# Queue message value. ``_metadata`` stays a JSON object on the wire.
QUEUE_VALUE = _struct(
    ("event", WIDE_EVENT),
    ("_metadata", T.StringType()),
    ("summary", T.StringType()),
    ("timestamp", T.TimestampType()),
)

EMBEDDED_EVENT = _struct(
    ("eventId", T.LongType()),
    ("requestId", T.StringType()),
    ("summary", T.StringType()),
    ("model", T.StringType()),
    ("embedding", T.ArrayType(T.FloatType())),
    ("service", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("createdAt", T.TimestampType()),
)

EMBEDDING_PROGRESS = _struct(
    ("source", T.StringType()),
    ("lastEmbeddedEventId", T.LongType()),
    ("lastEmbeddedEventTimestamp", T.TimestampType()),
    ("lastUpdatedAt", T.TimestampType()),
)

CHAT_HISTORY = _struct(
    ("sessionId", T.StringType()),
    ("intent", T.StringType()),
    ("question", T.StringType()),
    ("answer", T.StringType()),
    ("confidence", T.DoubleType()),
    ("sources", T.ArrayType(T.StringType())),
    ("createdAt", T.TimestampType()),
    ("updatedAt", T.TimestampType()),
)

REQUIRED_EMBEDDED = ["eventId", "summary", "model", "embedding", "createdAt"]
REQUIRED_PROGRESS = [f.name for f in EMBEDDING_PROGRESS.fields]
REQUIRED_HISTORY = [f.name for f in CHAT_HISTORY.fields]
