"""Columns read from question texts. Keyword tests are substring tests on lower case."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.events import lookup

# --- fixed values -------------------------------------------------------------
CONVERSATIONAL = [
    "방금", "이전", "질문", "대화", "했지", "했었지", "물어봤지", "뭐였지", "previous", "last question",
    "conversation", "what did i just ask", "what did i just answer", "what did i just note",
    "what was my last question", "what was my last answer", "what was my last note",
    "what was my last conversation", "just asked", "just answered", "just noted", "in this session",
    "session", "what was my", "tell me about", "who are you", "what can you do", "help me", "did i ask",
    "history", "record",
]
AGGREGATION = [
    "상위", "top", "주요", "원인", "frequent", "most", "common", "group", "그룹", "집계", "aggregate",
    "통계", "statistics",
]
STATISTICAL = [
    "빈도", "frequency", "얼마나", "how many", "몇 번", "how much", "통계", "statistics", "비율",
    "percentage", "추세", "trend", "평균", "average", "p95", "지연", "latency", "개수", "count", "rate",
    "상위", "top", "주요", "원인", "frequent", "most", "common", "group", "그룹", "집계", "aggregate",
]
SEMANTIC = [
    "why", "왜", "what", "무엇", "how", "어떻게", "when", "언제", "where", "어디", "who", "누가", "Which",
    "누구", "whose", "무슨", "what happened",
]
OUTCOMES = {
    "FAILED": ["failed", "failure", "error", "errors", "exception", "timeout", "broken", "down", "issue", "problem"],
    "SUCCESS": ["success", "succeeded", "working", "ok"],
    "WARNING": [
        "slow", "latency", "warning", "degraded", "slow response", "slow performance", "slow network",
        "slow database", "slow API", "slow service",
    ],
    "EDGE_CASE": [
        "edge case", "edge", "unknown", "특별한", "rare", "unusual", "rare event", "unusual event",
        "rare case", "unusual case", "rare scenario", "unusual scenario", "rare situation",
        "unusual situation",
    ],
}
ROLES = {
    "PREMIUM": ["premium", "paid", "subscription"],
    "ADMIN": ["admin", "administrator"],
    "ANONYMOUS": ["anonymous", "guest"],
}
LATENCIES = {
    "P_UNDER_100MS": ["fast", "quick", "<100ms", "under 100"],
    "P_100_500MS": ["100-500", "100 to 500"],
    "P_500_1000MS": ["500-1000", "500 to 1000", "half second"],
    "P_OVER_1000MS": ["slow", ">1000ms", "over 1000", "second", "timeout"],
}
SERVICES = {
    "payment": "payments",
    "embedding": "embeddings",
    "user": "users",
    "order": "orders",
    "product": "products",
    "cart": "carts",
    "checkout": "checkouts",
}
ROUTES = {
    "/payments/checkout": ["checkout", "check-out", "check out"],
    "/payments": ["payment", "pay", "billing"],
    "/embeddings": ["embedding", "embed", "vector"],
    "/search": ["search", "query", "ask"],
    "/users": ["user", "profile", "account"],
    "/orders": ["order", "purchase"],
    "/products": ["product", "item", "catalog"],
    "/carts": ["cart", "basket"],
}
REFERENCES = [
    r"\b(it|that|this|those|these|the error|the issue|the problem)\b",
    "(그|그것|그 에러|그 문제|그 이슈|그것의|그의)",
    "(방금|지금|최근|이전|지난|어제|오늘|just now|recently|previous|last)",
    "(내가|제가|나|저|I|me|my|mine)",
    "(질문|questioned|questioning)",
    "(그것|이것|저것|that|this|it)",
]
ERROR_WORDS = ["error", "failed", "failure", "exception", "problem", "issue", "broken", "crash"]
ERROR_CODES = [
    "GATEWAY_TIMEOUT", "GATEWAY_REJECTED", "GATEWAY_ERROR", "INSUFFICIENT_BALANCE", "INSUFFICIENT_FUNDS",
    "CARD_EXPIRED", "FRAUD_DETECTION", "MAINTENANCE_WINDOW", "ACCOUNT_LOCKED", "VALIDATION_ERROR",
    "UNAUTHORIZED", "NOT_FOUND", "INTERNAL_ERROR",
]
NAMED_SERVICES = ["payment", "user", "order", "product"]
TEMPLATE_RULES = {
    "LATENCY_PERCENTILE": ["latency", "response time", "p50", "p95", "p99", "slow", "performance"],
    "ERROR_RATE": ["error rate", "error percentage", "failure rate", "percent"],
    "ERROR_DISTRIBUTION_BY_ROUTE": ["route", "endpoint"],
    "ERROR_BY_SERVICE": ["by service", "which service", "service error", "each service"],
}
DEFAULT_TEMPLATE = "TOP_ERROR_CODES"
# Query latency names -> the buckets events carry.
EVENT_BUCKETS = {
    "P_UNDER_100MS": ["P_SUB_50MS", "P_50_200MS"],
    "P_100_500MS": ["P_50_200MS", "P_200_500MS"],
    "P_500_1000MS": ["P_500_1000MS"],
    "P_OVER_1000MS": ["P_OVER_1000MS"],
}
# --- end of fixed values ------------------------------------------------------


def contains_any(text: Column, words: list[str], word_boundary: bool = False) -> Column:
    """Any of ``words`` in ``text``, which is already lower-cased.

    Plain substring searches are several times cheaper than one regular
    expression; a word that holds another word of the list is never needed.
    """
    if word_boundary:
        body = "|".join(re.escape(w) for w in words)
        return F.rlike(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])({body})(?![\p{{L}}\p{{N}}])"))
    needed = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in needed])


def first_match(text: Column, table: dict[str, list[str]], default: Column, word_boundary: bool = False) -> Column:
    expr = None
    for name, words in table.items():
        expr = (F.when if expr is None else expr.when)(contains_any(text, words, word_boundary), name)
    return expr.otherwise(default)


def _null() -> Column:
    return F.lit(None).cast("string")


# Strategies in descending priority: intent, keyword lists.
STRATEGIES: list[tuple[str, list[str]]] = [
    ("CONVERSATIONAL", CONVERSATIONAL),
    ("STATISTICAL", AGGREGATION + STATISTICAL),
    ("SEMANTIC", SEMANTIC),
]


def intent(text: Column, strategies: list[tuple[str, list[str]]] | None = None, word_boundary: bool = False) -> Column:
    rules = dict(strategies or STRATEGIES)
    return first_match(F.lower(text), rules, F.lit("SEMANTIC"), word_boundary)


def language(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit("[ㄱ-ㅎㅏ-ㅣ가-힣]")), "Korean").otherwise("English")


def outcome_hint(text: Column, has_error: Column, error_code: Column, word_boundary: bool = False) -> Column:
    known = F.coalesce(has_error, F.lit(False)) | (F.coalesce(error_code, F.lit("")) != "")
    return F.when(known, "FAILED").otherwise(first_match(F.lower(text), OUTCOMES, F.lit("ANY"), word_boundary))


def role_hint(text: Column) -> Column:
    return first_match(F.lower(text), ROLES, _null())


def latency_hint(text: Column) -> Column:
    return first_match(F.lower(text), LATENCIES, _null())


def event_buckets(hint: Column) -> Column:
    """Buckets of stored events a latency hint stands for."""
    expr = None
    for name, buckets in EVENT_BUCKETS.items():
        expr = (F.when if expr is None else expr.when)(hint == name, F.array(*[F.lit(b) for b in buckets]))
    return expr


def normalize_service(service: Column) -> Column:
    return lookup(F.lower(F.trim(service)), SERVICES, F.nullif(service, F.lit("")))


def route_hint(text: Column, route: Column) -> Column:
    path = F.regexp_extract(text, "(?i)(/[a-z0-9\\-_/]+)", 1)
    words = first_match(F.lower(text), {r: w for r, w in ROUTES.items()}, _null())
    return F.coalesce(F.nullif(route, F.lit("")), words, F.nullif(path, F.lit("")))


def structured_text(text: Column, service: Column, route: Column, error_code: Column, has_error: Column) -> Column:
    """Question, blank line, known parts in summary order.

    The metadata arguments are best columns of the input, not expressions: they
    are used several times.
    """
    code = F.nullif(error_code, F.lit(""))
    failing = F.coalesce(has_error, F.lit(False)) | code.isNotNull()

    def part(name, value):
        return F.concat(F.lit(f"{name}: "), value)  # null when the value is

    parts = F.concat_ws(
        ", ",
        part("Outcome", F.nullif(outcome_hint(text, has_error, error_code), F.lit("ANY"))),
        part("Service", normalize_service(service)),
        part("Route", route_hint(text, route)),
        F.when(failing, part("Error", F.coalesce(code, F.lit("ANY")))),
        F.when(failing, F.lit("ErrorMessage: ANY")),
        part("UserRole", role_hint(text)),
        part("LatencyBucket", latency_hint(text)),
    )
    return F.concat(F.trim(text), F.lit("\n\n"), parts)


def with_metadata(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the metadata its question text states: service, route, errorCode, hasError."""
    t = F.col(text)
    found = df.withColumns({"service": mentioned_service(t), "route": _null(), "errorCode": mentioned_code(t)})
    return found.withColumn("hasError", contains_any(F.lower(t), ERROR_WORDS) | F.col("errorCode").isNotNull())


def variations(text: Column, service: Column, route: Column, error_code: Column, has_error: Column) -> Column:
    """Texts to search with: primary, error-focused if different, service, raw."""
    primary = structured_text(text, service, route, error_code, has_error)
    focused = structured_text(text, service, route, error_code, F.lit(True))
    failing = F.coalesce(has_error, F.lit(False)) | (F.coalesce(error_code, F.lit("")) != "")
    return F.array_compact(
        F.array(
            primary,
            F.when(failing & (focused != primary), focused),
            F.concat(F.lit("Service: "), F.nullif(service, F.lit(""))),
            text,
        )
    )


def has_references(text: Column, history_turns: Column) -> Column:
    found = None
    for pattern in REFERENCES:
        hit = F.rlike(F.lower(text), F.lit(pattern))
        found = hit if found is None else found | hit
    return (history_turns > 0) & found


def is_standalone(original: Column, reformulated: Column) -> Column:
    def norm(c):
        return F.regexp_replace(F.trim(F.lower(c)), "[?.!]", "")

    o, r = norm(original), norm(reformulated)
    ratio = F.when(F.length(r) == 0, F.length(o) > 0).otherwise(F.length(o) / F.nullif(F.length(r), F.lit(0)) > 0.8)
    return (o == r) | F.contains(r, o) | ratio


def time_range(text: Column, now: Column) -> Column:
    """{startTime, endTime} of "last N units", yesterday and today; null without one."""
    low = F.lower(text)
    pattern = r"last\s+(\d+\s+)?(minute|hour|day|week)s?"
    unit = F.regexp_extract(low, pattern, 2)
    digits = F.trim(F.regexp_extract(low, pattern, 1))
    count = F.when(digits == "", F.lit(1).cast("bigint")).otherwise(digits.try_cast("bigint"))
    seconds = lookup(unit, {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}, F.lit(None).cast("int"))
    midnight = F.date_trunc("day", now)

    def shift(ts, secs):
        return F.timestamp_micros(F.unix_micros(ts) + secs * F.lit(1_000_000).cast("bigint"))

    def span(start, end):
        return F.struct(start.alias("startTime"), end.alias("endTime"))

    return (
        F.when(unit != "", span(shift(now, -(count * seconds)), now))
        .when(contains_any(low, ["yesterday", "어제"]), span(shift(midnight, F.lit(-86400)), shift(midnight, F.lit(-1))))
        .when(contains_any(low, ["today", "오늘"]), span(midnight, now))
        .otherwise(F.lit(None).cast("struct<startTime:timestamp,endTime:timestamp>"))
    )


def mentioned_code(text: Column) -> Column:
    """First allowed error code spelled out in the text."""
    return F.nullif(F.regexp_extract(F.upper(text), "(" + "|".join(ERROR_CODES) + ")", 1), F.lit(""))


def mentions_error(text: Column) -> Column:
    return contains_any(F.lower(text), ERROR_WORDS) | mentioned_code(text).isNotNull()


def mentioned_service(text: Column) -> Column:
    low = F.lower(text)
    return first_match(low, {SERVICES[w]: [w] for w in NAMED_SERVICES}, _null())


def metric_template(text: Column) -> Column:
    return first_match(F.lower(text), TEMPLATE_RULES, F.lit(DEFAULT_TEMPLATE))


def top_n(text: Column, default: int = 5) -> Column:
    digits = F.regexp_extract(F.lower(text), r"top\s+(\d+)", 1)
    n = digits.try_cast("bigint")  # null for no number and for one that is too long
    return F.when(n > 0, n).otherwise(F.lit(default).cast("bigint"))


def merge_metadata(extracted: Column, initial: Column, failed: Column) -> Column:
    """Extracted values win, gaps filled from the initial ones.

    Where extraction failed the question falls back to the default template over
    the initial metadata, about errors unless told otherwise.
    """
    names = ["startTime", "endTime", "service", "route", "errorCode"]

    def pick(f):
        return F.when(failed, initial[f]).otherwise(F.coalesce(extracted[f], initial[f])).alias(f)

    has_error = F.when(failed, F.coalesce(initial["hasError"], F.lit(True))).otherwise(
        F.coalesce(extracted["hasError"], initial["hasError"])
    )
    return F.struct(
        F.when(failed, F.lit(DEFAULT_TEMPLATE)).otherwise(F.coalesce(extracted["templateId"], F.lit(DEFAULT_TEMPLATE))).alias("templateId"),
        F.when(failed, F.lit(5).cast("bigint")).otherwise(F.coalesce(extracted["topN"], F.lit(5).cast("bigint"))).alias("topN"),
        *[pick(n) for n in names],
        has_error.alias("hasError"),
    )
