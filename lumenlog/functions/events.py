"""Column expressions over one wide event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.schema import LATENCY_BUCKETS, LATENCY_TOP, LATENCY_UNKNOWN, USER_ROLES

# --- fixed values -------------------------------------------------------------
SERVICE_DISPLAY = {"payments": "payment", "embeddings": "embedding"}
ROUTE_DISPLAY = {"profile": "profile access", "register": "registration"}
ROLE_DISPLAY = {
    "PREMIUM": "premium",
    "ADMIN": "admin",
    "ANONYMOUS": "anonymous",
    "ANONYMOUS_USER": "anonymous",
    "GUEST": "guest",
}
ERROR_DISPLAY = {
    "GATEWAY_TIMEOUT": "gateway timeout",
    "INSUFFICIENT_BALANCE": "insufficient balance",
    "VALIDATION_ERROR": "validation error",
    "UNAUTHORIZED": "authorization failure",
    "NOT_FOUND": "resource not found",
    "INTERNAL_ERROR": "internal error",
}
# --- end of fixed values ------------------------------------------------------


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    """``table[key]`` as a CASE chain, which stays inside generated code."""
    expr = None
    for k, v in table.items():
        expr = (F.when if expr is None else expr.when)(key == k, F.lit(v))
    return expr.otherwise(default)


def coerce_role(role: Column) -> Column:
    """Unknown roles become ``guest``; no role stays null."""
    return F.when(role.isNull() | role.isin(USER_ROLES), role).otherwise("guest")


def user_struct(user_id: Column, role: Column) -> Column:
    """User struct with a coerced role, null when there is no id."""
    known = F.when(role.isin(USER_ROLES), role).otherwise("guest")
    return F.when(user_id.isNotNull(), F.struct(user_id.alias("id"), known.alias("role")))


def error_struct(code: Column, message: Column) -> Column:
    return F.when(code.isNotNull(), F.struct(code.alias("code"), message.alias("message")))


def performance_struct(duration_ms: Column) -> Column:
    return F.when(
        duration_ms.isNotNull(), F.struct(duration_ms.cast("bigint").alias("durationMs"))
    )


def latency_bucket(duration_ms: Column) -> Column:
    expr = F.when(duration_ms.isNull(), LATENCY_UNKNOWN)
    for bound, name in LATENCY_BUCKETS:
        expr = expr.when(duration_ms < bound, name)
    return expr.otherwise(LATENCY_TOP)


def outcome(error: Column, duration_ms: Column) -> Column:
    """An error outranks latency; ``error`` is any column that is null without one."""
    return (
        F.when(error.isNotNull(), "FAILED")
        .when(duration_ms.isNull(), "EDGE_CASE")
        .when(duration_ms >= LATENCY_BUCKETS[-1][0], "WARNING")
        .otherwise("SUCCESS")
    )


def canonical_summary(
    service: Column, route: Column, code: Column, message: Column, role: Column, duration_ms: Column
) -> Column:
    parts = [
        ("Outcome", outcome(code, duration_ms)),
        ("Service", service),
        ("Route", route),
        ("Error", F.coalesce(code, F.lit("NONE"))),
        ("ErrorMessage", F.coalesce(message, F.lit("NONE"))),
        ("UserRole", F.coalesce(role, F.lit("ANONYMOUS"))),
        ("LatencyBucket", latency_bucket(duration_ms)),
    ]
    return F.concat_ws(", ", *[F.concat(F.lit(f"{name}: "), value) for name, value in parts])


def service_display(service: Column) -> Column:
    return lookup(service, SERVICE_DISPLAY, service)


def route_display(route: Column) -> Column:
    path = F.regexp_replace(route, r"(?i)^(GET|POST|PUT|DELETE|PATCH)\s+", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.element_at(segments, -1)
    return F.when(F.size(segments) > 1, lookup(last, ROUTE_DISPLAY, last)).otherwise(
        F.coalesce(F.nullif(path, F.lit("")), route)
    )


def role_display(role: Column) -> Column:
    return lookup(role, ROLE_DISPLAY, F.lower(role))


def error_description(code: Column) -> Column:
    return lookup(code, ERROR_DISPLAY, F.lower(F.replace(code, F.lit("_"), F.lit(" "))))


def narrative(
    service: Column, route: Column, code: Column, message: Column, role: Column, duration_ms: Column
) -> Column:
    who = role_display(F.coalesce(role, F.lit("ANONYMOUS")))
    svc, rt, why = service_display(service), route_display(route), error_description(code)
    state = outcome(code, duration_ms)
    failure = F.concat(
        F.lit("A "), who, F.lit(" user experienced a "), svc, F.lit(" failure during "), rt
    )
    # The text "NONE" stands for an absent code or message.
    has_code = code.isNotNull() & (code != "NONE")
    has_message = message.isNotNull() & (message != "NONE")
    reason = F.concat(F.lit(" due to "), why)
    return (
        F.when(
            state == "FAILED",
            F.concat(
                failure,
                F.when(has_code & has_message, F.concat(reason, F.lit(": "), message))
                .when(has_code, reason)
                .otherwise(""),
                F.lit("."),
            ),
        )
        .when(
            state == "WARNING",
            F.concat(
                F.lit("A "), who, F.lit(" user encountered slow performance during "),
                svc, F.lit(" "), rt, F.lit("."),
            ),
        )
        .when(
            state == "EDGE_CASE",
            F.concat(
                F.lit("An edge case occurred for a "), who, F.lit(" user during "),
                svc, F.lit(" "), rt, F.lit("."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("A "), who, F.lit(" user successfully completed "),
                svc, F.lit(" "), rt, F.lit("."),
            )
        )
    )


def event_args() -> dict[str, Column]:
    """Arguments of the summary functions, taken from the nested event columns."""
    return {
        "service": F.col("service"),
        "route": F.col("route"),
        "code": F.col("error.code"),
        "message": F.col("error.message"),
        "role": F.col("user.role"),
        "duration_ms": F.col("performance.durationMs"),
    }


def dual_layer_summary(**args: Column) -> Column:
    """Narrative sentence, blank line, canonical line: the text that is embedded."""
    return F.concat(narrative(**args), F.lit("\n\n"), canonical_summary(**args))
