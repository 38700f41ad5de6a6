"""Building one wide event per request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions import events as ev


def assemble(fragments: DataFrame, fields: Sequence[str], first_fields: Sequence[str] = ("event_ts",), key: str = "request_id", seq: str = "seq") -> DataFrame:
    """Fold context fragments: last non-null value per field, first for ``first_fields``.

    ``max_by`` ignores rows whose ordering is null, so a null field never wins.
    Partial aggregation folds a hot request inside each map task.
    """
    def ordered(name):
        return F.when(F.col(name).isNotNull(), F.col(seq))

    return fragments.groupBy(key).agg(
        *[F.min_by(f, ordered(f)).alias(f) for f in first_fields],
        *[F.max_by(f, ordered(f)).alias(f) for f in fields],
    )


def merge_metadata(fragments: DataFrame, metadata: str = "metadata", key: str = "request_id", seq: str = "seq") -> DataFrame:
    """Merge per-fragment ``map<string,string>`` bags key by key, later fragments winning.

    A map value of null still overwrites: the ordering, not the value, decides.
    """
    entries = fragments.select(key, seq, F.explode(metadata).alias("_k", "_v"))
    last = entries.groupBy(key, "_k").agg(F.max_by(F.struct("_v"), seq).alias("_e"))
    return last.groupBy(key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("_k"), F.col("_e._v"))))).alias(metadata)
    )


def project_event(ctx: DataFrame) -> DataFrame:
    """Working context to immutable event: metadata and summary dropped, empty structs null."""
    return ctx.select(
        F.col("requestId"),
        F.col("timestamp"),
        F.col("service"),
        F.col("route"),
        ev.user_struct(F.col("user.id"), F.col("user.role")).alias("user"),
        ev.error_struct(F.col("error.code"), F.col("error.message")).alias("error"),
        ev.performance_struct(F.col("performance.durationMs")).alias("performance"),
    )


def iso_timestamp(value: Column) -> Column:
    """ISO text (milliseconds, Z) of a timestamp."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_timestamp(value: Column) -> Column:
    """Timestamp from ISO text or a timestamp; null where the text is no time."""
    return F.try_to_timestamp(value.cast("string"))


def attach_sampling_hint(df: DataFrame, hints: dict[str, str]) -> DataFrame:
    """``_samplingHint`` of each route; null where the route has none.

    Route policies come from code annotations: a short literal list, so the
    look-up is an expression and needs no join.
    """
    return df.withColumn("_samplingHint", ev.lookup(F.col("route"), hints, F.lit(None).cast("string")))


def exclude_routes(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop events of excluded routes (table with a ``route`` column)."""
    return df.join(excluded.select("route").distinct(), "route", "left_anti")


def finalize_once(df: DataFrame, order: Sequence[str], key: str = "requestId") -> DataFrame:
    """First row per request, whole row kept; copies fold inside the map tasks.

    Rows without a key are no copies: all stay. They are grouped by all their columns and counted, so that the input
    is read once and a repeated row costs one row per task.
    """
    row, keyless = F.struct(*df.columns), F.col(key).isNull()
    first = df.groupBy(key, F.when(keyless, row).alias("_same")).agg(F.min_by(row, F.struct(*order)).alias("_row"), F.count("*").alias("_n"))
    rows = F.when(keyless, F.array_repeat("_row", F.col("_n").cast("int"))).otherwise(F.array("_row"))
    return first.select(F.explode(rows).alias("_row")).select("_row.*")


def duration_ms(started: Column, ended: Column) -> Column:
    return F.unix_millis(ended) - F.unix_millis(started)


def attributed_service(service: Column, raw_response: Column) -> Column:
    """Service of the failing step, read from the raw error body."""
    failing = F.get_json_object(raw_response, "$.errorService")
    return F.coalesce(F.nullif(failing, F.lit("")), service)


def request_id(header: Column, *identity: Column) -> Column:
    """Header id, else a deterministic id of the row, so a rerun agrees."""
    text = F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in identity])
    return F.coalesce(F.nullif(header, F.lit("")), F.sha2(text, 256))


def service_name(*candidates: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit("backend"))


# --- fixed values: status code, message, severity, service step -----------------
STATUSES = [
    ("SUCCESS", "Payment processed successfully.", "NORMAL", "payments"),
    ("SLOW_GATEWAY_SUCCESS", "Payment gateway responded slowly but transaction completed successfully.", "WARN", "paymentGateway"),
    ("SLOW_ORDER_SUCCESS", "Order confirmation was slow but completed successfully.", "WARN", "orders"),
    ("INSUFFICIENT_BALANCE", "User does not have sufficient balance for this transaction.", "ERROR", "payments"),
    ("INSUFFICIENT_FUNDS", "The user has insufficient funds in their account to complete this transaction.", "ERROR", "paymentGateway"),
    ("GATEWAY_REJECTED", "The external payment gateway rejected the request due to invalid parameters or bank policy.", "ERROR", "paymentGateway"),
    ("GATEWAY_TIMEOUT", "The connection to the payment gateway timed out. Please try again later.", "ERROR", "paymentGateway"),
    ("GATEWAY_ERROR", "An unexpected error occurred while communicating with the payment gateway.", "ERROR", "paymentGateway"),
    ("CARD_EXPIRED", "The provided payment method has expired and cannot be processed.", "ERROR", "paymentGateway"),
    ("FRAUD_DETECTION", "Transaction flagged by the automated fraud detection system for manual review.", "ERROR", "paymentGateway"),
    ("MAINTENANCE_WINDOW", "The payment system is currently undergoing scheduled maintenance.", "ERROR", "paymentGateway"),
    ("ACCOUNT_LOCKED", "The user account is currently locked due to multiple failed login attempts or security concerns.", "ERROR", "paymentGateway"),
    ("ORDER_CONFIRMATION_FAILED", "Failed to confirm order. The order service is temporarily unavailable.", "ERROR", "orders"),
    ("ORDER_ERROR", "An unexpected error occurred in the order service.", "ERROR", "orders"),
]
# --- end of fixed values ----------------------------------------------------------


def status_table(spark) -> DataFrame:
    return spark.createDataFrame(STATUSES, "code string, message string, severity string, service string")


def with_status(df: DataFrame, code: Column, statuses: DataFrame) -> DataFrame:
    """Status columns of ``code``; a code outside the dimension is an error of unknown step.

    The dimension of :func:`status_table` is a local list, which Spark broadcasts.
    """
    dim = statuses.select(
        F.col("code").alias("_status"),
        F.col("message").alias("statusMessage"),
        F.col("severity").alias("_severity"),
        F.col("service").alias("statusService"),
    )
    joined = df.withColumn("_code", code).join(dim, F.col("_code") == F.col("_status"), "left")
    severity = F.when(F.col("_code").isNotNull(), F.coalesce("_severity", F.lit("ERROR")))
    return (
        joined.withColumn("severity", severity)
        .withColumn("isError", F.col("severity") == "ERROR")
        .withColumn("isSlow", F.col("severity") == "WARN")
        .withColumn("isSuccess", F.col("severity") == "NORMAL")
        .drop("_status", "_severity", "_code")
    )


def unknown_statuses(df: DataFrame, code: Column, statuses: DataFrame) -> DataFrame:
    """Codes missing from the dimension, with their counts."""
    seen = df.select(code.alias("code")).filter("code is not null").groupBy("code").agg(F.count("*").alias("n"))
    return seen.join(statuses.select("code"), "code", "left_anti")


def failure_http_status(code: Column) -> Column:
    return F.when(code == "GATEWAY_TIMEOUT", 500).otherwise(400)
