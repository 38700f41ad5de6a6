"""Query metadata and the predicates built from it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QueryMetadata:
    """What a question asks about. ``None`` means no constraint."""

    start_time: str | None = None
    end_time: str | None = None
    service: str | None = None
    route: str | None = None
    error_code: str | None = None
    has_error: bool | None = None


def _ts(value: str) -> Column:
    return F.lit(value).cast("timestamp")


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def match(metadata: QueryMetadata, base: Column | None = None, compat: bool = False) -> Column:
    """Conjunction of all constraints and ``base``.

    With ``compat`` the constraints on the error code overwrite each other instead:
    ``has_error`` beats ``error_code``, which beats ``base``.
    """
    code = F.col("error.code")
    parts = []
    if metadata.start_time:
        parts.append(F.col("timestamp") >= _ts(metadata.start_time))
    if metadata.end_time:
        parts.append(F.col("timestamp") <= _ts(metadata.end_time))
    if metadata.service:
        parts.append(F.col("service") == metadata.service)
    if metadata.route:
        parts.append(F.col("route") == metadata.route)
    on_code = [] if base is None else [base]
    if metadata.error_code:
        on_code.append(code == metadata.error_code)
    if metadata.has_error is not None:
        on_code.append(code.isNotNull() if metadata.has_error else code.isNull())
    if compat:
        on_code = on_code[-1:]
    return _all(parts + on_code)


def apply_metadata(df: DataFrame, metadata: QueryMetadata, compat: bool = False) -> DataFrame:
    return df.filter(match(metadata, compat=compat))


def vector_prefilter(df: DataFrame, metadata: QueryMetadata, with_service: bool = True) -> DataFrame:
    """Constraints applied before the top-k: time range and service only."""
    keep = QueryMetadata(
        start_time=metadata.start_time,
        end_time=metadata.end_time,
        service=metadata.service if with_service else None,
    )
    return df.filter(match(keep))


def grounding_postfilter(df: DataFrame, metadata: QueryMetadata) -> DataFrame:
    """Constraints applied to fetched events after the top-k; may return fewer rows."""
    parts = []
    if metadata.has_error:
        parts.append(F.col("error").isNotNull())
    if metadata.error_code:
        parts.append(F.col("error.code") == metadata.error_code)
    return df.filter(_all(parts))


def after_mark(ts: Column, key: Column, mark_ts, mark_id) -> Column:
    """Keyset predicate of the embedding high-water mark."""
    embeddable = F.col("_summary").isNotNull() & (F.col("_summary") != "")
    if mark_ts is None:
        return embeddable
    mark = F.lit(mark_ts).cast("timestamp")
    return embeddable & ((ts > mark) | ((ts == mark) & (key > F.lit(mark_id))))


def pending_page(
    df: DataFrame, mark_ts=None, mark_id=None, limit: int | None = None
) -> DataFrame:
    """Events behind the mark in (timestamp, eventId) order, at most ``limit`` when given."""
    rows = df.filter(after_mark(F.col("timestamp"), F.col("eventId"), mark_ts, mark_id))
    if limit is None:
        return rows
    return rows.orderBy("timestamp", "eventId").limit(limit)


def users_impacted(df: DataFrame, error_code: str) -> DataFrame:
    return (
        df.filter((F.col("error.code") == error_code) & F.col("user.id").isNotNull())
        .groupBy(F.col("user.id").alias("userId"))
        .agg(
            F.count("*").alias("events"),
            F.min("timestamp").alias("firstSeen"),
            F.max("timestamp").alias("lastSeen"),
        )
    )


def event_by_user(df: DataFrame, user_id: str) -> DataFrame:
    return df.filter(F.col("user.id") == user_id).orderBy("timestamp", "requestId").limit(1)
