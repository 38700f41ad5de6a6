"""Audits and service reports: one grouped pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.plans.timelines import running_total


def record_counts(df: DataFrame, slow_threshold_ms: int = 2000) -> DataFrame:
    """Total, errors, slow rows and rows with metadata, in one pass."""
    return df.agg(
        F.count("*").alias("total"),
        F.count("error").alias("errors"),
        F.count_if(F.col("performance.durationMs") > slow_threshold_ms).alias("slow"),
        F.count("_metadata").alias("withMetadata"),
    )


def distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("service", "route").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "service", "route")


def distribution_rollup(df: DataFrame) -> DataFrame:
    """As :func:`distribution` with subtotals per service and a grand total (null keys)."""
    return df.rollup("service", "route").agg(F.count("*").alias("count"))


def latest_events(df: DataFrame, reason: Column, n: int = 5) -> DataFrame:
    return (
        df.orderBy(F.desc("timestamp"), "requestId")
        .limit(n)
        .select(
            "timestamp",
            "requestId",
            "service",
            "route",
            F.when(F.col("error").isNotNull(), "FAIL").otherwise("OK").alias("status"),
            F.coalesce(reason, F.lit("N/A")).alias("reason"),
        )
    )


def delivery_health(
    outcomes: DataFrame,
    by: Sequence[Column | str] = (),
    min_samples: int = 10,
    warn_samples: int = 100,
    max_failure_rate: float = 0.05,
) -> DataFrame:
    """Health of a delivery log with columns ``at``, ``id``, ``error`` (null = delivered).

    Too few samples count as healthy; with none the success rate is 100.
    """
    failed = F.count("error")
    total = F.count("*")
    out = outcomes.groupBy(*by).agg(
        (total - failed).alias("successCount"),
        failed.alias("failureCount"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("at", "id"))).alias("lastError"),
        F.max(F.when(F.col("error").isNotNull(), F.col("at"))).alias("lastErrorTime"),
    )
    n = F.col("successCount") + F.col("failureCount")
    rate = F.col("failureCount") / F.nullif(n, F.lit(0))
    success_pct = F.coalesce(F.col("successCount") * 100.0 / F.nullif(n, F.lit(0)), F.lit(100.0))
    too_many = F.coalesce(rate > max_failure_rate, F.lit(False))
    return (
        out.withColumn("successRate", F.floor(success_pct * 100 + 0.5) / 100.0)
        .withColumn("healthy", (n < min_samples) | ~too_many)
        .withColumn("warn", (n >= warn_samples) & too_many)
    )


def embedding_progress(events: DataFrame, embedded: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """Totals, rows still to embed (by anti-join, not by subtraction) and the mark."""
    e = events.select("eventId", F.lit(1).alias("_e"))
    d = embedded.select("eventId").distinct().withColumn("_d", F.lit(1))
    both = e.join(d, "eventId", "left")
    report = both.agg(
        F.count("*").alias("total"),
        F.count("_d").alias("embedded"),
        F.count_if(F.col("_d").isNull()).alias("pending"),
    )
    if progress is not None:
        for name in ("lastEmbeddedEventId", "lastEmbeddedEventTimestamp"):
            report = report.withColumn(name, progress.agg(F.max_by(name, "lastUpdatedAt")).scalar())
    return report


def cache_stats(entries: DataFrame, now: Column) -> DataFrame:
    """Entries of a result cache, live and expired at ``now``."""
    expired = F.unix_millis(now) - F.unix_millis("cachedAt") > F.col("ttlMs")
    return entries.agg(
        F.count("*").alias("totalEntries"),
        F.count_if(expired).alias("expiredEntries"),
        F.count_if(~expired).alias("activeEntries"),
    )


def session_stats(history: DataFrame, now: Column, ttl_seconds: int = 1800) -> DataFrame:
    """Sessions whose last turn is within the TTL at ``now``, and their messages."""
    per = history.groupBy("sessionId").agg(F.max("createdAt").alias("last"), F.count("*").alias("n"))
    age = F.unix_millis(now) - F.unix_millis("last")
    return per.filter((age >= 0) & (age <= ttl_seconds * 1000)).agg(
        F.count("*").alias("activeSessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("totalMessages")
    )


def concurrency(requests: DataFrame, started: str, ended: str, max_pending: int = 500) -> DataFrame:
    """Requests in flight when each request starts, itself included, and whether that is above the limit.

    A +1/-1 event stream and a bucketed running sum; an end at the same instant
    frees its slot first. A request without an end stays in flight; one without a
    start has no place in the sum: its ``inFlight`` is null and it is not over.
    """
    slim = requests.select("requestId", F.col(started).cast("timestamp").alias(started), F.col(ended).cast("timestamp").alias(ended))
    known = F.col(started).isNotNull()
    steps = slim.filter(known).select(
        F.posexplode(F.array(F.unix_micros(ended), F.unix_micros(started))).alias("kind", "at"),
        "requestId",
    ).filter("at IS NOT NULL").withColumn("delta", F.when(F.col("kind") == 0, -1).otherwise(1))
    total = running_total(
        steps,
        [],
        "at",
        [F.col("at"), F.col("kind"), F.col("requestId")],
        "delta",
        # tenths of a second, so that a spike is spread, then hours: 36 000 buckets each, and 8 760 hours a year
        [100_000, 3_600_000_000],
        "inFlight",
    )
    placed = total.filter("kind = 1").select("requestId", F.timestamp_micros("at").alias("startedAt"), "inFlight")
    lost = slim.filter(~known).select("requestId", F.col(started).alias("startedAt"), F.lit(None).cast("bigint").alias("inFlight"))
    over = F.coalesce(F.col("inFlight") > max_pending, F.lit(False)).alias("overLimit")
    return placed.unionByName(lost).select("requestId", "startedAt", "inFlight", over)


def backpressure_report(requests: DataFrame, started: str, ended: str, max_pending: int = 500) -> DataFrame:
    return concurrency(requests, started, ended, max_pending).agg(
        F.count("*").alias("requests"),
        F.count_if("overLimit").alias("dropped"),
        F.count_if(~F.col("overLimit")).alias("accepted"),
        F.max("inFlight").alias("peak"),
    )


def batch_token_share(texts: DataFrame, batch: str, tokens: str) -> DataFrame:
    """Tokens billed per batch and the even share of each of its texts."""
    return (
        texts.groupBy(batch)
        .agg(F.count("*").alias("texts"), F.sum(tokens).alias("totalTokens"))
        .withColumn("tokensPerText", F.col("totalTokens") / F.col("texts"))
    )


def usage_report(usage: DataFrame, by: Sequence[str] = ("model", "templateType", "day")) -> DataFrame:
    """Cost, tokens and response time of prompt calls."""
    return usage.groupBy(*by).agg(
        F.count("*").alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.avg("responseTimeMs").alias("avgResponseTimeMs"),
    )
