"""Explainable tail sampling. Errors and slow requests are always kept."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.plans.timelines import time_bucket

HASH_SPACE = 10_000


@dataclass(frozen=True)
class SamplingPolicy:
    normal_rate: float = 0.01
    slow_threshold_ms: int = 2000
    critical_routes: Sequence[str] = field(default_factory=tuple)
    # "exact" compares the canonical route, "path" ignores its method.
    match: str = "exact"

    @classmethod
    def from_env(cls, env: dict[str, str]) -> "SamplingPolicy":
        """Settings from environment-style strings; unparseable values keep the default."""

        def number(key, cast, default):
            try:
                return cast(env[key])
            except (KeyError, ValueError):
                return default

        routes = [r.strip() for r in env.get("LOG_CRITICAL_ROUTES", "").split(",")]
        return cls(
            normal_rate=number("LOG_SAMPLING_NORMAL_RATE", float, cls.normal_rate),
            slow_threshold_ms=number("LOG_SLOW_THRESHOLD_MS", int, cls.slow_threshold_ms),
            critical_routes=tuple(r for r in routes if r),
        )


def hash_bucket(key: Column) -> Column:
    """Stable bucket in ``[0, 10000)`` from the first 32 bits of the md5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(HASH_SPACE))


def is_sampled(key: Column, rate: Column | float) -> Column:
    """True for a fixed share of keys; a rerun picks the same ones."""
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return hash_bucket(key) < r * F.lit(float(HASH_SPACE))


def is_critical(route: Column, policy: SamplingPolicy) -> Column:
    if not policy.critical_routes:
        return F.lit(False)
    name = F.substring_index(route, " ", -1) if policy.match == "path" else route
    return name.isin(list(policy.critical_routes))


def sampling_reason(policy: SamplingPolicy, rate: Column | None = None) -> Column:
    """First rule that applies; ``rate`` overrides the normal rate per row."""
    return (
        F.when(F.col("error").isNotNull(), "HAS_ERROR")
        .when(F.col("performance.durationMs") > policy.slow_threshold_ms, "SLOW_REQUEST")
        .when(is_critical(F.col("route"), policy), "CRITICAL_ROUTE")
        .when(is_sampled(F.col("requestId"), policy.normal_rate if rate is None else rate), "SAMPLED_NORMAL")
        .otherwise("NOT_SAMPLED")
    )


def decide(df: DataFrame, policy: SamplingPolicy, rate: Column | None = None) -> DataFrame:
    reason = sampling_reason(policy, rate)
    return df.withColumn("reason", reason).withColumn("shouldRecord", F.col("reason") != "NOT_SAMPLED")


def sample_with_audit(df: DataFrame, policy: SamplingPolicy, rate: Column | None = None) -> DataFrame:
    """Recorded rows only, tagged ``_sampling{recorded, reason}``."""
    return (
        decide(df, policy, rate)
        .filter("shouldRecord")
        .withColumn("_sampling", F.struct(F.lit(True).alias("recorded"), F.col("reason").alias("reason")))
        .drop("reason", "shouldRecord")
    )


def retention_report(df: DataFrame, policy: SamplingPolicy) -> DataFrame:
    """One row: kept against total, retention of errors and slow rows, volume reduction in percent."""
    slow = F.col("performance.durationMs") > policy.slow_threshold_ms
    err = F.col("error").isNotNull()
    kept = F.col("shouldRecord")
    return (
        decide(df, policy)
        .agg(
            F.count("*").alias("total"),
            F.count_if(kept).alias("kept"),
            F.count_if(err).alias("errors"),
            F.count_if(err & kept).alias("errorsKept"),
            F.count_if(slow).alias("slow"),
            F.count_if(slow & kept).alias("slowKept"),
        )
        .filter("total > 0")
        .withColumn("reductionPct", (F.col("total") - F.col("kept")) * 100.0 / F.col("total"))
    )


def reason_counts(df: DataFrame, policy: SamplingPolicy) -> DataFrame:
    return decide(df, policy).groupBy("reason").agg(F.count("*").alias("n"))


# Multiples of the normal rate; a critical route is always kept.
HINT_FACTORS = {"important": 10.0, "normal": 1.0, "low": 0.1}


def hint_rate(hint: Column, base: float, factors: dict[str, float] = HINT_FACTORS) -> Column:
    """Per-row normal rate from a route's sampling hint, never above 1."""
    rate = F.when(hint == "critical", F.lit(1.0))
    for name, factor in factors.items():
        rate = rate.when(hint == name, F.lit(min(1.0, base * factor)))
    return rate.otherwise(F.lit(float(base)))


RATE_SALTS = 32


def adaptive_rates(
    df: DataFrame, bucket_seconds: int, spike_factor: float, normal_rate: float, spike_rate: float
) -> DataFrame:
    """Rate per time bucket: lowered where the volume exceeds ``spike_factor`` times the mean. Rows without a time are in no bucket.

    Two aggregations; the second runs over one row per bucket.
    """
    volume = df.filter(F.col("timestamp").isNotNull()).groupBy(time_bucket(F.col("timestamp"), bucket_seconds).alias("bucket")).agg(
        F.count("*").alias("volume")
    )
    mean = volume.agg((F.sum("volume") / F.count("*")).alias("mean")).scalar()
    return volume.select(
        "bucket",
        "volume",
        F.when(F.col("volume") > mean * spike_factor, F.lit(spike_rate))
        .otherwise(F.lit(normal_rate))
        .alias("rate"),
    )


def decide_adaptive(
    df: DataFrame,
    policy: SamplingPolicy,
    bucket_seconds: int = 3600,
    spike_factor: float = 2.0,
    spike_rate: float = 0.001,
) -> DataFrame:
    """Sampling decision with a load-dependent normal rate; events without a time take the normal one.

    A spike puts most rows into one bucket, so each bucket's rate is repeated for a few salts and
    the rows of a bucket are spread over them by request id.
    """
    rates = adaptive_rates(df, bucket_seconds, spike_factor, policy.normal_rate, spike_rate)
    salts = F.explode(F.sequence(F.lit(0), F.lit(RATE_SALTS - 1))).alias("_salt")
    placed = df.withColumn("bucket", time_bucket(F.col("timestamp"), bucket_seconds)).withColumn(
        "_salt", F.pmod(F.xxhash64("requestId"), F.lit(RATE_SALTS)).cast("int")
    )
    rated = placed.join(rates.select("bucket", "rate", salts), ["bucket", "_salt"], "left").drop("_salt")
    rated = rated.withColumn("rate", F.coalesce("rate", F.lit(float(policy.normal_rate))))
    return decide(rated, policy, F.col("rate"))


def embedding_selection(policy_rate: float = 0.1) -> Column:
    """Why an event is embedded: every error, every premium user, a share of the rest."""
    return (
        F.when(F.col("error").isNotNull(), "ERROR")
        .when(F.col("user.role") == "premium", "PREMIUM")
        .when(is_sampled(F.col("requestId"), policy_rate), "SAMPLED")
        .otherwise("SKIP")
    )
