"""Metric templates over wide events and their registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.operators.filters import QueryMetadata, match
from lumenlog.plans.ranks import first_n_per_group, floor_rank_percentiles

DEFAULT_TOP_N = 5
MAX_BROADCAST_CODES = 10_000
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@dataclass(frozen=True)
class MetricParams:
    metadata: QueryMetadata = field(default_factory=QueryMetadata)
    top_n: int = DEFAULT_TOP_N
    compat: bool = False


def _errors(df: DataFrame, params: MetricParams) -> DataFrame:
    return df.filter(match(params.metadata, F.col("error.code").isNotNull(), params.compat))


def top_error_codes(df: DataFrame, params: MetricParams = MetricParams(), examples: int = 3) -> DataFrame:
    """Most frequent codes with their earliest examples.

    At most ``top_n`` codes survive the first aggregation; up to ``MAX_BROADCAST_CODES``
    that side is broadcast. Examples are ranked before they are collected.
    """
    rows = _errors(df, params)
    top = (
        rows.groupBy(F.col("error.code").alias("errorCode"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_first("errorCode"))
        .limit(params.top_n)
    )
    slim = rows.select(
        F.col("error.code").alias("errorCode"),
        "requestId",
        "timestamp",
        "service",
        "route",
        F.col("error.message").alias("errorMessage"),
    )
    t = top.select(F.col("errorCode").alias("_code"), "count")
    small = F.broadcast(t) if params.top_n <= MAX_BROADCAST_CODES else t
    hits = slim.join(small, F.col("errorCode").eqNullSafe(F.col("_code"))).drop("_code")
    ranked = first_n_per_group(hits, ["errorCode"], [F.col("timestamp"), F.col("requestId")], examples)
    fields = ["rank", "requestId", "timestamp", "service", "route", "errorMessage"]
    return ranked.groupBy("errorCode", "count").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(*fields))),
            lambda e: F.struct(*[e[f].alias(f) for f in fields[1:]]),
        ).alias("examples")
    )


def error_distribution_by_route(df: DataFrame, params: MetricParams = MetricParams()) -> DataFrame:
    return (
        _errors(df, params)
        .groupBy("route")
        .agg(F.count("*").alias("count"), F.sort_array(F.collect_set("error.code")).alias("errorCodes"))
        .orderBy(F.desc("count"), "route")
        .limit(params.top_n)
    )


def error_by_service(df: DataFrame, params: MetricParams = MetricParams(), top_codes: int = 0) -> DataFrame:
    """Errors per service; ``topErrorCodes`` is empty unless ``top_codes`` asks for it."""
    rows = _errors(df, params)
    if top_codes <= 0:
        counts = rows.groupBy("service").agg(F.count("*").alias("count"))
        return counts.withColumn("topErrorCodes", F.array().cast("array<string>")).orderBy(F.desc("count"), "service")
    pairs = rows.groupBy("service", F.col("error.code").alias("code")).agg(F.count("*").alias("n"))
    by_service = Window.partitionBy("service")
    ranked = pairs.select(
        "service",
        "code",
        F.sum("n").over(by_service).alias("count"),
        F.row_number().over(by_service.orderBy(F.desc("n"), "code")).alias("rank"),
    )
    return (
        ranked.groupBy("service", "count")
        .agg(
            F.sort_array(
                F.collect_list(F.when(F.col("rank") <= top_codes, F.struct("rank", "code")))
            ).alias("top")
        )
        .select("service", "count", F.col("top.code").alias("topErrorCodes"))
        .orderBy(F.desc("count"), "service")
    )


def latency_percentile(df: DataFrame, params: MetricParams = MetricParams(), by: tuple[str, ...] = ()) -> DataFrame:
    rows = df.filter(match(params.metadata, F.col("performance.durationMs").isNotNull(), params.compat))
    slim = rows.select(*by, F.col("performance.durationMs").alias("durationMs"))
    return floor_rank_percentiles(slim, "durationMs", PERCENTILES, by)


def error_rate(df: DataFrame, params: MetricParams = MetricParams(), by: tuple[str, ...] = ()) -> DataFrame:
    """Errors in percent of all requests; no row when nothing matches."""
    rows = df.filter(match(params.metadata, compat=params.compat))
    return (
        rows.groupBy(*by)
        .agg(F.count("*").alias("totalCount"), F.count("error.code").alias("errorCount"))
        .filter("totalCount > 0")
        .withColumn("errorRate", F.col("errorCount") * 100.0 / F.col("totalCount"))
    )


def approx_latency_by_route(df: DataFrame, p: float = 0.95, accuracy: int = 10_000) -> DataFrame:
    """Mergeable approximate percentile per route: one shuffle of small sketches."""
    return (
        df.filter(F.col("performance.durationMs").isNotNull())
        .groupBy("route")
        .agg(F.percentile_approx("performance.durationMs", p, accuracy).alias("p95"), F.count("*").alias("count"))
    )


MetricFn = Callable[[DataFrame, MetricParams], DataFrame]

METRICS: dict[str, MetricFn] = {
    "TOP_ERROR_CODES": top_error_codes,
    "ERROR_DISTRIBUTION_BY_ROUTE": error_distribution_by_route,
    "ERROR_BY_SERVICE": error_by_service,
    "LATENCY_PERCENTILE": latency_percentile,
    "ERROR_RATE": error_rate,
}


def register_metric(metric_id: str, fn: MetricFn) -> None:
    METRICS[metric_id] = fn


def run_metric(df: DataFrame, metric_id: str, params: MetricParams = MetricParams()) -> DataFrame:
    if metric_id not in METRICS:
        raise KeyError(f"unknown metric template: {metric_id}")
    return METRICS[metric_id](df, params)
