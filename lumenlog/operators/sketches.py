"""Latency percentiles from stored sketches: a row per minute and route, merged to any longer span.

A day's percentile then reads its minutes, not its requests, and a minute is never read again. The
sketches are KLL sketches with ``SKETCH_K`` items a level: a quantile's rank is off by about 0.35 % of the
requests at most, whatever the number of merges, and exact as long as all of them fit in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 800
RANK_ERROR = 0.0035
BY = ("service", "route")


def minute_sketches(events: DataFrame, by: Sequence[str] = BY, window: str = "1 minute", k: int = SKETCH_K) -> DataFrame:
    """One row per window and group: requests, errors, timed requests, slowest one, and the sketch; batch and streaming.

    Requests without a duration count but are in no sketch; a group without any has none. Rows without a time are
    left out, as a window has to hold them.
    """
    took = F.col("performance.durationMs").cast("bigint")
    return (
        events.groupBy(F.window("timestamp", window), *by)
        .agg(
            F.count("*").alias("requests"),
            F.count("error.code").alias("errors"),
            F.count(took).alias("timed"),
            F.max(took).alias("maxMs"),
            F.when(F.count(took) > 0, F.kll_sketch_agg_bigint(took, k)).alias("sketch"),
        )
        .select(F.col("window.start").alias("start"), *by, "requests", "errors", "timed", "maxMs", "sketch")
    )


def append_sketches(sketches: DataFrame, path: str) -> None:
    """Append rows of closed windows to the stored table, by day; several rows of one window and group add up."""
    sketches.withColumn("day", F.to_date("start")).write.mode("append").partitionBy("day").parquet(path)


def rolled_up(sketches: DataFrame, unit: str, by: Sequence[str] = BY, k: int = SKETCH_K) -> DataFrame:
    """The rows of a span (``hour``, ``day``, ``week``, ...) as one per group, in the same shape."""
    return (
        sketches.groupBy(F.date_trunc(unit, "start").alias("start"), *by)
        .agg(
            F.sum("requests").alias("requests"),
            F.sum("errors").alias("errors"),
            F.sum("timed").alias("timed"),
            F.max("maxMs").alias("maxMs"),
            F.when(F.sum("timed") > 0, F.kll_merge_agg_bigint("sketch", k)).alias("sketch"),
        )
    )


def quantile(sketch: Column, p: float) -> Column:
    """The value at share ``p`` of a sketch; null without one. Shares 0 and 1 are the exact ends."""
    return F.when(sketch.isNotNull(), F.kll_sketch_get_quantile_bigint(sketch, F.lit(float(p))))


def sketched_percentiles(sketches: DataFrame, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles, as ``p50`` and so on, beside the counts; the sketch goes."""
    named = {f"p{100 * p:g}".replace(".", "_"): quantile(F.col("sketch"), p) for p in shares}
    return sketches.withColumns(named).drop("sketch")


def share_above(sketches: DataFrame, limit_ms: int) -> DataFrame:
    """The share of timed requests above a limit, for service levels; null without any."""
    above = F.when(F.col("sketch").isNotNull(), 1 - F.kll_sketch_get_rank_bigint("sketch", F.lit(limit_ms).cast("bigint")))
    return sketches.withColumn("shareAbove", above).drop("sketch")
