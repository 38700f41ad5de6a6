"""Incidents, windowed metrics and the daily briefing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.operators.metrics import MetricParams, top_error_codes
from lumenlog.plans.intervals import interval_join, merge_overlapping
from lumenlog.plans.ranks import first_n_per_group

INCIDENT = ["service", "route", "errorCode"]
SEVERITIES = ((4, "critical"), (2, "major"))  # least ratio of the fullest window to the threshold; else minor


def windowed_errors(df: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Errors per sliding window and (service, route, code); batch and streaming."""
    return (
        df.filter(F.col("error.code").isNotNull())
        .groupBy(
            F.window("timestamp", window, slide), "service", "route", F.col("error.code").alias("errorCode")
        )
        .agg(F.count("*").alias("errors"))
        .select("window", "service", "route", "errorCode", "errors")
    )


def incidents(df: DataFrame, window: str = "5 minutes", slide: str = "1 minute", threshold: int = 10) -> DataFrame:
    return (
        windowed_errors(df, window, slide)
        .filter(F.col("errors") > threshold)
        .select(
            F.col("window.start").alias("windowStart"),
            F.col("window.end").alias("windowEnd"),
            "service",
            "route",
            "errorCode",
            "errors",
        )
    )


def incident_stretches(windows: DataFrame, threshold: int = 10) -> DataFrame:
    """Windows of :func:`incidents` that overlap or touch, as one incident each.

    ``windows`` counts them, ``peakErrors`` is the fullest one's count. A key has one window per slide of time at
    most, however many events there are.
    """
    merged = merge_overlapping(
        windows, INCIDENT, "windowStart", "windowEnd", windows=F.count("*"), peakErrors=F.max("errors")
    ).withColumnsRenamed({"windowStart": "startedAt", "windowEnd": "endedAt"})
    severity = F.lit("minor")
    for ratio, name in reversed(SEVERITIES):
        severity = F.when(F.col("peakErrors") >= ratio * threshold, name).otherwise(severity)
    started = F.date_format("startedAt", "yyyy-MM-dd'T'HH:mm")
    name = F.concat_ws("|", F.coalesce("service", F.lit("-")), F.coalesce("route", F.lit("-")), "errorCode", started)
    return merged.withColumn("severity", severity).withColumn("incidentId", name)


def incident_events(df: DataFrame, stretches: DataFrame, cell_seconds: int = 3600) -> DataFrame:
    """The requests to an incident's route while it lasted: the event columns and the incident's.

    ``failed`` marks the requests that failed with the incident's code.
    """
    events = df.withColumn("_code", F.col("error.code"))
    met = interval_join(events, stretches, ["service", "route"], "timestamp", "startedAt", "endedAt", cell_seconds)
    return met.withColumn("failed", F.coalesce(F.col("_code") == F.col("errorCode"), F.lit(False))).drop("_code")


def incident_impact(df: DataFrame, stretches: DataFrame, cell_seconds: int = 3600, traces: int = 3) -> DataFrame:
    """Per incident: requests, failures, their share, users hit, first and last failure, and the first request ids."""
    met = incident_events(df, stretches, cell_seconds).select(
        "incidentId", "failed", "timestamp", "requestId", F.col("user.id").alias("userId")
    )
    failed = F.col("failed")
    totals = met.groupBy("incidentId").agg(
        F.count("*").alias("requests"),
        F.count_if(failed).alias("errors"),
        F.count_distinct(F.when(failed, F.col("userId"))).alias("users"),
        F.min(F.when(failed, F.col("timestamp"))).alias("firstAt"),
        F.max(F.when(failed, F.col("timestamp"))).alias("lastAt"),
    )
    first = first_n_per_group(met.where(failed), ["incidentId"], [F.col("timestamp"), F.col("requestId")], traces, "_no")
    related = first.groupBy("incidentId").agg(F.sort_array(F.collect_list(F.struct("_no", "requestId"))).alias("_t"))
    related = related.select("incidentId", F.col("_t.requestId").alias("relatedTraces"))
    return (
        stretches.join(totals, "incidentId")
        .join(related, "incidentId")
        .withColumn("errorRate", F.col("errors") * 100.0 / F.col("requests"))
    )


def tumbling_metrics(df: DataFrame, window: str = "1 minute") -> DataFrame:
    """Requests, errors, error rate, greatest and 95th-percentile duration per window and service; batch and streaming.

    The percentile is a mergeable sketch, exact up to 10,000 requests in a window.
    """
    return (
        df.groupBy(F.window("timestamp", window), "service")
        .agg(
            F.count("*").alias("total"),
            F.count("error.code").alias("errors"),
            F.max("performance.durationMs").alias("maxMs"),
            F.percentile_approx("performance.durationMs", 0.95, 10_000).alias("p95Ms"),
        )
        .select(
            F.col("window.start").alias("windowStart"),
            "service",
            "total",
            "errors",
            (F.col("errors") * 100.0 / F.col("total")).alias("errorRate"),
            "maxMs",
            "p95Ms",
        )
    )


def daily_briefing(df: DataFrame, top: int = 3) -> DataFrame:
    """Per day: error rate, its change from the day before, and the day's most frequent codes.

    One raw pass to (day, code) counts; everything else runs on those.
    """
    counts = df.groupBy(F.to_date("timestamp").alias("day"), F.col("error.code").alias("code")).agg(
        F.count("*").alias("n")
    )
    days = counts.groupBy("day").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("code").isNotNull(), F.col("n"))), F.lit(0)).alias("errors")
    )
    rate = F.col("errors") * 100.0 / F.col("total")
    # One row per calendar day: the unpartitioned window is over days, not events.
    days = days.withColumn("errorRate", rate).withColumn(
        "rateChange", F.col("errorRate") - F.lag("errorRate").over(Window.orderBy("day"))
    )
    ranked = (
        counts.filter(F.col("code").isNotNull())
        .withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "code")))
        .filter(F.col("rank") <= top)
    )
    return days.join(ranked, "day", "left").select(
        "day", "total", "errors", "errorRate", "rateChange", "rank", F.col("code").alias("errorCode"), F.col("n").alias("codeErrors")
    )


def system_briefing(df: DataFrame, stretches: DataFrame, top: int = 3, cell_seconds: int = 3600) -> DataFrame:
    """Per day, beside its totals, up to ``top`` rows of each section:

    ``code``: the most frequent error codes; ``trend``: the codes that grew most against the day before;
    ``incident``: the incidents of which most failures fell on the day. ``errors`` is that count, ``change`` the
    difference to the day before (null for incidents). A day without errors has one row without a section.
    """
    counts = df.groupBy(F.to_date("timestamp").alias("day"), F.col("error.code").alias("errorCode")).agg(F.count("*").alias("n"))
    days = counts.groupBy("day").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("errorCode").isNotNull(), F.col("n"))), F.lit(0)).alias("failed")
    )
    days = days.withColumn("errorRate", F.col("failed") * 100.0 / F.col("total")).withColumn(
        "rateChange", F.col("errorRate") - F.lag("errorRate").over(Window.orderBy("day"))
    )
    codes = counts.where("errorCode IS NOT NULL AND day IS NOT NULL")
    before = codes.select(F.date_add("day", 1).alias("day"), "errorCode", F.col("n").alias("earlier"))
    # a code counts as gone to zero only on a day that the table has
    moved = codes.join(before, ["day", "errorCode"], "left").withColumn("change", F.col("n") - F.coalesce("earlier", F.lit(0)))
    none = {c: F.lit(None).cast("string") for c in ("incidentId", "severity")}
    by_code = moved.select("day", "errorCode", F.col("n").alias("errors"), "change").withColumns(none)
    code = first_n_per_group(by_code, ["day"], [F.desc("errors"), F.col("errorCode")], top, "rank").withColumn("section", F.lit("code"))
    trend = first_n_per_group(by_code.where("change > 0"), ["day"], [F.desc("change"), F.col("errorCode")], top, "rank").withColumn("section", F.lit("trend"))
    hit = (
        incident_events(df, stretches, cell_seconds)
        .where("failed")
        .groupBy(F.to_date("timestamp").alias("day"), "errorCode", "incidentId", "severity")
        .agg(F.count("*").alias("errors"))
        .withColumn("change", F.lit(None).cast("bigint"))
    )
    incident = first_n_per_group(hit, ["day"], [F.desc("errors"), F.col("incidentId")], top, "rank").withColumn("section", F.lit("incident"))
    return days.join(code.unionByName(trend).unionByName(incident), "day", "left").select(
        "day", "total", "failed", "errorRate", "rateChange", "section", "rank", "errorCode", "incidentId", "severity", "errors", "change"
    )


def quantify_hits(events: DataFrame, hits: DataFrame, params: MetricParams = MetricParams()) -> DataFrame:
    """Semantic search first, numbers second.

    The distinct error codes of the hit events select, by semi-join, the events
    that the top-codes metric then counts.
    """
    codes = (
        events.join(hits.select("eventId").distinct(), "eventId", "left_semi")
        .select(F.col("error.code").alias("_code"))
        .filter("_code is not null")
        .distinct()
    )
    scope = events.join(codes, F.col("error.code") == F.col("_code"), "left_semi")
    return top_error_codes(scope, params)
