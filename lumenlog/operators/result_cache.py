"""Result cache as a table: keys, TTLs, look-ups by similarity, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions import vectors as vx
from lumenlog.plans.timelines import latest_before

DEFAULT_TTL_MS = 60 * 60 * 1000
TIME_RANGE_TTL_MS = 15 * 60 * 1000
MIN_SIMILARITY = 0.95


def _json_string(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.coalesce(F.when(value != "", quoted), F.lit("null"))


def _json_hour(ts: Column) -> Column:
    text = F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def cache_key(service: Column, route: Column, error_code: Column, has_error: Column, start: Column, end: Column) -> Column:
    """sha256 of the metadata as JSON, times cut to the hour, nulls kept."""
    pairs = [
        ("service", _json_string(service)),
        ("route", _json_string(route)),
        ("errorCode", _json_string(error_code)),
        ("hasError", F.when(F.coalesce(has_error, F.lit(False)), "true").otherwise("false")),
        ("startTime", _json_hour(start)),
        ("endTime", _json_hour(end)),
    ]
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), value) for name, value in pairs])
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)


def ttl_ms(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() | end.isNotNull(), F.lit(TIME_RANGE_TTL_MS)).otherwise(F.lit(DEFAULT_TTL_MS)).cast("bigint")


def cache_entries(results: DataFrame, now: Column) -> DataFrame:
    """Cache rows of search results: only non-empty ones, with key, time and TTL.

    ``results``: service, route, errorCode, hasError, startTime, endTime, embedding,
    ``vectorResults`` (array).
    """
    key = cache_key(*[F.col(c) for c in ("service", "route", "errorCode", "hasError", "startTime", "endTime")])
    return (
        results.filter(F.size("vectorResults") > 0)
        .withColumn("cacheKey", key)
        .withColumn("cachedAt", now)
        .withColumn("ttlMs", ttl_ms(F.col("startTime"), F.col("endTime")))
    )


def lookup(queries: DataFrame, entries: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Cache hit per query, if any.

    The entry of a key is the last one written at or before the query (a later
    write replaces). It answers when it is live and its vector is close enough.
    ``queries``: queryId, cacheKey, askedAt, embedding. ``entries``: entryId,
    cacheKey, cachedAt, ttlMs, embedding; query ids are unique. No entry lives longer than the default
    TTL, so older ones are never looked at.
    """
    # One write per key and instant survives: the last id. Ids are matched, vectors come afterwards.
    kept = entries.groupBy("cacheKey", "cachedAt").agg(F.max_by(F.struct("entryId", "ttlMs"), "entryId").alias("e"))
    kept = kept.select("cacheKey", "cachedAt", "e.*")
    asked = queries.select("queryId", "cacheKey", "askedAt")
    seen = latest_before(asked, kept, ["cacheKey"], "askedAt", "cachedAt", DEFAULT_TTL_MS // 1000)
    held = entries.select(
        F.col("cacheKey").alias("_key"), F.col("cachedAt").alias("_at"), F.col("entryId").alias("_id"), F.col("embedding").alias("_held")
    ).dropDuplicates(["_key", "_at", "_id"])
    same = (F.col("entry.cacheKey").eqNullSafe(F.col("_key"))) & (F.col("entry.cachedAt") == F.col("_at")) & (F.col("entry.entryId") == F.col("_id"))
    vectors = queries.select("queryId", "embedding").dropDuplicates(["queryId"])
    seen = seen.join(held, same, "left").join(vectors, "queryId", "left")
    age = F.unix_millis("askedAt") - F.unix_millis("entry.cachedAt")
    close = vx.cosine(F.col("embedding"), F.col("_held"))
    return (
        seen.withColumn("live", F.coalesce(age <= F.col("entry.ttlMs"), F.lit(False)))
        .withColumn("similarity", F.when(F.col("live"), close))
        .withColumn("hit", F.coalesce(F.col("similarity") >= min_similarity, F.lit(False)))
        .select("queryId", "cacheKey", "askedAt", F.col("entry.entryId").alias("entryId"), "live", "similarity", "hit")
    )


def purge(entries: DataFrame, now: Column) -> DataFrame:
    """Entries still live at ``now``."""
    return entries.filter(F.unix_millis(now) - F.unix_millis("cachedAt") <= F.col("ttlMs"))


def invalidate(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries whose key is not in ``keys`` (table with ``cacheKey``)."""
    return entries.join(keys.select("cacheKey").distinct(), "cacheKey", "left_anti")


def clear(entries: DataFrame) -> DataFrame:
    return entries.limit(0)


def answer_key(query: Column, prompt_version: Column, language: Column) -> Column:
    """Exact-match key: normalised question, prompt version, language."""
    normal = F.regexp_replace(F.trim(F.lower(query)), r"\s+", " ")
    return F.sha2(F.concat_ws("|", normal, prompt_version, language), 256)


def exact_hit_rate(questions: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Hits an exact-key answer cache would have had: same key asked within the TTL before.

    ``questions``: key, askedAt. The first question of a live stretch misses, the
    others hit, because each answer refreshes its entry.
    """
    from lumenlog.plans.timelines import activity_segments, merge_segments

    live = merge_segments(activity_segments(questions, ["key"], "askedAt", ttl_seconds), ["key"], ttl_seconds)
    return live.agg(
        F.sum("n").alias("questions"),
        F.count("*").alias("misses"),
        (F.sum("n") - F.count("*")).alias("hits"),
        ((F.sum("n") - F.count("*")) * 100.0 / F.sum("n")).alias("hitRate"),
    )
