"""Model outputs, grounding decisions and source traceability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.text import pretty_json

# --- fixed values -------------------------------------------------------------
REJECTED_ANSWER = "Not enough evidence to provide a reliable answer."
NO_HITS_ANSWER = "Not enough evidence."
NO_HISTORY = {
    "Korean": "이 세션에서 이전에 나눈 대화 내용이 없습니다.",
    "English": "I don't have any previous conversation records in this session.",
}
# --- end of fixed values ------------------------------------------------------

VERDICT_SCHEMA = (
    "status string, confidenceAdjustment double, unverifiedClaims array<string>, action string, reasoning string"
)


def parse_answer(raw: Column) -> Column:
    """{answer, confidence} of a raw answer text; confidence 0.5 when not stated."""
    marked = F.regexp_extract(raw, r"(?is)Answer:\s*(.*?)(?=\nConfidence:|\z)", 1)
    number = F.regexp_extract(raw, r"(?i)Confidence:\s*(\d+(?:\.\d*)?|\.\d+)", 1)
    return F.struct(
        F.when(F.rlike(raw, F.lit("(?i)Answer:")), F.btrim(marked, F.lit(" \t\r\n"))).otherwise(raw).alias("answer"),
        F.coalesce(F.nullif(number, F.lit("")).try_cast("double"), F.lit(0.5)).alias("confidence"),
    )


def parse_verdict(raw: Column) -> Column:
    """Verification result from JSON text, fenced or bare; unreadable text gives a cautious default."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.coalesce(F.nullif(fenced, F.lit("")), raw)
    v = F.from_json(body, VERDICT_SCHEMA)
    readable = F.try_parse_json(body).isNotNull() & F.startswith(F.ltrim(body), F.lit("{"))
    return F.when(
        readable,
        F.struct(
            F.coalesce(F.nullif(v["status"], F.lit("")), F.lit("NOT_VERIFIED")).alias("status"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v["confidenceAdjustment"], F.lit(0.5)))).alias("confidenceAdjustment"),
            F.coalesce(v["unverifiedClaims"], F.array().cast("array<string>")).alias("unverifiedClaims"),
            F.coalesce(F.nullif(v["action"], F.lit("")), F.lit("ADJUST_CONFIDENCE")).alias("action"),
        ),
    ).otherwise(
        F.struct(
            F.lit("NOT_VERIFIED").alias("status"),
            F.lit(0.3).alias("confidenceAdjustment"),
            F.array(F.lit("Verification process failed")).alias("unverifiedClaims"),
            F.lit("ADJUST_CONFIDENCE").alias("action"),
        )
    )


def decide(answer: Column, confidence: Column, verdict: Column) -> Column:
    """{answer, confidence} after verification."""
    rejected = verdict["action"] == "REJECT_ANSWER"
    adjusted = verdict["action"] == "ADJUST_CONFIDENCE"
    note = F.concat(
        answer,
        F.lit("\n\n[Note: Some claims could not be fully verified: "),
        F.array_join(verdict["unverifiedClaims"], ", "),
        F.lit("]"),
    )
    return F.struct(
        F.when(rejected, REJECTED_ANSWER)
        .when(adjusted & (F.size(verdict["unverifiedClaims"]) > 0), note)
        .otherwise(answer)
        .alias("answer"),
        F.when(rejected, 0.0)
        .when(adjusted, F.least(confidence, confidence * verdict["confidenceAdjustment"]))
        .otherwise(confidence)
        .alias("confidence"),
    )


def trace_citations(answers: DataFrame, events: DataFrame, keys: list[str], sources: str = "sources") -> DataFrame:
    """One row per citation: does the cited request exist?

    Citations are grouped per cited id before the join, so an id cited by a third
    of all answers still joins as one row; the flag then meets the citations again
    (adaptive execution splits a skewed id there).
    """
    cited = answers.select(*keys, F.explode(sources).alias("source"))
    ids = cited.select("source").distinct()
    known = ids.join(events.select(F.col("requestId").alias("source")), "source", "left_semi")
    return cited.join(known.withColumn("_known", F.lit(True)), "source", "left").select(
        *keys, "source", F.coalesce("_known", F.lit(False)).alias("grounded")
    )


def traceability(citations: DataFrame, keys: list[str]) -> DataFrame:
    """Per answer (or any keys): citations, grounded ones and their share."""
    return citations.groupBy(*keys).agg(
        F.count("*").alias("cited"),
        F.count_if("grounded").alias("grounded"),
        (F.count_if("grounded") / F.count("*")).alias("groundedShare"),
    )


def aggregate_sources(examples: DataFrame) -> DataFrame:
    """Request ids behind an aggregate result (rows with an ``examples`` list), one row each."""
    return examples.select(F.explode(F.col("examples.requestId")).alias("source"))


def default_answers(questions: DataFrame, hits: DataFrame, history_counts: DataFrame) -> DataFrame:
    """Answers that need no model: no hits, or a conversation without history.

    ``questions``: queryId, sessionId, text, intent, language. ``hits``: queryId
    rows. ``history_counts``: sessionId, turns.
    """
    found = hits.select("queryId").distinct().withColumn("_hit", F.lit(True))
    turns = history_counts.select("sessionId", "turns")
    q = questions.join(found, "queryId", "left").join(turns, "sessionId", "left")
    fresh = (F.col("intent") == "CONVERSATIONAL") & (F.coalesce("turns", F.lit(0)) == 0)
    empty = (F.col("intent") == "SEMANTIC") & F.col("_hit").isNull()
    greeting = F.when(F.col("language") == "Korean", NO_HISTORY["Korean"]).otherwise(NO_HISTORY["English"])
    return q.select(
        "queryId",
        "sessionId",
        "intent",
        F.when(fresh, greeting).when(empty, NO_HITS_ANSWER).alias("answer"),
        F.when(fresh, 1.0).when(empty, 0.0).alias("confidence"),
    ).filter("answer is not null")


def context_documents(grounded: DataFrame, label: str = "Document") -> DataFrame:
    """Prompt context per query: numbered JSON of its (at most n) grounded events."""
    payload = grounded.drop("queryId", "rank").schema
    body = pretty_json(F.struct(*payload.names), payload)
    text = F.concat(F.lit(f"[{label} "), F.col("rank").cast("string"), F.lit("]\n"), body)
    listed = F.sort_array(F.collect_list(F.struct("rank", text.alias("text"))))
    return grounded.groupBy("queryId").agg(
        F.array_join(F.transform(listed, lambda e: e["text"]), "\n\n").alias("contextText")
    )


def aggregation_context(metric: DataFrame, *order: Column) -> DataFrame:
    """Prompt context of a metric result, a bounded top-n table, its rows sorted by ``order``."""
    keyed = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], F.struct(*metric.columns).alias("row"))
    rows = F.transform(F.sort_array(F.collect_list(keyed)), lambda e: e["row"])
    text = pretty_json(F.col("rows"), T.ArrayType(metric.schema))
    return metric.agg(rows.alias("rows")).select(F.concat(F.lit("[Aggregation Results]\n"), text).alias("contextText"))


def joined_context(*parts: Column) -> Column:
    """Context sections separated by blank lines; empty ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n")
