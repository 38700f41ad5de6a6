"""Chat sessions: turns, history, expiry, access replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.plans.ranks import first_n_per_group
from lumenlog.plans.timelines import activity_segments, join_same, merge_segments, time_bucket, with_next

SESSION_TTL_SECONDS = 1800
MAX_TURNS = 10
SUMMARY_CONFIDENCE = 0.8


def append_history(history: DataFrame, now: Column) -> DataFrame:
    """Rows ready to be stored: both audit times set."""
    return history.withColumn("createdAt", now).withColumn("updatedAt", now)


def pair_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str, width: int = 4096) -> DataFrame:
    """(question, answer) rows from role rows: a user turn followed by an assistant turn.

    Turn numbers are bucketed, so one huge conversation is spread over tasks.
    """
    slim = turns.select(conv, turn, role, text)
    led = with_next(slim, [conv], turn, width, {role: "_next_role", text: "answer"})
    return led.filter((F.col(role) == "user") & (F.col("_next_role") == "assistant")).select(
        conv, turn, F.col(text).alias("question"), "answer"
    )


def session_history(history: DataFrame) -> DataFrame:
    """All turns, each session in time order.

    A range sort on (session, time, turn): a hot session is split over several
    output partitions instead of being collected into one array.
    """
    return history.orderBy("sessionId", "createdAt", "turn")


def last_turns(history: DataFrame, n: int = MAX_TURNS) -> DataFrame:
    """Last ``n`` turns of every session; ``age`` 1 is the most recent."""
    return first_n_per_group(history, ["sessionId"], [F.desc("createdAt"), F.desc("turn")], n, "age")


def _mentions(word_ko: str, word_en: str) -> Column:
    return F.contains(F.col("question"), F.lit(word_ko)) | F.contains(F.lower("question"), F.lit(word_en))


def summary_text(n: Column, services: Column, performance: Column) -> Column:
    """Rule-based one-line summary of the older turns."""
    topics = F.concat_ws(", ", F.when(services, "services"), F.when(performance, "performance"))
    return F.concat(
        F.lit("Previous conversation covered "),
        n.cast("string"),
        F.lit(" interactions about "),
        F.coalesce(F.nullif(topics, F.lit("")), F.lit("various topics")),
        F.lit("."),
    )


def old_turn_summary(history: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """One summary row per session longer than ``max_turns``, about all but its last turns.

    Totals over all turns minus totals over the last ones, so the long part of a
    session is only ever aggregated, never ranked or gathered.
    """
    flags = [
        F.count("*").alias("n"),
        F.count_if(_mentions("서비스", "service")).alias("svc"),
        F.count_if(_mentions("성능", "performance")).alias("perf"),
    ]
    everything = history.groupBy("sessionId").agg(*flags)
    recent = last_turns(history, max_turns).groupBy("sessionId").agg(*flags)
    recent = recent.select("sessionId", *[F.col(c).alias(f"r_{c}") for c in ("n", "svc", "perf")])
    old = everything.join(recent, "sessionId").select(
        "sessionId", *[(F.col(c) - F.col(f"r_{c}")).alias(c) for c in ("n", "svc", "perf")]
    )
    return old.filter("n > 0").select(
        "sessionId",
        F.lit("[Previous conversation summary]").alias("question"),
        summary_text(F.col("n"), F.col("svc") > 0, F.col("perf") > 0).alias("answer"),
        F.lit("UNKNOWN").alias("intent"),
        F.lit(SUMMARY_CONFIDENCE).alias("confidence"),
        F.col("n").alias("oldTurns"),
    )


def old_turn_sources(history: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """Distinct sources of the summarised turns, one row each with its first citation.

    Sorting a session's rows by (firstCitedAt, firstTurn, firstPos) gives the
    first-seen order; the list is kept as rows so that no session becomes one value.
    """
    cited = history.select("sessionId", "createdAt", "turn", F.posexplode("sources").alias("pos", "source"))
    first = cited.groupBy("sessionId", "source").agg(
        F.min(F.struct("createdAt", "turn", "pos")).alias("first")
    )
    cut = last_turns(history, max_turns).groupBy("sessionId").agg(
        F.min(F.struct("createdAt", "turn")).alias("cut"), F.max("age").alias("kept")
    )
    return (
        first.join(cut, "sessionId")
        .filter((F.col("kept") == max_turns) & (F.struct("first.createdAt", "first.turn") < F.col("cut")))
        .select(
            "sessionId",
            "source",
            F.col("first.createdAt").alias("firstCitedAt"),
            F.col("first.turn").alias("firstTurn"),
            F.col("first.pos").alias("firstPos"),
        )
    )


def compress_history(history: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """Summary row (position 0) of the old turns, then the last turns (positions 1..n)."""
    recent = last_turns(history, max_turns)
    size = Window.partitionBy("sessionId")
    recent = recent.select(
        "sessionId",
        (F.max("age").over(size) - F.col("age") + 1).alias("position"),
        "question",
        "answer",
        "intent",
        "confidence",
        "createdAt",
    )
    summary = old_turn_summary(history, max_turns).select(
        "sessionId",
        F.lit(0).alias("position"),
        "question",
        "answer",
        "intent",
        "confidence",
        F.lit(None).cast("timestamp").alias("createdAt"),
    )
    return summary.unionByName(recent)


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def _by_session(turns: DataFrame, entry: Column, separator: str, prefix: str = "") -> DataFrame:
    # At most max_turns + 1 rows per session reach this list.
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("position", entry.alias("text")))), lambda e: e["text"]),
        separator,
    )
    return turns.groupBy("sessionId").agg(F.concat(F.lit(prefix), joined).alias("historyText"))


def render_history(turns: DataFrame, now: Column) -> DataFrame:
    """Prompt text of a compressed history (see :func:`compress_history`)."""
    w = Window.partitionBy("sessionId")
    no = F.row_number().over(w.orderBy("position"))
    numbered = turns.withColumn("no", no).withColumn("total", F.count("*").over(w))
    minutes = F.floor((F.unix_millis(now) - F.unix_millis("createdAt")) / 60000.0 + 0.5)
    entry = F.concat(
        F.lit("Turn "),
        F.col("no").cast("string"),
        F.coalesce(F.concat(F.lit(" ["), minutes.cast("string"), F.lit(" mins ago]")), F.lit("")),
        F.when(F.col("no") == F.col("total"), " (LAST TURN)").otherwise(""),
        F.lit(":\nQ: "),
        F.col("question"),
        F.lit("\nA: "),
        clip(F.col("answer"), 200),
    )
    return _by_session(numbered, entry, "\n\n", "\nChat History (Ordered from oldest to most recent):\n")


def render_for_reformulation(history: DataFrame, turns: int = 5) -> DataFrame:
    """Last turns in time order, without times."""
    recent = last_turns(history, turns)
    kept = F.max("age").over(Window.partitionBy("sessionId"))
    placed = recent.withColumn("position", kept - F.col("age") + 1)
    entry = F.concat(
        F.lit("Turn "), F.col("position").cast("string"), F.lit(":\nQ: "), F.col("question"),
        F.lit("\nA: "), clip(F.col("answer"), 200),
    )
    return _by_session(placed, entry, "\n\n")


def summariser_lines(history: DataFrame) -> DataFrame:
    """Numbered Q/A text of every turn for the summariser, one row per turn.

    A session may be of any length, so its lines stay rows; their order is
    ``position``. Numbering counts per (session, hour) first.
    """
    placed = history.withColumn("_b", time_bucket(F.col("createdAt"), 3600))
    inner = Window.partitionBy("sessionId", "_b").orderBy("createdAt", "turn")
    sizes = placed.groupBy("sessionId", "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("sessionId").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("sessionId", "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"))
    numbered = (
        join_same(placed.withColumn("_no", F.row_number().over(inner)), offsets, ["sessionId", "_b"])
        .withColumn("position", F.col("_no") + F.col("_offset"))
    )
    no = F.col("position").cast("string")
    return numbered.select(
        "sessionId",
        "position",
        F.concat(F.lit("Q"), no, F.lit(": "), F.col("question"), F.lit("\nA"), no, F.lit(": "), clip(F.col("answer"), 150)).alias("text"),
    )


def sessions_by_ttl(history: DataFrame, ttl_seconds: int = SESSION_TTL_SECONDS) -> DataFrame:
    """Live stretches of each session: a pause longer than the TTL starts a new one."""
    keys = ["sessionId"]
    return merge_segments(activity_segments(history, keys, "createdAt", ttl_seconds), keys, ttl_seconds)


def access_replay(accesses: DataFrame, ttl_seconds: int = SESSION_TTL_SECONDS) -> DataFrame:
    """Cache hits and misses per session for an access log (``sessionId``, ``at``).

    An access is a hit when the previous one is at most one TTL ago. Inside one
    TTL-wide bucket only the first access can miss, so bucket summaries suffice.
    """
    seg = activity_segments(accesses, ["sessionId"], "at", ttl_seconds)
    w = Window.partitionBy("sessionId").orderBy("_b")
    gap = F.unix_micros("first_at") - F.unix_micros(F.lag("last_at").over(w))
    miss = F.when(gap.isNull() | (gap > ttl_seconds * 1_000_000), 1).otherwise(0)
    return (
        seg.withColumn("_miss", miss)
        .groupBy("sessionId")
        .agg(
            F.sum("n").alias("accesses"),
            (F.sum("n") - F.sum("_miss")).alias("hits"),
            F.sum("_miss").alias("misses"),
            (F.sum("_miss") - 1).alias("expiries"),
        )
    )
