"""Chat sessions as arbitrary state: history appended turn by turn, expired one TTL after the last access.

The state of a session is a map from TTL-wide time buckets to what happened in them: first and last
access, number of accesses and turns, and the last few turns. Two accesses of a bucket are less than one
TTL apart, so a bucket never spans an expiry and neighbouring buckets merge to one session exactly where
their distance is at most one TTL. Nothing depends on the order in which rows come: a late row within the
watermark goes to its bucket and may join two stretches. The state lies in the RocksDB store, and each
input chunk is reduced to its buckets before the state is touched, so a worker holds one chunk and a
bounded number of turns however many rows a session brings.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TTL_MS = 30 * 60 * 1000
KEEP = 10
TURN = "array<struct<at: bigint, turn: bigint, question: string, answer: string>>"
BUCKET = f"first bigint, last bigint, accesses bigint, turns bigint, recent {TURN}"
CLOSED = f"sessionId string, first bigint, last bigint, accesses bigint, turns bigint, recent {TURN}"
STATE = "open"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; a stream keeps the provider it was started with."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def latest(turns: list[tuple], keep: int) -> list[tuple]:
    """The last ``keep`` turns by time, then number, oldest first."""
    return sorted(turns, key=lambda t: t[:2])[-keep:]


class SessionHistory(StatefulProcessor):
    """One row per closed session; a timer per bucket fires once the watermark is past its last access by more than a TTL."""

    def __init__(self, ttl_ms: int, keep: int):
        self.ttl, self.keep = ttl_ms * 1000, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState(STATE, "bucket bigint", BUCKET)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            at = chunk["createdAt"].to_numpy().astype("datetime64[us]").astype("int64")
            for bucket, part in chunk.assign(at=at).groupby(at // self.ttl):
                self._add(int(bucket), part)
        return iter(())

    def _add(self, bucket: int, part: pd.DataFrame) -> None:
        said = part[part["question"].notna()].sort_values(["at", "turn"])
        recent = list(said[["at", "turn", "question", "answer"]].tail(self.keep).itertuples(index=False, name=None))
        recent = [(int(at), int(turn), q, a if isinstance(a, str) else None) for at, turn, q, a in recent]
        first, last, accesses, turns = int(part["at"].min()), int(part["at"].max()), len(part), len(said)
        if self.open.containsKey((bucket,)):
            held = self.open.getValue((bucket,))
            recent = latest([tuple(t) for t in held[4]] + recent, self.keep)
            if last > held[1]:
                self.handle.deleteTimer(self._expiry(held[1]))
            first, last = min(first, held[0]), max(last, held[1])
            accesses, turns = accesses + held[2], turns + held[3]
        self.open.updateValue((bucket,), (first, last, accesses, turns, recent))
        self.handle.registerTimer(self._expiry(last))

    def _expiry(self, last: int) -> int:
        return (last + self.ttl) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        stretch: list[tuple[int, tuple]] = []
        held = sorted((int(k[0]), tuple(v)) for k, v in self.open.iterator())
        for bucket in [*held, None]:
            if stretch and (bucket is None or bucket[1][0] - stretch[-1][1][1] > self.ttl):
                if stretch[-1][1][1] + self.ttl < mark:
                    yield self._closed(key, stretch)
                stretch = []
            if bucket:
                stretch.append(bucket)

    def _closed(self, key, stretch: list[tuple[int, tuple]]) -> pd.DataFrame:
        for bucket, _ in stretch:
            self.open.removeKey((bucket,))
        parts = [values for _, values in stretch]
        recent = latest([tuple(t) for p in parts for t in p[4]], self.keep)
        names = ("at", "turn", "question", "answer")
        row = [key[0], parts[0][0], parts[-1][1], sum(p[2] for p in parts), sum(p[3] for p in parts), [dict(zip(names, t, strict=True)) for t in recent]]
        return pd.DataFrame([row], columns=["sessionId", "first", "last", "accesses", "turns", "recent"])

    def close(self) -> None:
        pass


def _shaped(rows: DataFrame) -> DataFrame:
    turn = lambda t: F.struct(F.timestamp_micros(t["at"]).alias("createdAt"), t["turn"].alias("turn"), t["question"].alias("question"), t["answer"].alias("answer"))
    return rows.select(
        "sessionId",
        F.timestamp_micros("first").alias("startedAt"),
        F.timestamp_micros("last").alias("lastAt"),
        "accesses",
        "turns",
        F.transform("recent", turn).alias("history"),
    )


def session_history(turns: DataFrame, ttl_ms: int = TTL_MS, keep: int = KEEP, lateness: str = "10 minutes") -> DataFrame:
    """Closed sessions of a stream (sessionId, createdAt, turn, question, answer), with their last ``keep`` turns.

    Every row is an access and keeps its session alive up to and including one TTL; a row with a question is also a
    turn of the history. A session closes when the watermark is more than one TTL past its last access. Rows without
    a time are left out; rows behind the watermark are dropped by it (:func:`lumenlog.streaming.pipelines.divert_late`
    keeps them). Rows without a session id are one session. Start it inside :func:`rocksdb`. ``ttl_ms`` and ``keep`` must stay as they are
    for one checkpoint.
    """
    source = turns.select(
        "sessionId", "createdAt", F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"), "question", "answer"
    ).where(F.col("createdAt").isNotNull())
    closed = (
        source.withWatermark("createdAt", lateness)
        .groupBy("sessionId")
        .transformWithStateInPandas(SessionHistory(ttl_ms, keep), CLOSED, "Append", "EventTime")
    )
    return _shaped(closed)


def open_sessions(spark: SparkSession, checkpoint: str, ttl_ms: int = TTL_MS, keep: int = KEEP) -> DataFrame:
    """The sessions a stream's checkpoint holds open, in the shape of :func:`session_history`.

    Read from the state store's files after the last committed batch, so that a service can load the histories it needs.
    """
    state = spark.read.format("statestore").option("stateVarName", STATE).option("flattenCollectionTypes", "true").load(checkpoint)
    value = F.col("user_map_value")
    rows = state.select(F.col("key.sessionId").alias("sessionId"), F.col("user_map_key.bucket").alias("_b"), *[value[c].alias(c) for c in ("first", "last", "accesses", "turns", "recent")])
    w = Window.partitionBy("sessionId").orderBy("_b")
    fresh = F.when(F.col("first") - F.lag("last").over(w) <= ttl_ms * 1000, 0).otherwise(1)
    numbered = rows.withColumn("_new", fresh).withColumn("_no", F.sum("_new").over(w))
    return _shaped(
        numbered.groupBy("sessionId", "_no").agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.sum("accesses").alias("accesses"),
            F.sum("turns").alias("turns"),
            _last_turns(F.flatten(F.collect_list("recent")), keep).alias("recent"),
        )
    )


def _last_turns(turns: Column, keep: int) -> Column:
    """Of a list of turns, which holds at most ``keep`` per bucket, the last ones."""
    ordered = F.array_sort(turns)
    return F.slice(ordered, F.greatest(F.size(ordered) - keep + 1, F.lit(1)), keep)
