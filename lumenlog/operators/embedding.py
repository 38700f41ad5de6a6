"""Embedding events: feature hashing by default, any model by plug-in, and the high-water mark."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions import events as ev
from lumenlog.operators.filters import pending_page

# texts -> one vector per text, or one (vector, tokens used) per text
Embedder = Callable[[list[str]], list]


NOT_A_WORD = "[^a-z0-9가-힣]+"


def tokens(text: Column) -> Column:
    """Lower-cased alphanumeric words (ASCII and Hangul)."""
    return F.filter(F.split(F.lower(text), NOT_A_WORD), lambda t: t != "")


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Reproducible bag-of-words vector, L2-normalised.

    Word ``w`` (as in :func:`tokens`) adds 1 to slot ``int(md5(w)[:8], 16) mod dim``.
    Each Arrow batch is split, coded and counted by whole columns, and hashes its
    distinct words once.
    """

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        words = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), NOT_A_WORD)
        row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        # The empty word stands for a separator at an end of the text.
        slots = np.array([_slot(w, dim) if w else -1 for w in coded.dictionary.to_pylist()], dtype="int64")
        slot = slots[coded.indices.to_numpy()] if len(slots) else np.zeros(0, dtype="int64")
        cells = row[slot >= 0] * dim + slot[slot >= 0]
        counts = np.bincount(cells, minlength=len(words) * dim).reshape(-1, dim).astype("float64")
        size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = np.divide(counts, size, out=np.zeros_like(counts), where=size > 0).astype("float32")
        offsets = np.arange(0, (len(words) + 1) * dim, dim, dtype="int32")
        return pa.ListArray.from_arrays(offsets, unit.ravel())

    return vectors(text)


def _slot(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim


def embed_rows(df: DataFrame, text: Column, embedder: Embedder | None = None, model: str = "hash-64", batch_size: int = 50) -> DataFrame:
    """``df`` with ``summary``, ``model``, ``embedding`` and ``tokens`` used.

    Without ``embedder`` the vectors are column expressions and tokens are words. With
    one, each task calls it on groups of ``batch_size`` texts of its Arrow batches;
    where it gives no usage, tokens are words too.
    """
    base = df.withColumn("summary", text).withColumn("model", F.lit(model))
    words = F.size(tokens(F.coalesce("summary", F.lit("")))).cast("long")
    if embedder is None:
        return base.withColumn("embedding", hashed_vector(F.col("summary"))).withColumn("tokens", words)
    schema = T.StructType(
        [*base.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("tokens", T.LongType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["summary"].tolist()
            vectors: list = []
            for i in range(0, len(texts), batch_size):
                vectors.extend(embedder(texts[i : i + batch_size]))
            paired = [v if isinstance(v, tuple) else (v, None) for v in vectors]
            used = pd.array([n for _, n in paired], dtype="Int64")
            yield pdf.assign(embedding=[v for v, _ in paired], tokens=used)

    return base.mapInPandas(run, schema).withColumn("tokens", F.coalesce("tokens", words))


def embed_events(events: DataFrame, now: Column, embedder: Embedder | None = None, model: str = "hash-64") -> DataFrame:
    """Embedded-event rows of events, text = dual-layer summary."""
    slim = events.select("eventId", "requestId", "service", "timestamp", ev.dual_layer_summary(**ev.event_args()).alias("_text"))
    out = embed_rows(slim, F.col("_text"), embedder, model)
    return out.select(
        "eventId", "requestId", "summary", "model", "embedding", "service", "timestamp", now.alias("createdAt")
    )


def token_usage(events: DataFrame, embedder: Embedder | None = None, model: str = "hash-64") -> DataFrame:
    """Tokens that embedding each event takes: what an audit of the model's cost reads."""
    slim = events.select("eventId", "service", ev.dual_layer_summary(**ev.event_args()).alias("_text"))
    return embed_rows(slim, F.col("_text"), embedder, model).select("eventId", "service", "model", "tokens")


def append_embeddings(rows: DataFrame, table: str, progress: str, source: str, now: Column, groups: int = 4) -> int:
    """Append embedded rows to ``table`` in time order, marking ``progress`` after each group; the number of groups.

    A group is a range of the time. The first group that fails ends the run and its error
    is raised: what came before stays appended and marked, so that the next run
    adds the rest. Rows that are in the table already add nothing.
    """
    spark = rows.sparkSession
    at = F.unix_micros("timestamp")
    cuts = sorted(set(rows.select(at.alias("t")).approxQuantile("t", [i / groups for i in range(1, groups)], 0.01)))
    bounds = [None, *cuts, None]
    for n, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = rows
        if low is not None:
            part = part.filter(at > low)
        if high is not None:
            part = part.filter(at.isNull() | (at <= high)) if low is None else part.filter(at <= high)
        seen = spark.read.schema(rows.schema).parquet(table) if n or _exists(spark, table) else None
        fresh = part if seen is None else new_rows(part, seen)
        fresh.write.mode("append").parquet(table)
        advance_mark(part, source, now).write.mode("append").parquet(progress)
    return len(bounds) - 1


@dataclass(frozen=True)
class AppendRun:
    """How far an append came: groups done of all, and what the one after them failed with."""

    done: int
    groups: int
    error: str | None = None


def append_by_day(rows: DataFrame, table: str, progress: str, source: str, now: Column, groups: int = 4) -> AppendRun:
    """Append embedded rows to ``table``, partitioned by ``event_date``, in ranges of days, marking ``progress`` after each.

    A copy of an event has the event's time, so a range is compared with its own days of the table only: the
    filter is on the partition column and prunes the scan before anything is read. Rows without a time form a day of
    their own, in the first range. Rows that are in the table already add nothing. The first range that fails ends the
    run; what came before stays appended and marked, and its error is in the result.
    """
    spark = rows.sparkSession
    dated = rows.withColumn("event_date", F.to_date("timestamp"))
    number = F.unix_date("event_date")
    days = dated.where(F.col("event_date").isNotNull()).select(number.alias("d"))
    cuts = sorted({int(d) for d in days.approxQuantile("d", [i / groups for i in range(1, groups)], 0.01)})
    bounds = [None, *cuts, None]
    for n, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part, seen = dated, stored_days(spark, table, dated)
        date = lambda d: F.lit(dt.date(1970, 1, 1) + dt.timedelta(days=d))
        within = F.lit(True) if low is None else F.col("event_date") > date(low)
        if high is not None:
            within = within & (F.col("event_date") <= date(high))
        if low is None:
            within = within | F.col("event_date").isNull()
        try:
            part = part.where(within)
            fresh = part if seen is None else new_rows(part, seen.where(within))
            fresh.write.mode("append").partitionBy("event_date").parquet(table)
            advance_mark(part.drop("event_date"), source, now).write.mode("append").parquet(progress)
        except PySparkException as e:
            return AppendRun(n, len(bounds) - 1, str(e))
    return AppendRun(len(bounds) - 1, len(bounds) - 1)


def stored_days(spark: SparkSession, table: str, like: DataFrame) -> DataFrame | None:
    """The stored table as it is now, with the columns of ``like``; None where there is none yet."""
    return spark.read.schema(like.schema).parquet(table) if _exists(spark, table) else None


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def advance_mark(embedded: DataFrame, source: str, now: Column) -> DataFrame:
    """Progress row after a successful append: the greatest (timestamp, eventId)."""
    last = F.max(F.struct("timestamp", "eventId"))
    return (
        embedded.agg(last.alias("m"))
        .filter("m is not null")
        .select(
            F.lit(source).alias("source"),
            F.col("m.eventId").alias("lastEmbeddedEventId"),
            F.col("m.timestamp").alias("lastEmbeddedEventTimestamp"),
            now.alias("lastUpdatedAt"),
        )
    )


def read_mark(progress: DataFrame, source: str) -> tuple:
    """(timestamp, eventId) of a source's mark: of rows of one instant, as the groups of a run write them, the greatest."""
    latest = F.max(F.struct("lastUpdatedAt", "lastEmbeddedEventTimestamp", "lastEmbeddedEventId"))
    row = progress.filter(F.col("source") == source).agg(latest.alias("m")).first()
    return (row["m"][1], row["m"][2]) if row and row["m"] else (None, None)


def new_rows(batch: DataFrame, embedded: DataFrame, lateness_from: Column | None = None) -> DataFrame:
    """Rows of ``batch`` not embedded yet. A retried batch adds nothing.

    ``lateness_from`` limits the look-back into ``embedded`` when the batch itself
    cannot hold older events.
    """
    seen = embedded if lateness_from is None else embedded.filter(F.col("timestamp") >= lateness_from)
    return batch.join(seen.select("eventId"), "eventId", "left_anti")


def pending_events(events: DataFrame, mark: tuple = (None, None), limit: int | None = None) -> DataFrame:
    """Incremental read: embeddable events behind the mark."""
    return pending_page(events, *mark, limit=limit)
