"""Ordered-sequence plans that split a hot key over time buckets.

A window over ``partitionBy(key)`` puts all rows of one key into one task. When a
key may hold a third of the table that task never ends. The helpers here bucket
the order column, work per ``(key, bucket)`` and carry only per-bucket summaries
from one bucket to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys where null equals null; the keys appear once."""
    names = {k: f"_right_{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()]
    return left.join(right.withColumnsRenamed(names), same).drop(*names.values())


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    order: Sequence[Column],
    value: str,
    widths: Sequence[int],
    out: str,
) -> DataFrame:
    """Running sum of ``value`` per key in ``order``.

    ``position`` is a bigint that ascends with ``order`` (equal positions stay in
    one bucket); null keys and positions are a key and a bucket. ``widths`` are ascending bucket widths; each level sums the one
    below, so no window holds more than one bucket of rows.
    """
    keys = list(keys)
    rows = [Window.unboundedPreceding, Window.currentRow]
    if not widths:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*rows)))
    b = f"_b{len(widths)}"
    carry = f"_c{len(widths)}"
    placed = df.withColumn(b, F.floor(F.col(position) / F.lit(widths[0])).cast("bigint"))
    sums = placed.groupBy(*keys, b).agg(F.sum(value).alias("_s"))
    sums = sums.withColumn("_pos", F.col(b) * F.lit(widths[0]))
    sums = running_total(sums, keys, "_pos", [F.col("_pos")], "_s", widths[1:], "_upto")
    offsets = sums.select(*keys, b, (F.col("_upto") - F.col("_s")).alias(carry))
    inner = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(*rows)
    return (
        join_same(placed.withColumn(out, F.sum(value).over(inner)), offsets, keys + [b])
        .withColumn(out, F.col(out) + F.col(carry))
        .drop(b, carry)
    )


def with_next(
    df: DataFrame, keys: Sequence[str], position: str, width: int, cols: dict[str, str]
) -> DataFrame:
    """``lead`` of some columns per key, in order of the bigint ``position``.

    Inside a bucket this is a plain ``lead``; the last row of a bucket takes the
    first row of the key's next non-empty bucket, found on the bucket heads.
    """
    keys = list(keys)
    packed = F.struct(*[F.col(src).alias(dst) for src, dst in cols.items()])
    placed = df.withColumn("_b", F.floor(F.col(position) / F.lit(width)).cast("bigint"))
    # A present row is never null, even if all its columns are.
    inner = Window.partitionBy(*keys, "_b").orderBy(position)
    led = placed.withColumn("_next", F.lead(packed).over(inner))
    heads = placed.groupBy(*keys, "_b").agg(F.min_by(packed, position).alias("_head"))
    heads = heads.select(
        *keys, "_b", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carry")
    )
    nxt = F.coalesce(F.col("_next"), F.col("_carry"))
    return (
        join_same(led, heads, keys + ["_b"])
        .select(
            *[F.col(c) for c in df.columns],
            *[nxt.getField(dst).alias(dst) for dst in cols.values()],
        )
    )


def activity_segments(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int) -> DataFrame:
    """Per key and gap-wide time bucket: first and last activity, row count.

    Two rows of one bucket are less than one gap apart, so a bucket can never be
    split by a gap: it is one segment. Plain partial aggregation, no sort.
    """
    return df.groupBy(*keys, time_bucket(F.col(ts), gap_seconds).alias("_b")).agg(
        F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count("*").alias("n")
    )


def merge_segments(segments: DataFrame, keys: Sequence[str], gap_seconds: int) -> DataFrame:
    """Join neighbouring segments whose distance is at most the gap."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("_b")
    gap = F.unix_micros("first_at") - F.unix_micros(F.lag("last_at").over(w))
    started = segments.withColumn("_new", F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0))
    numbered = started.withColumn("session_no", F.sum("_new").over(w))
    return numbered.groupBy(*keys, "session_no").agg(
        F.min("first_at").alias("started_at"),
        F.max("last_at").alias("last_at"),
        F.sum("n").alias("n"),
    )


def latest_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    horizon_seconds: int,
    payload: str = "entry",
) -> DataFrame:
    """As-of join: for each left row the last right row at or before it, within a horizon.

    Rows of both sides meet per key and cell, a sixtieth of the horizon, so a hot key
    is spread over many tasks. What a cell inherits is found on one row per key and
    cell, the cell's last right row: the horizon bounds how far back that may lie, so
    it is needed only in its own horizon-wide bucket and in the next one. Adds the
    right row as the struct column ``payload`` (null when none).
    """
    keys = list(keys)
    cells = 60
    width = max(1, horizon_seconds // cells)
    span = (cells + 1) * width
    first, upto = Window.unboundedPreceding, Window.currentRow
    right_row, left_row = F.struct(*right.columns), F.struct(*left.columns)

    entries = right.withColumn("_cell", time_bucket(F.col(right_ts), width))
    last = entries.groupBy(*keys, "_cell").agg(F.max_by(right_row, right_ts).alias(payload))
    big = F.floor(F.col("_cell") * F.lit(width) / F.lit(span)).cast("bigint")
    asked = left.select(*keys, time_bucket(F.col(left_ts), width).alias("_cell")).distinct()
    # a cell is asked before its own last row comes in: that one is looked for inside
    steps = last.select(*keys, "_cell", F.lit(1).alias("_side"), F.explode(F.array(big, big + 1)).alias("_b"), payload).unionByName(
        asked.select(*keys, "_cell", F.lit(0).alias("_side"), big.alias("_b"), F.lit(None).cast(right.schema).alias(payload))
    )
    back = Window.partitionBy(*keys, "_b").orderBy("_cell", "_side").rowsBetween(first, upto)
    inherited = steps.withColumn("_carry", F.last(payload, ignorenulls=True).over(back)).filter("_side = 0").select(*keys, "_cell", "_carry")

    rows = entries.select(
        *keys, "_cell", F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), right_row.alias(payload), F.lit(None).cast(left.schema).alias("_left")
    ).unionByName(
        left.select(
            *keys,
            time_bucket(F.col(left_ts), width).alias("_cell"),
            F.col(left_ts).alias("_at"),
            F.lit(1).alias("_side"),
            F.lit(None).cast(right.schema).alias(payload),
            left_row.alias("_left"),
        )
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy("_at", "_side").rowsBetween(first, upto)
    seen = rows.withColumn(payload, F.last(payload, ignorenulls=True).over(inside)).filter("_side = 1")
    found = join_same(seen, inherited, [*keys, "_cell"]).withColumn(payload, F.coalesce(payload, "_carry"))
    age = F.unix_micros("_at") - F.unix_micros(F.col(payload).getField(right_ts))
    return found.select("_left.*", F.when(age <= horizon_seconds * 1_000_000, F.col(payload)).alias(payload))
