"""Points in time joined to the intervals they lie in, as an equi-join on time cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.plans.timelines import time_bucket

HOT = 1000  # a cell with more than one in so many points is dealt over several tasks


def merge_overlapping(spans: DataFrame, keys: Sequence[str], start: str, end: str, **aggregates) -> DataFrame:
    """Intervals of a key that overlap or touch, as one: keys, ``start``, ``end`` and the given aggregates.

    The window holds one key's intervals; use it on intervals that time bounds, such as one per minute and key.
    """
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    apart = F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True))
    numbered = spans.withColumn("_new", apart.cast("int")).withColumn("_no", F.sum("_new").over(upto))
    merged = numbered.groupBy(*keys, "_no").agg(
        F.min(start).alias(start), F.max(end).alias(end), *[column.alias(name) for name, column in aggregates.items()]
    )
    return merged.drop("_no")


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, cell_seconds: int
) -> DataFrame:
    """Inner join of points to the intervals ``start <= at < end`` of equal ``keys``; null keys equal null.

    An interval is laid out over the cells it covers, a point lies in one, and both meet by key and cell: no
    nested loop, and a point meets only what touches its cell. Choose cells of about the usual length of an
    interval. A busy cell, more than one in ``HOT`` of all points, is split by a hash of the point and its intervals
    are repeated for every part; there are at most ``HOT`` such cells, so their list is broadcast. Empty
    intervals and null times meet nothing. Other column names of the two sides must differ.
    """
    keys, cell = list(keys), cell_seconds * 1_000_000
    own = [f"_k{i}" for i in range(len(keys))]
    placed = points.where(F.col(at).isNotNull()).withColumn("_cell", time_bucket(F.col(at), cell_seconds))
    counts = placed.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    # one part of a cell may hold this share of all points
    total = counts.agg(F.sum("_n").alias("_all")).scalar()
    hot = counts.withColumn("_all", total).where(F.col("_n") * HOT > F.col("_all")).select(
        *[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col("_cell").alias("_c"), F.ceil(F.col("_n") * HOT / F.col("_all")).cast("int").alias("_parts")
    )
    hot = F.broadcast(hot)

    def with_parts(df: DataFrame) -> DataFrame:
        same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
        return df.join(hot, [*same, F.col("_cell") == F.col("_c")], "left").drop(*own, "_c").withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    row = F.xxhash64(*[F.col(c) for c, t in points.dtypes if not t.startswith(("map", "variant"))])
    dealt = with_parts(placed).withColumn("_part", F.pmod(row, "_parts")).drop("_parts")
    first = F.floor(F.unix_micros(start) / F.lit(cell)).cast("bigint")
    last = F.floor((F.unix_micros(end) - 1) / F.lit(cell)).cast("bigint")
    cells = intervals.where(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(first, last)))
    cells = with_parts(cells).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts").cast("bigint") - 1))).drop("_parts")
    names = {k: o for k, o in zip(keys, own, strict=True)} | {"_cell": "_c", "_part": "_p"}
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    met = dealt.join(cells.withColumnsRenamed(names), [F.col("_cell") == F.col("_c"), F.col("_part") == F.col("_p"), *same])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop(*own, "_cell", "_c", "_part", "_p")
