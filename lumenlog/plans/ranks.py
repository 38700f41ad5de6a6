"""Rank plans that never sort a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group.

    ``row_number() <= n`` lets Spark keep only ``n`` rows per group in every map
    task before the shuffle, so a hot group costs at most ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def coarse_bucket(value: Column) -> Column:
    """Order-preserving bucket of a number: 512 to a power of two, from 2^-40 on, on either side of zero."""
    size = F.greatest(F.abs(value.cast("double")), F.lit(2.0**-40))
    magnitude = F.floor((F.log2(size) + F.lit(40.0)) * 512) + 1
    return (F.signum(value.cast("double")) * magnitude).cast("bigint")


def floor_rank_percentiles(
    df: DataFrame, value: str, ps: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact percentiles: the element at 0-based index ``floor(p * n)`` of the sorted values.

    Rows are first reduced to a value histogram (partial aggregation makes hot
    values cheap). A coarse histogram of 512 buckets to a power of two locates
    the bucket of every wanted rank; only the values of those few buckets are
    then ranked. Also returns ``count``, ``avg`` and ``max``. A group, or the whole table,
    without values yields no row.
    """
    by = list(by)
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_b", coarse_bucket(F.col("_v")))
    )
    coarse = hist.groupBy(*by, "_b").agg(
        F.sum("_n").alias("_bn"),
        F.sum(F.col("_v") * F.col("_n")).alias("_bs"),
        F.max("_v").alias("_bm"),
    )
    group = Window.partitionBy(*by)
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = coarse.select(
        *by,
        "_b",
        (F.sum("_bn").over(upto) - F.col("_bn")).alias("_before"),
        F.col("_bn"),
        F.sum("_bn").over(group).alias("count"),
        (F.sum("_bs").over(group) / F.sum("_bn").over(group)).alias("avg"),
        F.max("_bm").over(group).alias("max"),
    )
    wanted = placed.select(
        "*",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("name"), F.floor(F.lit(float(p)) * F.col("count")).alias("rank"))
                    for name, p in ps.items()
                ]
            )
        ).alias("_w"),
    ).filter(
        (F.col("_w.rank") >= F.col("_before")) & (F.col("_w.rank") < F.col("_before") + F.col("_bn"))
    )
    keys = by + ["_b"]
    h, t = hist.alias("h"), wanted.alias("t")
    on = [F.col(f"h.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    inside = Window.partitionBy(*[f"t.{k}" for k in keys], "_w.name").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = (
        h.join(t, on)
        .select(
            *[F.col(f"t.{k}").alias(k) for k in by],
            "count",
            "avg",
            "max",
            F.col("_w.name").alias("_name"),
            F.col("_w.rank").alias("_rank"),
            "_v",
            (F.col("_before") + F.sum("_n").over(inside)).alias("_cum"),
        )
        .filter(F.col("_cum") > F.col("_rank"))
    )
    return ranked.groupBy(*by).agg(
        F.first("count").alias("count"),
        *[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ps],
        F.first("avg").alias("avg"),
        F.first("max").alias("max"),
    ).filter(F.col("count") > 0)
