"""Chunk tables: one row per chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_chunks(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns, chunk number from 0, chunk text."""
    return df.select(*keep, F.posexplode(chunks).alias("chunk_no", "chunk")).withColumn(
        "chunk_no", F.col("chunk_no").cast("bigint")
    )
