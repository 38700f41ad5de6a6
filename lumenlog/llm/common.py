"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenlog.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` in each: bounds the memory of a Python worker."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        parts = max(1, -(-batch.column(column).nbytes // max_bytes))
        step = max(1, -(-rows // parts))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as the empty string."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]
