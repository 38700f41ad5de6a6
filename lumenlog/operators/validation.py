"""Validation of events and derived tables: one array of reasons per row, two filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.schema import USER_ROLES


def _blank(col: Column) -> Column:
    return col.isNull() | (col == "")


def event_reasons() -> Column:
    """Why a nested event is not valid; empty when it is."""
    checks = [
        (_blank(F.col("requestId")), "requestId is empty"),
        (F.col("timestamp").isNull(), "timestamp is empty"),
        (_blank(F.col("service")), "service is empty"),
        (_blank(F.col("route")), "route is empty"),
        (F.col("user").isNotNull() & _blank(F.col("user.id")), "user.id is empty"),
        (
            F.col("user").isNotNull() & ~F.coalesce(F.col("user.role").isin(USER_ROLES), F.lit(False)),
            "user.role is unknown",
        ),
        (F.col("error").isNotNull() & _blank(F.col("error.code")), "error.code is empty"),
        (F.col("error").isNotNull() & _blank(F.col("error.message")), "error.message is empty"),
        (F.col("performance").isNotNull() & F.col("performance.durationMs").isNull(), "performance.durationMs is no number"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(reason)) for bad, reason in checks]))


def required_reasons(df: DataFrame, schema: T.StructType, required: Sequence[str]) -> Column:
    """Rule-table check: required fields present, known fields of the right type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in required:
        if name not in have:
            parts.append(F.lit(f"{name} is missing"))
        else:
            parts.append(F.when(F.col(name).isNull(), F.lit(f"{name} is missing")))
    for field in schema.fields:
        if field.name in have and have[field.name].simpleString() != field.dataType.simpleString():
            parts.append(
                F.when(
                    F.col(field.name).isNotNull() & F.col(field.name).try_cast(field.dataType).isNull(),
                    F.lit(f"{field.name} is no {field.dataType.simpleString()}"),
                )
            )
    return F.array_compact(F.array(*parts))


def split(df: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``reasons``)."""
    checked = df.withColumn("reasons", reasons)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)
