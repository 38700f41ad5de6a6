"""Chunking and field parsing of summary texts. Lengths are code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space removed by trimming: ASCII, no-break space, BOM, line and paragraph separators.
WHITESPACE = " \t\n\r\x0b\x0c ﻿  "


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once.

    A column used inside a lambda is evaluated again for every element; bound to a
    lambda variable it is not.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def _parts(text: Column) -> Column:
    return F.filter(F.split(text, ", "), lambda p: trim(p) != "")


def should_chunk(text: Column, threshold: int = 200) -> Column:
    return F.length(text) > threshold


def chunk_summary(text: Column, max_length: int = 200) -> Column:
    """Greedy packing of ``", "`` parts into chunks of at most ``max_length``."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def add(acc, part):
        full = (F.length(acc["cur"]) > 0) & (F.length(acc["cur"]) + F.length(part) + 2 > max_length)
        joined = F.when(F.length(acc["cur"]) > 0, F.concat(acc["cur"], F.lit(", "), part)).otherwise(part)
        return F.struct(
            F.when(full, part).otherwise(joined).alias("cur"),
            F.when(full, F.concat(acc["out"], F.array(trim(acc["cur"])))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc):
        last = trim(acc["cur"])
        return F.when(last != "", F.concat(acc["out"], F.array(last))).otherwise(acc["out"])

    packed = F.aggregate(_parts(text), start, add, finish)
    return F.when(F.length(text) <= max_length, F.array(text)).otherwise(packed)


def overlapping_chunks(text: Column, length: int = 150, overlap: int = 30) -> Column:
    """Windows of ``length`` sharing ``overlap`` characters, trimmed; the last one reaches the end.

    The text is cut once into steps; each window is one step plus the head of the
    next ones, so the work is linear in the text.
    """
    step = length - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than length")
    more = -(-overlap // step)  # following pieces a window may reach into
    count = F.ceil((F.length(text) - length) / F.lit(float(step))).cast("int") + 1

    def windows(pieces):
        def one(i):
            joined = F.array_join(F.slice(pieces, i + 1, F.lit(more + 1)), "")
            return trim(F.substring(joined, 1, length))

        return F.transform(F.sequence(F.lit(0), count - 1), one)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return F.when(F.length(text) <= length, F.array(text)).otherwise(let(pieces, windows))


def _field_name(part: Column) -> Column:
    colon = F.instr(part, ":")
    return F.when(colon > 1, F.lower(F.substr(part, F.lit(1), colon - 1)))


def chunk_by_fields(text: Column) -> Column:
    """One chunk per part, with the lower-cased name before its first colon."""
    return F.transform(_parts(text), lambda p: F.struct(trim(p).alias("text"), _field_name(p).alias("field")))


def without_narrative(text: Column) -> Column:
    """Structured line of a dual-layer text: what follows the last blank line."""
    return F.substring_index(text, "\n\n", -1)


def field_entries(text: Column) -> Column:
    """(name, value) pairs in text order; parts without a name are left out."""
    named = F.filter(F.split(text, ", "), lambda p: F.instr(p, ":") > 1)
    return F.transform(
        named,
        lambda p: F.struct(
            F.lower(trim(F.substring_index(p, ":", 1))).alias("name"),
            trim(F.substr(p, F.instr(p, ":") + 1)).alias("value"),
        ),
    )


def field_value(entries: Column, name: str) -> Column:
    """Value of the last entry called ``name``."""
    return F.try_element_at(F.filter(entries, lambda e: e["name"] == name), F.lit(-1))["value"]


def field_map(text: Column) -> Column:
    """Map of names to values; a repeated name keeps its last value."""

    def build(entries):
        def last_of_name(entry, i):
            later = F.slice(entries, i + 2, F.size(entries))
            return ~F.exists(later, lambda e: e["name"] == entry["name"])

        return F.map_from_entries(F.filter(entries, last_of_name))

    return let(field_entries(text), build)


def pretty_json(value: Column, dtype: T.DataType, level: int = 0) -> Column:
    """JSON text indented by two spaces, ``"key": value``; null fields are left out.

    The layout follows the column type, so it is settled when the plan is built.
    """
    pad, close = "  " * (level + 1), "  " * level

    def block(open_, body, shut):
        filled = F.concat(F.lit(open_ + "\n"), body, F.lit("\n" + close + shut))
        return F.when(value.isNotNull(), F.when(body == "", open_ + shut).otherwise(filled))

    if isinstance(dtype, T.StructType):
        fields = [
            F.concat(F.lit(f'{pad}"{f.name}": '), pretty_json(value[f.name], f.dataType, level + 1)) for f in dtype.fields
        ]
        return block("{", F.concat_ws(",\n", *fields), "}")
    if isinstance(dtype, T.ArrayType):
        def item(v):
            return F.concat(F.lit(pad), F.coalesce(pretty_json(v, dtype.elementType, level + 1), F.lit("null")))

        return block("[", F.array_join(F.transform(value, item), ",\n"), "]")
    if isinstance(dtype, T.TimestampType):
        return F.date_format(value, "'\"'yyyy-MM-dd'T'HH:mm:ss.SSS'Z\"'")
    if isinstance(dtype, T.StringType):
        listed = F.to_json(F.array(value))
        return F.when(value.isNotNull(), F.substr(listed, F.lit(2), F.length(listed) - 2))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")
