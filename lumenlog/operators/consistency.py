"""Do document texts and query texts share one format and one model?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions import text as tx

# --- fixed values: report field -> values of the query that always match ----------
FIELDS = {
    "outcome": ["ANY"],
    "service": ["ANY"],
    "route": ["ANY"],
    "error": ["ANY", "NONE"],
    "errorMessage": ["ANY", "NONE"],
    "userRole": ["ANY"],
    "latencyBucket": ["ANY"],
}
ADVICE_ORDER = "⚠️ Field order mismatch: Document and query formats have different field orders. This may affect embedding similarity."
ADVICE_ROUTE = "💡 Route field: Query always uses 'ANY' but documents have specific routes. Consider extracting route from query or using route-specific search."
ADVICE_GOOD = "✅ Format consistency looks good!"
# --- end of fixed values ------------------------------------------------------------


def _entries(text: Column, compat: bool) -> Column:
    return tx.field_entries(text if compat else tx.without_narrative(text))


def _names(entries: Column) -> Column:
    return F.array_remove(entries["name"], "")


def _last_value(reversed_entries: Column, name: str) -> Column:
    """Value of the last entry called ``name``: the first one in the reversed list."""
    at = F.array_position(reversed_entries["name"], name)
    return F.when(at > 0, F.try_element_at(reversed_entries["value"], at.cast("int")))


def _compare(df: DataFrame, document: str, query: str, compat: bool) -> DataFrame:
    """Adds ``fields`` and ``fieldOrderMatch``. Each text is parsed once, into a list from last to first entry."""
    parsed = df.withColumns(
        {"_d": F.reverse(_entries(F.col(document), compat)), "_q": F.reverse(_entries(F.col(query), compat))}
    )
    names = {f: f if compat else f.lower() for f in FIELDS}
    parsed = parsed.withColumns(
        {f"{side}_{f}": _last_value(F.col(side), name) for f, name in names.items() for side in ("_d", "_q")}
    )

    def one(field, always):
        d, q = F.col(f"_d_{field}"), F.col(f"_q_{field}")
        same = d.eqNullSafe(q) | F.coalesce(q.isin(always), F.lit(False))
        return F.struct(
            F.coalesce(d, F.lit("")).alias("document"), F.coalesce(q, F.lit("")).alias("query"), same.alias("match")
        ).alias(field)

    return parsed.select(
        *df.columns,
        F.struct(*[one(f, v) for f, v in FIELDS.items()]).alias("fields"),
        (_names(F.col("_d")) == _names(F.col("_q"))).alias("fieldOrderMatch"),
    )


def field_match(df: DataFrame, document: str, query: str, compat: bool = False) -> DataFrame:
    """Adds ``fields``: per field {document, query, match}.

    Names are compared without case and the narrative is removed first. With
    ``compat`` names that contain capitals are never found (and so always match)
    and the narrative stays glued to the first name.
    """
    return _compare(df, document, query, compat).drop("fieldOrderMatch")


def same_order(document: Column, query: Column, compat: bool = False) -> Column:
    return _names(_entries(document, compat)) == _names(_entries(query, compat))


def consistency_report(
    pairs: DataFrame, document: str, query: str, document_model: str, query_model: str, compat: bool = False
) -> DataFrame:
    """Per pair: model match, field order, field matches and recommendations."""
    df = _compare(pairs, document, query, compat)
    df = df.withColumn("modelMatch", F.col(document_model).eqNullSafe(F.col(query_model)))
    wrong = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"fields.{f}.match") & ~F.col(f"fields.{f}.query").isin("ANY", "NONE"), F.lit(f)
                )
                for f in FIELDS
            ]
        )
    )
    df = df.withColumn("mismatched", wrong)
    model = F.concat(
        F.lit('⚠️ Model mismatch: Document uses "'), F.coalesce(document_model, F.lit("null")),
        F.lit('" but query uses "'), F.coalesce(query_model, F.lit("null")),
        F.lit('". Use the same model for both.'),
    )
    values = F.concat(
        F.lit("⚠️ Field value mismatches detected in: "), F.array_join("mismatched", ", "),
        F.lit(". These fields may not match correctly in vector search."),
    )
    any_wrong = F.size("mismatched") > 0
    advice = F.array_compact(
        F.array(
            F.when(~F.col("modelMatch"), model),
            F.when(~F.col("fieldOrderMatch"), ADVICE_ORDER),
            F.when(any_wrong, values),
            F.when((F.col("fields.route.query") == "ANY") & (F.col("fields.route.document") != ""), ADVICE_ROUTE),
            F.when(F.col("modelMatch") & F.col("fieldOrderMatch") & ~any_wrong, ADVICE_GOOD),
        )
    )
    return df.withColumn("recommendations", advice)


def consistency_rollup(report: DataFrame) -> DataFrame:
    """Corpus level: pairs, consistent pairs and mismatches per field."""
    flags = [F.count_if(~F.col(f"fields.{f}.match")).alias(f"{f}Mismatches") for f in FIELDS]
    clean = reduce(lambda a, b: a & b, [F.col("modelMatch"), F.col("fieldOrderMatch"), F.size("mismatched") == 0])
    return report.agg(
        F.count("*").alias("pairs"),
        F.count_if(clean).alias("consistent"),
        F.count_if(~F.col("modelMatch")).alias("modelMismatches"),
        F.count_if(~F.col("fieldOrderMatch")).alias("orderMismatches"),
        *flags,
    )
