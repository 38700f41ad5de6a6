"""Every registered query."""

from lumenlog.catalog.registry import ORACLES, QUERIES


def load():
    from lumenlog.catalog import (  # noqa: F401
        enrichment_queries,
        metrics_queries,
        pipeline_queries,
        question_queries,
        retrieval_queries,
        session_queries,
    )

    return QUERIES, ORACLES
