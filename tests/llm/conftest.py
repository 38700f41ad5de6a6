import pytest
from pyspark.sql import types as T

from lumenlog.session import ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with the columns of the real one and an extra ``spans``."""

    def build(rows):
        full = [(i, t, None, None, None if t is None else len(t), "x") for i, t in rows]
        schema = T._parse_datatype_string(DOCS + ", spans string")
        return spark.createDataFrame(full, schema)

    return build
