"""Every registered query against its SQL oracle, on the smallest tables."""

import pytest

from lumenlog.catalog import load
from tools.check_oracles import compare, connect

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        verdict = compare(df, duck, ORACLES[name])
        assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
    else:
        assert df.count() > 0


def test_every_query_has_plain_columns():
    assert set(ORACLES) <= set(QUERIES)
