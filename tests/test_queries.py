"""Every registered query against its SQL twin on the smallest given tables."""

import pytest

from ledgerlens.plans import catalog
from tests.compare import compare, database

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    sql = catalog.ORACLES.get(name)
    ok, note = compare(spark, con, name, catalog.QUERIES[name], sql and catalog.with_tables(sql), FOLDER)
    assert ok, note


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert set(df.columns) == {"qid", "doc_id", "score", "rank"} and df.count() == 200


def test_most_queries_have_sql():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) - len(catalog.ORACLES) <= 6
