import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import local_session

    session = local_session("tests", 4)
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    """frame(rows, ddl) -> DataFrame"""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())
