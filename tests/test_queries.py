import pytest

import __spark_entry__
from lexiforge.plans import catalogue
from tests.compare import DATA, check, connect


@pytest.fixture(scope="module")
def connection():
    return connect()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, connection, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    if name in catalogue.ORACLE_SQL:
        check(df, catalogue.ORACLE_SQL[name], connection)
    else:
        assert name == "knn_approximate" and df.count() > 0  # its recall is measured in test_sources


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["pattern", "replace", "score", "n_docs", "confidence"]
    assert df.count() > 0
