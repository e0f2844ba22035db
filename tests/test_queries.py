"""Every query against its SQL on the small tables, and the contract."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.collect()


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    assert contract.entry(spark).columns == [
        "request_id", "rank", "article_id", "title", "summary_digest", "category", "timestamp", "score", "full_chars",
    ]
