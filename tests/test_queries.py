"""Every registered query against its SQL on the smallest data."""

import pytest

from check import compare, connect
from conftest import DATA
from touchline.queries import all_oracles, all_queries

ORACLES = all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    report = compare(all_queries()[name](spark, DATA), ORACLES[name], con)
    assert report is None, report


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(all_queries())
