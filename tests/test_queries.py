import pytest

from gapweave.plans import queries, reader_queries, source_queries, text_queries
from tests.oracle import DATA, connect, same


#: Queries without rows on the smallest tables run on the next.
LARGER = {"fragile_regions": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, con, name):
    folder = LARGER.get(name, DATA)
    same(queries.QUERIES[name](spark, folder), connect(folder) if name in LARGER else con, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(text_queries.QUERIES))
def test_text_against_sql(spark, con, name):
    same(text_queries.QUERIES[name](spark, DATA), con, text_queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(reader_queries.QUERIES))
def test_reader_against_sql(spark, con, name):
    same(reader_queries.QUERIES[name](spark, DATA), con, reader_queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(source_queries.QUERIES))
def test_source_against_sql(spark, con, name):
    same(source_queries.QUERIES[name](spark, DATA), con, source_queries.ORACLES[name])
