"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

from corpus_curator.plans.check import compare, duck_connect
from corpus_curator.plans.registry import all_oracle_sql, all_queries

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()
SQLS = all_oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SQLS.get(name), SF)
    assert r["status"] in ("ok", "rows-only"), r


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQLS)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["uuid", "doc_id", "source", "lang", "text"]
