import pytest
from oracle import connection, same

from quarry.plans import catalog, contacts, crm, flows, outreach, places, registry  # noqa: F401, the others add their queries to those of crm


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", crm.ORACLE_SQL)
def test_query_equals_sql(spark, sf_dir, con, name):
    assert same(crm.QUERIES[name](spark, sf_dir), con, crm.ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(crm.QUERIES.keys() - crm.ORACLE_SQL.keys()))
def test_query_runs(spark, sf_dir, name):
    assert crm.QUERIES[name](spark, sf_dir).count() > 0
