import oracle
import pytest
from conftest import SF

from celloom.plans import catalog, files, tidy  # noqa: F401

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    oracle.compare(catalog.queries()[name](spark, SF), SQL[name], SF)
