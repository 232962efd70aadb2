"""Every registered query against its SQL twin."""

import pytest

from evidentia.plans import catalog
from tests.compare import connect, difference

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, con, name):
    assert difference(con, catalog.oracle_sql()[name], catalog.queries()[name](spark, SF)) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).limit(1).count() == 1
