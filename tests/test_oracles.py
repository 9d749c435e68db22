"""Every query with SQL agrees with it on the smallest tables."""

import pytest

from strandline.plans import catalog
from tests.compare import difference

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SMALL)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, sql, SMALL) == ""
