"""Every registered query of the corpus operators, against DuckDB on the smallest tables."""

import pytest
from oracle import connection, differences

from corpuslens import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.SQL:
        assert not differences(df, plans.SQL[name], con)
    else:
        assert df.count() > 0
